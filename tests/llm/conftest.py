import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is that for it with as was on are by this be from thing nation other".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
}


def prose(seed, n, lang="en"):
    rng = random.Random(seed)
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing"]) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and white texts, ties, repeated rows, a long text."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, 4),
        (4, "One word", "en", "b", 8),
        (4, "One word", "en", "b", 8),
        (5, "One word", "de", "a", 8),
        (None, "a text without an id, 123 <|endoftext|>", "en", "a", 1),
        (None, None, None, None, None),
        (6, "日本語 ñandú — “quoted” ½ \x00   İstanbul á", "ja", "c", 1),
        (7, prose(7, 30_000), "en", "a", 1),
        (8, "A!! B!!\nA!! B!!\n\n  A!! B!!", "en", "b", 1),
    ]
    rows += [(100 + i, prose(i, 20 + i % 90, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", f"s{i % 4}", i) for i in range(80)]
    return rows + [(200 + i, prose(5, 60), "en", "s0", i) for i in range(6)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(edge_docs):
    """Further columns with names that operators use inside."""
    names = "score found row code arc piece rank n_tokens block draw label doc node component first shard size slot at"
    out = edge_docs
    for i, name in enumerate(names.split()):
        from pyspark.sql import functions as F

        out = out.withColumn(name, F.lit(f"x{i}"))
    return out
