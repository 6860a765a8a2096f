"""Quality rules whose limits come from the corpus: quantile sketches per language and source.

Each text gets counts (words, symbols, repeated lines and word windows). Texts that pass the
base rules are measured by ratios of these, and each ratio goes into the sketch of its
(language, source). A sketch is a histogram whose buckets are exact for small numbers and 1/32
wide, relative to their value, above; merging two adds their counts, so any partition of the rows
gives the same sketch, and its size depends on the range of values alone. From its
quartiles follow the limits: the far fences of a box plot, at least ``SPREAD`` beyond the
quartile. A (language, source) with fewer than ``MIN_ROWS`` texts uses the merged sketch of
its language, and a small language that of all texts. A text is kept if all its ratios lie
within its group's limits.

Words are separated by ASCII white space. Null texts count as empty and fail the base
rules; null languages and sources are groups of their own. Equal rows count each. An empty
table gives an empty table. All of it is DataFrame work; ``ORACLE`` says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketline.staging import stage

MIN_WORDS = 50
#: Share of repeated words, in percent, above which a text fails the base rules.
MAX_REPEATED = 50
#: Texts that a group needs for limits of its own.
MIN_ROWS = 200
#: How many interquartile ranges beyond a quartile the fence stands.
FENCE = 3
#: The ratios: per mille, word length in hundredths. Spread: least distance of the fence.
SPREAD = {"word_length": 200, "symbols": 100, "dup_lines": 500, "repeats": 400}

SPACE = r"[\x20\x09-\x0D]"
#: Bits of a window's sort key that hold its place in the text.
PLACE_BITS = 24
_PLACE = (1 << PLACE_BITS) - 1


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _covered(places: Column) -> Column:
    """Words in windows of three at these ascending places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))

    def add(done: Column, place: Column) -> Column:
        reached = done["n"] + F.least(F.lit(3).cast("long"), place - done["last"])
        return F.struct(reached.alias("n"), place.alias("last"))

    return F.aggregate(places, start, add, lambda done: done["n"])


def _with_twin(windows: Column, same) -> Column:
    """Those of the sorted windows that equal a neighbour."""

    def keep(x: Column, i: Column) -> Column:
        return ((i > 0) & same(x, F.get(windows, i - 1))) | F.coalesce(same(x, F.get(windows, i + 1)), F.lit(False))

    return F.filter(windows, keep)


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.

    Windows are sorted as longs, by a hash with their place in the last bits. Equal windows then
    stand side by side, unless hashes collide; if two neighbours' words differ, or places
    don't fit, the windows are sorted by their words.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)

    def key(i: Column) -> Column:
        code = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return code.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))

    def same_hash(x: Column, y: Column) -> Column:
        return F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0

    def window(key_: Column) -> Column:
        i = key_.bitwiseAND(F.lit(_PLACE)).cast("int")
        return F.struct(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def by_words() -> Column:
        rows = F.transform(
            places,
            lambda i: F.struct(
                F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.cast("long").alias("i")
            ),
        )

        def same(x: Column, y: Column) -> Column:
            return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        twins = _bound(F.array_sort(rows), lambda s: _with_twin(s, same))
        return _covered(F.array_sort(F.transform(twins, lambda x: x["i"])))

    def by_hash(twins: Column) -> Column:
        collide = F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(twins) - 1, F.lit(1))),
            lambda k: F.coalesce(
                same_hash(F.get(twins, k), F.get(twins, k - 1)) & (window(F.get(twins, k)) != window(F.get(twins, k - 1))),
                F.lit(False),
            ),
        )
        own = F.transform(twins, lambda x: x.bitwiseAND(F.lit(_PLACE)))
        return F.when(collide, by_words()).otherwise(_covered(F.sort_array(own)))

    sorted_keys = F.sort_array(F.transform(places, key))
    quick = _bound(_bound(sorted_keys, lambda s: _with_twin(s, same_hash)), by_hash)
    return (
        F.when(F.size(words) < 4, F.lit(0).cast("long"))
        .when(F.size(words) > _PLACE, by_words())
        .otherwise(quick)
    )


def measure(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep`` with the counts and the base verdict of each text."""
    own = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*keep, own.alias("_text"), F.array_remove(F.split(own, f"{SPACE}+"), "").alias("_words"))
    kept = [c for c in split.columns if c not in ("_text", "_words")]
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("new"))).alias("_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_lines.all") - F.col("_lines.new")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.col("_lines.all").cast("long").alias("n_lines"),
        failed.alias("base_failed"),
    )


def ratios() -> dict[str, Column]:
    return {
        "word_length": F.expr("word_chars * 100 DIV n_words"),
        "symbols": F.expr("n_symbols * 1000 DIV n_words"),
        "dup_lines": F.expr("n_dup_lines * 1000 DIV n_lines"),
        "repeats": F.expr("n_repeat_words * 1000 DIV n_words"),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, low, high, n): the buckets of each group, from low to high."""
    named = F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("value")) for k, v in ratios().items()])
    values = measured.where("NOT base_failed").select("lang", "source", F.explode(named).alias("x"))
    shift = F.expr("greatest(0, length(bin(x.value)) - 6)")
    bucket = values.select("lang", "source", "x.ratio", "x.value", shift.alias("shift"))
    low = F.expr("shiftleft(shiftright(value, shift), shift)")
    return (
        bucket.groupBy("lang", "source", "ratio", low.alias("low"), F.expr("shiftleft(1L, shift)").alias("width"))
        .agg(F.count("*").alias("n"))
        .select("lang", "source", "ratio", "low", (F.col("low") + F.col("width") - 1).alias("high"), "n")
    )


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, ratio, least, most) of each group, from the smallest merge that has ``MIN_ROWS``."""
    by_lang = sketch.groupBy("lang", "ratio", "low", "high").agg(F.sum("n").alias("n"))
    of_all = by_lang.groupBy("ratio", "low", "high").agg(F.sum("n").alias("n"))
    quartiles = None
    for merged, keys in ((sketch, ["lang", "source"]), (by_lang, ["lang"]), (of_all, [])):
        in_group = W.partitionBy(*keys, "ratio")
        ranked = merged.withColumns(
            {
                "upto": F.sum("n").over(in_group.orderBy("low", "high")),
                "rows": F.sum("n").over(in_group),
            }
        )
        found = ranked.groupBy(*keys, "ratio").agg(
            F.max("rows").alias("rows"),
            F.min(F.when(F.expr("upto >= (rows + 3) DIV 4"), F.col("low"))).alias("q1"),
            F.min(F.when(F.expr("upto >= (rows * 3 + 3) DIV 4"), F.col("high"))).alias("q3"),
        )
        spread = F.lit(0).cast("long")
        for ratio, least in SPREAD.items():
            spread = F.when(F.col("ratio") == ratio, F.lit(least).cast("long")).otherwise(spread)
        reach = F.greatest(F.lit(FENCE) * (F.col("q3") - F.col("q1")), spread)
        found = found.select(
            *keys,
            "ratio",
            "rows",
            F.struct((F.col("q1") - reach).alias("least"), (F.col("q3") + reach).alias("most")).alias("box"),
        )
        if quartiles is None:
            quartiles = found.withColumnsRenamed({"rows": "own_rows", "box": "own"})
        elif keys:
            other = found.select(F.col("lang").alias("_l"), F.col("ratio").alias("_r"), F.col("rows").alias("lang_rows"), F.col("box").alias("wide"))
            quartiles = quartiles.join(other, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ratio") == F.col("_r")))
        else:
            other = found.select(F.col("ratio").alias("_a"), F.col("box").alias("widest"))
            quartiles = quartiles.join(other, F.col("ratio") == F.col("_a"))
    box = (
        F.when(F.col("own_rows") >= MIN_ROWS, F.col("own"))
        .when(F.col("lang_rows") >= MIN_ROWS, F.col("wide"))
        .otherwise(F.col("widest"))
    )
    return quartiles.select("lang", "source", "ratio", box["least"].alias("least"), box["most"].alias("most"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The counts of each document with base_failed and kept."""
    measured = measure(
        docs, text, F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source")
    )
    measured = stage(measured, "rule-counts")
    found = limits(sketches(measured))
    boxes = found.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(
        *[
            F.max(F.when(F.col("ratio") == ratio, F.col(bound))).alias(f"_{ratio}_{bound}")
            for ratio in SPREAD
            for bound in ("least", "most")
        ]
    )
    joined = measured.join(
        stage(boxes, "rule-limits"),
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
        "left",
    )
    within = F.lit(True)
    for ratio, value in ratios().items():
        within &= value.between(F.col(f"_{ratio}_least"), F.col(f"_{ratio}_most"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(within, F.lit(False)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )


def _oracle() -> str:
    spreads = " ".join(f"WHEN '{ratio}' THEN {least}" for ratio, least in SPREAD.items())
    quartile = (
        "min(CASE WHEN upto >= (rows_ + 3) // 4 THEN low END) AS q1, "
        "min(CASE WHEN upto >= (rows_ * 3 + 3) // 4 THEN high END) AS q3, max(rows_) AS rows_"
    )

    def box(name: str, table: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""
{name} AS (
  SELECT {by}ratio, rows_, q1 - greatest({FENCE} * (q3 - q1), CASE ratio {spreads} END) AS least,
         q3 + greatest({FENCE} * (q3 - q1), CASE ratio {spreads} END) AS most
  FROM (SELECT {by}ratio, {quartile}
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}ratio ORDER BY low, high) AS upto,
                     sum(n) OVER (PARTITION BY {by}ratio) AS rows_ FROM {table}) GROUP BY {by}ratio))"""

    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
w AS (
  SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)),
r AS (
  SELECT k, count(DISTINCT i + j) AS n
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS m FROM w), (SELECT unnest([0, 1, 2]) AS j)
  WHERE m > 1 GROUP BY k),
c AS (
  SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM d LEFT JOIN r USING (k)),
m AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c),
x AS (
  SELECT lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS ratio,
         unnest([word_chars * 100 // n_words, n_symbols * 1000 // n_words,
                 n_dup_lines * 1000 // n_lines, n_repeat_words * 1000 // n_words]) AS v
  FROM m WHERE NOT base_failed),
s AS (
  SELECT lang, source, ratio, (v >> sh) << sh AS low, ((v >> sh) << sh) + (CAST(1 AS BIGINT) << sh) - 1 AS high,
         count(*) AS n
  FROM (SELECT *, greatest(0, length(bin(v)) - 6) AS sh FROM x) GROUP BY ALL),
sl AS (SELECT lang, ratio, low, high, sum(n) AS n FROM s GROUP BY ALL),
sa AS (SELECT ratio, low, high, sum(n) AS n FROM s GROUP BY ALL),
{box("g", "s", "lang, source")},
{box("gl", "sl", "lang")},
{box("ga", "sa", "")},
f AS (
  SELECT g.lang, g.source, g.ratio,
         CASE WHEN g.rows_ >= {MIN_ROWS} THEN g.least WHEN gl.rows_ >= {MIN_ROWS} THEN gl.least ELSE ga.least END AS least,
         CASE WHEN g.rows_ >= {MIN_ROWS} THEN g.most WHEN gl.rows_ >= {MIN_ROWS} THEN gl.most ELSE ga.most END AS most
  FROM g JOIN gl ON g.lang IS NOT DISTINCT FROM gl.lang AND g.ratio = gl.ratio JOIN ga ON g.ratio = ga.ratio),
b AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN ratio = '{r}' THEN {e} END) AS {r}_{e}" for r in SPREAD for e in ("least", "most"))}
  FROM f GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE coalesce(
         word_chars * 100 // n_words BETWEEN word_length_least AND word_length_most
         AND n_symbols * 1000 // n_words BETWEEN symbols_least AND symbols_most
         AND n_dup_lines * 1000 // n_lines BETWEEN dup_lines_least AND dup_lines_most
         AND n_repeat_words * 1000 // n_words BETWEEN repeats_least AND repeats_most, false) END AS kept
FROM m LEFT JOIN b ON m.lang IS NOT DISTINCT FROM b.lang AND m.source IS NOT DISTINCT FROM b.source
"""


ORACLE = _oracle()
