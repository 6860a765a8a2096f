"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketline.llm import (
    adaptive_rules,
    bounded_ring,
    gray_simhash,
    hd_langid,
    knn_quality,
    residual_packing,
    stock_packing,
    swar_fim,
    temperature_mix,
    token_counts,
    toxicity_crf,
    vector_lsh,
    word_runs,
)
from basketline.llm.common import held_out, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out("doc_id", 4, 2)
    field = toxicity_crf.learn(docs, table(spark, sf_dir, "labels"), ~apart)
    tagged = docs.select("doc_id", apart.alias("held_out"), toxicity_crf.tag(field, docs).alias("found"))
    return tagged.select(
        "doc_id",
        "held_out",
        F.col("found.score").alias("score"),
        (F.col("found.score") >= 0.3).cast("int").alias("predicted"),
        F.size("found.spans").alias("n_spans"),
    )


@query
def op2_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(table(spark, sf_dir, "documents"))


ORACLES["op2_adaptive_rules"] = adaptive_rules.ORACLE


@query
def op3_hd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = held_out("doc_id", 4, 2)
    known = hd_langid.prototypes(docs, ~apart)
    found = docs.select("doc_id", apart.alias("held_out"), hd_langid.identify(known, docs).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op4_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_lsh.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", temperature_mix.word_count("text").alias("n_words"))
    mixed = temperature_mix.mix(narrow, target_entropy=0.9, max_repeats=4.0, tokens=F.col("n_words"))
    return mixed.select("doc.doc_id", "source", "n_tokens", "block", "pass", "draw")


@query
def op7_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gray_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", gray_simhash.as_hex("code").alias("fingerprint"), "component_id")


@query
def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bounded_ring.shard_rows(table(spark, sf_dir, "documents"), shards=40)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query
def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out("doc_id", 5, 0)
    space = knn_quality.learn(docs, table(spark, sf_dir, "labels"), ~apart)
    scored = docs.select("doc_id", apart.alias("held_out"), knn_quality.score(space, docs).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return residual_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


@query
def op11_swar_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = swar_fim.with_fim(docs, seed=7, percent=100, spm_percent=50)
    back = swar_fim.restored(F.col("fim.form"), F.col("fim.output"))
    return done.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op12_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return stock_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def with_periods(doc_id: str, text: str) -> Column:
    """The text; where the id's hash is a multiple of ten, with its end made periodic as the query's definition says."""
    words = F.array_remove(F.split(F.col(text), "[ \\t-\\r]+"), "")
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    made = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(unit), F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(F.col(text))


@query
def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_periods("doc_id", "text").alias("text"))
    found = word_runs.with_runs(docs)
    best = F.col("periodic.strongest")
    lines = F.transform("periodic.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * periodic.strongest.length div periodic.strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
