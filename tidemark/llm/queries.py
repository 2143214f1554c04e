"""One query per operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe_transducer,
    chat_windows,
    debruijn,
    line_crf,
    mixing,
    periodic_runs,
    phrase_index,
    repetition,
    simhash,
    sparse_suffix,
    token_alignment,
    token_counts,
    url_rules,
)
from tidemark.llm.common import WorkTables
from tidemark.llm.oracles import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers of a local session find this package wherever the driver was started.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    back = chat_windows.read_back(chat_windows.windows(turns.unionByName(extra)))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _kept_words(cut: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    removed = F.aggregate(
        F.coalesce("removed_spans", F.array().cast("array<struct<start int, end int>>")),
        F.lit(0).cast("long"),
        lambda n, s: n + s["end"] - s["start"],
    )
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents")).drop("source")


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op7_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_words(debruijn.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_words(sparse_suffix.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.fit(docs, _table(spark, sf_dir, "labels")))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.host_rule(*r) for r in url_rules.HOST_RULES] + [url_rules.pattern_rule(*r) for r in url_rules.PATTERN_RULES]
    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rules_table(spark, rules))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    aligned = token_alignment.align(_table(spark, sf_dir, "documents"), *files)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    rows = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_shared", digest.alias("groups_sha256"), "pairs")
    return token_alignment.scored(WorkTables(spark, "alignment").write("aligned", rows))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    there_and_back = bpe_transducer.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return there_and_back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by hash goes on with its words from some place on in a circle."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("w")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    circle = F.expr("transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)]))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(circle, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    length, period = -F.col("best.shorter"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_chat_windows": op3_chat_windows,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_repetition": op6_repetition,
    "op7_debruijn": op7_debruijn,
    "op8_sparse_suffix": op8_sparse_suffix,
    "op9_line_crf": op9_line_crf,
    "op10_url_rules": op10_url_rules,
    "op11_alignment": op11_alignment,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}
