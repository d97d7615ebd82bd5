"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import crf, divergence, hnsw, middles, mixing, packing, secrets, simhash, spans, squares, suffix, tokens, urls
from tapeloom.llm.common import ship

#: The rules of the host and path filter.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Shares of the mix: domains alike, languages by these weights, sources alike.
MIX = {"lang": {"en": 4, "de": 2, "es": 2, "fr": 2}}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return spans.remove_repeated_spans(_table(spark, folder, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"), URL_RULES)


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return crf.score(docs, crf.fit(docs, _table(spark, folder, "labels")))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's columns, then ``text``: what is left, with bytes of cut characters replaced."""
    left = suffix.remove_repeated_bytes(_table(spark, folder, "documents"))
    return left.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge_quality(_table(spark, folder, "documents"))


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.near_vectors(_table(spark, folder, "embeddings"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mix(_table(spark, folder, "documents"), MIX, share=0.5, epochs=3)
    return taken.select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op9_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, folder, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its number repeats some of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10).cast("long")).alias("_g"))
    rows = rows.withColumn("_words", F.when(F.col("_g").isNotNull(), divergence.words_of(F.col("text"))))
    rows = rows.withColumn("_n", F.when(F.size("_words") > 0, F.size("_words"))).withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_left", F.col("_n") - F.col("_a")).withColumn("_p", (1 + F.floor(F.col("_left") / (3 + F.col("_g") % 8))).cast("int"))
    piece = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(piece, F.ceil(F.col("_left") / F.col("_p")).cast("int"))), F.lit(1), F.col("_left"))
    changed = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("_n").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = squares.periodic_runs(planted_runs(_table(spark, folder, "documents")))
    longer = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    found = found.withColumn("_best", longer)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{name}").alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda x: x["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.LEAST]
    digest = F.sha2(secrets.listed(of(*secrets.LEAST)).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = middles.transform(_table(spark, folder, "documents"))
    digests = [F.sha2(x.cast("binary"), 256).alias(name) for name, x in (("output_sha256", F.col("output")), ("restored_sha256", middles.restored(F.col("output"), F.col("form"))))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_url_filter, op3_quality_classifier, op4_suffix_dedup, op5_best_fit_packing, op6_quality_rules, op7_embedding_dedup,
        op8_source_mixing, op9_simhash_dedup, op10_token_counts, op11_periodic_runs, op12_secret_scan, op13_fill_in_middle,
    )
}
