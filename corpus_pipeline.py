"""A corpus pipeline of five stages over ``documents``; each works on all that the stage before it kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which the runner
writes as Parquet and reads again as the next function's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import crf, mixing, packing, simhash, spans
from tapeloom.llm.common import ship, stored
from tapeloom.llm.queries import MIX


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is one half or more; the classifier is fitted on labelled documents of the input."""
    ship(spark)
    return crf.keep_good(docs, crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    ship(spark)
    return simhash.first_of_groups(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated spans, with ``n_chars`` counted anew; documents that lose their whole text go."""
    ship(spark)
    left = spans.remove_repeated_spans(docs).where((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    changed = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return left.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as the input has, mixed to the target weights; a document stands once per epoch that takes it."""
    ship(spark)
    return mixing.take(docs, mixing.mix(docs, MIX, share=1.0, epochs=2))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("packing", pack)]

#: The classifier's fit cannot be told in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
