"""Helpers shared by the operators: tables in the shared folder, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import shared_folder


def ship(spark: SparkSession) -> None:
    """Gives the library to the executors' Python, once an application, for clusters that do not have it installed."""
    _shipped(spark.sparkContext.applicationId, spark)


@cache
def _shipped(application: str, spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="tapeloom-"), "tapeloom.zip")  # the driver's own; Spark hands it out
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, names in os.walk(os.path.join(root, "tapeloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once below ``spark.checkpoint.dir`` and read back.

    Cuts lineage, survives lost executors, and gives a join an input that it has to exchange itself, so that adaptive
    execution may split its hot keys.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no plan still to run reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text: two hashes of different seeds. A null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("_t1"), F.xxhash64(F.lit(1), whole).alias("_t2")]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Each round, every node points to its smallest neighbour, pointers are followed once more, and the edges are
    contracted; a node only ever moves to a smaller one, so what is left of a component is its minimum. Nodes at least
    halve in a round. All steps are map-side combined minima and equality joins, so a hub costs its edges and no more.
    No edges: no rows.
    """
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    labels = None
    while True:
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        parent = stored(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component")), label)
        upper = parent.select(F.col("node").alias("component"), F.col("component").alias("_top"))
        parent = stored(parent.join(upper, "component").select("node", F.col("_top").alias("component")), label)
        if labels is None:
            labels = parent
        else:
            moved = parent.select(F.col("node").alias("component"), F.col("component").alias("_to"))
            labels = stored(labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), label)
        for end in ("a", "b"):
            live = live.join(parent.select(F.col("node").alias(end), F.col("component").alias("_to")), end).drop(end).withColumnRenamed("_to", end)
        live = stored(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
        if live.isEmpty():
            return labels


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds at most ``limit`` bytes of the string ``column``, or one row."""
    for batch in batches:
        sizes = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + limit, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
