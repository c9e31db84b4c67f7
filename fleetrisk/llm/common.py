"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.session import cut_lineage as checkpointed

__all__ = ["checkpointed", "read", "texts", "arrow_binary", "components", "joined", "tidy", "worker_cache"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read, so that further columns never clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def arrow_binary(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without copying, and the offsets of its rows (nulls are empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    wide = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64, count=len(wide) + wide.offset + 1)[wide.offset :]
    data = wide.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the smallest row that each row reaches, after links ``a, b``."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if np.array_equal(low, high):
            return label
        label = label.copy()
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def spanning(edges: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """Links ``(a, b)`` of each task, ``at_once`` together, as one link of each node to the smallest that it reaches there.

    A node of a large group that was linked many times then has few links left to shuffle, most of them the same.
    """

    def run(batches):
        import pyarrow as pa

        def settle():
            node, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
            half, own = len(place) // 2, np.arange(len(node))
            low = joined(own, place[:half], place[half:])
            rows = np.nonzero(low != own)[0]
            return pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[low[rows]])], ["a", "b"])

        left, right, size = [], [], 0
        for batch in batches:
            left.append(batch.column(0).to_numpy(zero_copy_only=False))
            right.append(batch.column(1).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= at_once:
                yield settle()
                left, right, size = [], [], 0
        if size:
            yield settle()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of undirected ``edges(a, b)``; a component is named by its smallest node.

    Links of a task shrink to a forest; then alternating large-star and small-star steps until nothing moves: every step is one aggregate that combines
    before its shuffle and one join on the node, which Spark splits where a node has very many neighbours. Each
    round is checkpointed; only a count and a checksum reach the driver.
    """

    def least(neighbours: DataFrame, own: bool) -> DataFrame:
        low = F.min("v")
        return neighbours.groupBy("u").agg((F.least(F.col("u"), low) if own else low).alias("m"))

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = checkpointed(spanning(edges.where("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(least(both, True), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(least(large, False), "u")
        now = small.select(F.col("u").alias("a"), F.col("m").alias("b")).union(small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")))
        now = checkpointed(now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()


def tidy(run):
    """``run`` over Arrow batches, giving back to the system after each batch and at the end what it has freed.

    Workers outlive their tasks, and an executor's limit holds for all of them together with its JVM.
    """

    def give_back():
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    def tidied(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(each())
        give_back()

    return tidied


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for what is costly to build and the same for all tasks."""
    import sys
    import types

    return sys.modules.setdefault("fleetrisk_worker_cache", types.ModuleType("fleetrisk_worker_cache")).__dict__
