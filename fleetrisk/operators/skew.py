"""Building blocks that stay spread out when one artifact holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fan_out(df: DataFrame) -> int:
    """How many slices a hot key is split into: as many as there are shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, position: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key in ``order``.

    Ranks within slices first, so that a hot key is cut to at most ``slices * n`` rows before its rows
    meet in one window. A slice is a group of input partitions: any slicing gives the same result, and a
    task that is run again puts its rows into the same slice. ``order`` must be total within a key.
    """
    salted = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(fan_out(df))))
    by_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    by_key = Window.partitionBy(*keys).orderBy(*order)
    kept = (
        salted.withColumn("_rank", F.row_number().over(by_slice))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_slice")
        .withColumn("_rank", F.row_number().over(by_key))
        .filter(F.col("_rank") <= n)
    )
    return kept.withColumnRenamed("_rank", position) if position else kept.drop("_rank")


def first_row_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the smallest in ``order``. An aggregate, so it is combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)


def bounded_groups(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Split into rows of groups of at most ``limit`` rows, and the rows of larger groups."""
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) > limit).alias("_large"))
    marked = df.join(sizes, keys)
    return marked.filter(~F.col("_large")).drop("_large"), marked.filter("_large").drop("_large")
