"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a run of digests at one place of a binomial tree. In each round the partitions whose places
differ in one digit exchange their runs by that digit of the digest and merge them: of equal digests the smallest
identifier and the sum of the counts stay. After the last round a place holds every run of its digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import shared_path

FAN_IN_BITS = 4  # a merge takes up to 16 runs
DIGIT = 1 << FAN_IN_BITS
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of one run and place are merged by the digest and two further measures of the text, so a digest that two unlike
#: texts shared would stay two groups.
KEY = ["digest", "check", "n_bytes"]


def normalised(text: Column) -> Column:
    """The text with every stretch of blanks and line ends as one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """``run, row, doc_id`` and the digest, second hash and length of each text: all that is read of the texts.

    It is written to the shared folder, so places of rows hold whatever is lost or repeated later.
    """
    path = shared_path(docs.sparkSession, "digest-runs")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
    text.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("n_bytes"),
    ).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def digit(level: int) -> Column:
    """The ``level``-th digit of a digest, lowest first; the digest's own last eight bytes are its number."""
    number = F.conv(F.hex(F.substring("digest", 26, 7)), 16, 10).cast("long")
    return F.shiftright(number, FAN_IN_BITS * level).bitwiseAND(DIGIT - 1)


def merge_tree(rows: DataFrame, n_runs: int) -> DataFrame:
    """``digest, check, n_bytes, least, n``: the smallest identifier and the count of every digest.

    Round k exchanges by digit k: a run at place p goes, digest by digest, to the place that differs from p in that
    digit only. ``min`` over a structure is a sort-based aggregate, so a run is sorted before it leaves and runs are
    merged in order where they arrive. A digest has one row a run at most, also where it is a third of all rows.
    """
    rounds = 0
    while DIGIT**rounds < n_runs:
        rounds += 1
    runs = rows.select(*KEY, F.col("run").cast("long").alias("place"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("least"), F.lit(1).cast("long").alias("n"))
    for level in range(max(rounds, 1)):
        kept = F.col("place") - F.shiftleft(F.shiftright("place", FAN_IN_BITS * level).bitwiseAND(DIGIT - 1), FAN_IN_BITS * level)
        there = (kept + F.shiftleft(digit(level), FAN_IN_BITS * level)).alias("place")
        runs = runs.select(*KEY, there, "least", "n").groupBy("place", *KEY).agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    return runs.select(*KEY, "least", "n")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when they are identical after each stretch of blanks became one space; a null text is empty. Of
    equal texts one row stays: the one with the smallest doc_id, rows without doc_id last, and of rows that repeat a
    doc_id one. ``keep_id`` is null where no row of a group has a doc_id. An empty table gives no rows; columns beside
    ``doc_id`` and ``text`` are not read.

    Answers go back by run: a run has each of its digests once, so the join by run and digest has no hot key.
    """
    rows = digests(docs)
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    found = merge_tree(rows, n_runs)
    asked = rows.groupBy("run", *KEY).agg(F.count("*").alias("here"))
    answers = asked.join(found, KEY).select("run", *KEY, F.col("least.doc_id").alias("keep_id"), F.col("least.row").alias("keep_row"), F.col("n").alias("group_size"))
    return rows.join(answers, ["run", *KEY]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
