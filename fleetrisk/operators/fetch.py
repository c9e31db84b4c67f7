"""Which files of a repository would be read whole, by header, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from .skew import first_n_per_key

PLAN = "artifact_id string, path string, size bigint, action string, reason string"


def fetch_plan(files: DataFrame, limits: dict | None = None) -> DataFrame:
    """Action and reason for each file, in path order within a repository.

    Whether a file fits depends on every file accepted before it, which is a running fold over the ordered list: the
    files of a repository pass one task as a stream that keeps one number, whatever their count. The file limit is the
    caller's; files beyond it are told apart before, in slices, and reported from the table itself.
    """
    lim = {**V.FETCH_LIMITS, **(limits or {})}
    entries = files.select("artifact_id", "path", F.col("size").cast("bigint").alias("size"))
    if lim["max_files"] is None:
        considered = entries.repartition("artifact_id")
    else:
        # its last step leaves each repository whole, in one partition
        considered = first_n_per_key(entries, ["artifact_id"], [F.col("path")], lim["max_files"])
        beyond = entries.join(considered.select("artifact_id", "path"), ["artifact_id", "path"], "left_anti").select(
            "artifact_id", "path", "size", F.lit("skipped").alias("action"), F.lit("file limit reached").alias("reason")
        )
    most_total, most_file, header_bytes = lim["max_total_bytes"], lim["max_file_bytes"], lim["header_bytes"]
    header = S.extension(F.col("path")).isin(V.HEADER_INSPECTABLE_EXTS)

    def run(batches):
        import pyarrow as pa

        current, total = object(), 0
        for batch in batches:
            action, reason = [], []
            for artifact, size, by_header in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if artifact != current:
                    current, total = artifact, 0
                size, why = size or 0, None
                if by_header:
                    what = "header"
                    total += min(size, header_bytes)
                elif size > most_file:
                    what, why = "skipped", "file too large and without a readable header"
                elif total + size > most_total:
                    what, why = "skipped", "total fetch limit reached"
                else:
                    what = "whole"
                    total += size
                action.append(what)
                reason.append(why)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(action, pa.string()), pa.array(reason, pa.string())],
                ["artifact_id", "path", "size", "action", "reason"],
            )

    ordered = considered.select("artifact_id", "path", "size", header.alias("header")).sortWithinPartitions("artifact_id", "path")
    decided = ordered.mapInArrow(run, PLAN)
    return decided if lim["max_files"] is None else decided.unionByName(beyond)


def fetch_coverage(plan: DataFrame) -> DataFrame:
    """Counts, completeness and summary per repository."""
    runs = S.executes_on_load(F.col("path"), "fetch")
    counts = plan.groupBy("artifact_id").agg(
        F.count_if(F.col("action") == "whole").alias("whole"),
        F.count_if(F.col("action") == "header").alias("header_only"),
        F.count_if(F.col("action") == "skipped").alias("skipped"),
        F.count_if((F.col("action") == "skipped") & runs).alias("unread_executables"),
    )
    complete = (F.col("header_only") == 0) & (F.col("skipped") == 0)
    summary = F.when(complete, F.concat("whole", F.lit(" file(s) read in full"))).otherwise(
        F.concat("whole", F.lit(" read in full, "), "header_only", F.lit(" header-only, "), "skipped", F.lit(" not read"))
    )
    return counts.withColumns({"complete": complete, "summary": summary})


def unread_executables(plan: DataFrame) -> DataFrame:
    """Long form of skipped files that could run code."""
    runs = S.executes_on_load(F.col("path"), "fetch")
    return plan.filter((F.col("action") == "skipped") & runs).select("artifact_id", "path")
