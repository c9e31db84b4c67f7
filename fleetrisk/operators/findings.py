"""Findings as a table: tallies, caps, merging, ordering and exit classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..functions.lookups import lookup
from .skew import first_n_per_key, first_row_per_key

FINDING_COLUMNS = [
    "artifact_id", "scanner", "ord", "id", "title", "severity", "category", "location", "description",
]


def severity_counts(prefix: str = "", where: Column | None = None) -> list[Column]:
    """Five conditional counts: critical, high, medium, low and anything else."""
    keep = F.lit(True) if where is None else where
    known = list(V.SEVERITY_RANK)
    counts = [F.count_if(keep & (F.col("severity") == s)).cast("int").alias(f"{prefix}{s.lower()}") for s in known]
    other = ~F.coalesce(F.col("severity").isin(known), F.lit(False))
    return [*counts, F.count_if(keep & other).cast("int").alias(f"{prefix}unknown")]


def is_drift() -> Column:
    return F.coalesce(F.lower("category") == "drift", F.lit(False))


def tally(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts by severity, drift rows and all other rows apart."""
    drift = F.coalesce(F.col("category") == "drift", F.lit(False))
    return findings.groupBy(*(keys or ["artifact_id"])).agg(
        *severity_counts("", ~drift), *severity_counts("drift_", drift)
    )


def normalized(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", S.severity_normalize(F.col("severity")))


def finalize_counts(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ingest counts: severities normalised, every row counted, drift counted in both tallies."""
    return (
        normalized(findings)
        .groupBy(*(keys or ["artifact_id", "scanner"]))
        .agg(
            F.count(F.lit(1)).cast("int").alias("findings"),
            *severity_counts(),
            *severity_counts("drift_", is_drift()),
        )
    )


def cap_detail(findings: DataFrame, keys: list[str] | None = None, cap: int = V.REPORT_DETAIL_CAP) -> DataFrame:
    """The ``cap`` worst findings of each report, in scanner order within a severity.

    A report of at most ``cap`` findings keeps them all, so the same rule serves both cases.
    """
    order = [S.severity_rank(F.col("severity")), F.col("ord")]
    return first_n_per_key(normalized(findings), keys or ["artifact_id", "scanner"], order, cap)


def worst_severity(findings: DataFrame) -> DataFrame:
    """Most severe severity per artifact; anything outside the four known ones ranks last, as Unknown.

    Only the rank is aggregated: an integer buffer keeps this a hash aggregate without a sort.
    """
    worst = findings.groupBy("artifact_id").agg(F.min(S.severity_rank(F.col("severity"))).alias("_rank"))
    return worst.select("artifact_id", lookup(dict(enumerate(V.SEVERITIES)), F.col("_rank")).alias("worst"))


def exit_class(findings: DataFrame) -> DataFrame:
    return worst_severity(findings).withColumn("exit_code", S.worst_exit(F.col("worst")))


def fail_on(findings: DataFrame, threshold: str | None) -> DataFrame:
    """Exit class with a threshold: a worst finding below it exits clean."""
    result = exit_class(findings)
    if not threshold:
        return result
    levels = {s.lower(): rank for s, rank in V.SEVERITY_RANK.items()}
    name = threshold.lower()
    if name == "never":
        return result.withColumn("exit_code", F.lit(V.EXIT_CODES["clean"]))
    if name not in levels:
        raise ValueError(f"unknown threshold {threshold!r}: use {', '.join(levels)} or never")
    reached = S.severity_rank(F.col("worst")) <= levels[name]
    return result.withColumn("exit_code", F.when(reached, F.col("exit_code")).otherwise(V.EXIT_CODES["clean"]))


def merge_findings(parsed: DataFrame, walked: DataFrame) -> DataFrame:
    """All parsed rows, then walked rows whose (id, location) neither side has reported yet."""
    keys = ["artifact_id", "id", "location"]
    filled = [df.withColumn("location", F.coalesce("location", F.lit(""))) for df in (parsed, walked)]
    # both sides are reduced by key first, so a repeated finding cannot skew the anti join
    known = filled[0].select(*keys).distinct()
    fresh = first_row_per_key(filled[1], keys, [F.col("ord")]).join(known, keys, "left_anti")
    return filled[0].unionByName(fresh.select(*filled[0].columns))


def scanner_results(findings: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """One row per (artifact, scanner) with status, counts and drift counts.

    ``completed`` lists (artifact_id, scanner, produced) of scanners that ran; one without findings
    is Passed. Without it only scanners that reported something appear.
    """
    keys = ["artifact_id", "scanner"]
    drift = F.coalesce(F.col("category") == "drift", F.lit(False))
    counted = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("findings"),
        *severity_counts("", ~drift),
        *severity_counts("drift_", drift),
    )
    if completed is None:
        counted = counted.withColumn("produced", F.lit(None).cast("boolean"))
    else:
        counted = completed.select(*keys, "produced").join(counted, keys, "left")
        counts = [c for c in counted.columns if c not in (*keys, "produced")]
        counted = counted.fillna(0, counts)
    return counted.withColumn("status", S.status_for(F.col("findings")))


def findings_sorted(findings: DataFrame, by_id: bool = True) -> DataFrame:
    """Global stable order: artifact, severity, then id (SARIF) or scanner order (SPDX lines).

    A range-partitioned sort, so no artifact is gathered into one task.
    """
    rank = S.severity_rank(F.col("severity"))
    tail = [F.col("id"), F.col("ord")] if by_id else [F.col("ord")]
    return findings.withColumn("severity_rank", rank).orderBy("artifact_id", "severity_rank", *tail)
