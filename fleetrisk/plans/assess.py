"""Scanner reports to verdicts, and verdicts to the status of controls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import controls as K
from ..operators import compliance, findings, gate
from ..sources import reports as R


def judge_reports(
    reports: DataFrame,
    artifacts: DataFrame | None = None,
    rules: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    now: datetime | None = None,
) -> dict[str, DataFrame]:
    """Counts and details are those of all findings, and a report in error or without
    output is a scanner that did not finish: neither is a clean result."""
    found, status = R.ingest(reports)
    counted = findings.finalize_counts(found)
    counts = [c for c in counted.columns if c not in ("artifact_id", "scanner")]
    results = status.join(counted, ["artifact_id", "scanner"], "left").fillna(0, counts)
    ended = F.when(F.col("state") != "parsed", "Incomplete").when(F.col("findings") > 0, "Failed").otherwise("Passed")
    results = results.withColumn("status", ended)
    return {
        "findings": found,
        "status": status,
        "results": results,
        "verdicts": gate.evaluate(results, artifacts, rules, exceptions, now),
    }


def assess(
    evidence: DataFrame,
    framework: str = K.AI_RMF,
    attestations: DataFrame | None = None,
    scope: DataFrame | None = None,
    now: datetime | None = None,
) -> dict[str, DataFrame]:
    """Status of every control, the assessment per artifact, and what stays unmeasured."""
    statuses = compliance.control_status(evidence, framework, attestations, scope, now)
    return {
        "statuses": statuses,
        "assessment": compliance.assessment(statuses),
        "open": compliance.open_controls(statuses),
        "unmeasured": compliance.unmeasured_traits(evidence),
    }
