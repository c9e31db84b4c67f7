"""Policy gate: scanner results and a policy to a verdict, a risk score and violations.

All facts about an artifact come from one grouped aggregate on ``artifact_id``, combined before the
shuffle. Every rule is then a column expression over that one row, so violations need no further
grouping: the row carries an array of at most 13 rules, and ``explode`` gives the long form.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.lookups import lookup, rows_where
from ..functions.text import verdict_exit

COMPLETE = ["Passed", "Failed"]
RULE_DEFAULTS = {
    "max_critical_cves": "int",
    "max_high_cves": "int",
    "block_malware": "boolean",
    "block_secrets": "boolean",
    "block_unsafe_model": "boolean",
    "block_model_drift": "boolean",
    "require_signature": "boolean",
    "require_provenance": "boolean",
    "require_sbom": "boolean",
    "require_aibom": "boolean",
    "allowed_formats": "array<string>",
    "blocked_formats": "array<string>",
}
VIOLATION = "array<struct<rule:string,severity:string,message:string>>"


def categorize(results: DataFrame) -> DataFrame:
    """Adds the category of each scanner; NULL for a name nobody knows."""
    return results.withColumn("gate_category", lookup(V.SCANNER_CATEGORIES, F.col("scanner")))


def unresolved_scanners(results: DataFrame) -> DataFrame:
    """Long form of the names that could not be interpreted, each once per artifact."""
    return categorize(results).filter("gate_category IS NULL").select("artifact_id", "scanner").distinct()


def incomplete_scanners(results: DataFrame) -> DataFrame:
    """Long form of scanners that did not finish, with how often."""
    open_rows = results.filter(~F.coalesce(F.col("status").isin(*COMPLETE, "Skipped"), F.lit(False)))
    return open_rows.groupBy("artifact_id", "scanner").agg(F.count(F.lit(1)).alias("runs"))


def _in(category: str) -> Column:
    return F.coalesce(F.col("gate_category") == category, F.lit(False))


def _max_counts(category: str, prefix: str) -> list[Column]:
    # scanners of one category overlap, so their counts are combined by maximum and not by sum
    return [
        F.coalesce(F.max(F.when(_in(category), F.col(s))), F.lit(0)).alias(f"{prefix}_{s}")
        for s in ("critical", "high", "medium", "low", "unknown")
    ]


def _status(category: str, alias: str) -> Column:
    detected = F.coalesce(F.bool_or(_in(category) & (F.col("findings") > 0)), F.lit(False))
    completed = F.coalesce(F.bool_or(_in(category) & F.col("status").isin(COMPLETE)), F.lit(False))
    return F.when(detected, "Detected").when(completed, "Clean").otherwise("Unknown").alias(alias)


def _completed(category: str) -> Column:
    return F.coalesce(F.bool_or(_in(category) & F.col("status").isin(COMPLETE)), F.lit(False))


def _found(category: str) -> Column:
    return F.coalesce(F.sum(F.when(_in(category), F.col("findings"))), F.lit(0))


def facts(results: DataFrame) -> DataFrame:
    """Everything the rules need to know about an artifact, in one aggregate."""
    passed = F.coalesce(F.col("status") == "Passed", F.lit(False)) & (F.coalesce("findings", F.lit(0)) <= 0)
    known_end = F.coalesce(F.col("status").isin(*COMPLETE, "Skipped"), F.lit(False))
    return (
        categorize(results)
        .groupBy("artifact_id")
        .agg(
            _status("malware", "malware_status"),
            _status("secret", "secrets_status"),
            *_max_counts("cve", "cve"),
            *_max_counts("model", "model"),
            *_max_counts("aibom", "aibom"),
            *[
                F.coalesce(F.sum(f"drift_{s}"), F.lit(0)).alias(f"drift_{s}")
                for s in ("critical", "high", "medium", "low", "unknown")
            ],
            F.coalesce(F.bool_or(_in("aibom") & F.coalesce("produced", F.lit(False))), F.lit(False)).alias(
                "aibom_generated"
            ),
            _completed("aibom").alias("aibom_ran"),
            _completed("sbom").alias("sbom_ran"),
            _completed("provenance").alias("provenance_checked"),
            F.coalesce(F.bool_and(F.when(_in("provenance"), passed)), F.lit(False)).alias("signature_verified"),
            _found("malware").alias("malware_findings"),
            _found("secret").alias("secret_findings"),
            F.count_if(F.col("gate_category").isNull()).alias("unresolved_results"),
            F.count_if(~known_end).alias("incomplete_results"),
        )
    )


def severity_max(results: DataFrame) -> DataFrame:
    """Per artifact and category, the largest count of each severity over its scanners."""
    return (
        categorize(results)
        .filter("gate_category IS NOT NULL")
        .groupBy("artifact_id", F.col("gate_category").alias("category"))
        .agg(*[F.max(s).alias(s) for s in ("critical", "high", "medium", "low", "unknown")])
    )


def with_policy(fact_rows: DataFrame, artifacts: DataFrame | None, rules: DataFrame | None) -> DataFrame:
    """Adds the policy columns. ``artifacts(artifact_id, format, policy_id)`` names each one's policy.

    Unset stays NULL; an artifact without a policy gets all NULL, which are the defaults.
    """
    rows = fact_rows
    if artifacts is not None:
        rows = rows.join(artifacts.select("artifact_id", "format", "policy_id"), "artifact_id", "left")
    else:
        rows = rows.withColumns({"format": F.lit(None).cast("string"), "policy_id": F.lit(None).cast("string")})
    if rules is not None:
        # Spark broadcasts the rules when their measured size allows it, and joins by shuffle otherwise
        rows = rows.join(rules, "policy_id", "left")
    missing = {name: F.lit(None).cast(kind) for name, kind in RULE_DEFAULTS.items() if name not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def _on(name: str, default: bool) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _violation(rule: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _listed(formats: str) -> Column:
    return F.coalesce(F.array_contains(F.transform(F.col(formats), F.lower), F.lower("format")), F.lit(False))


def violations_array() -> Column:
    """All violations of one row, in rule order. Can hold ``scanIncomplete`` twice."""
    c = F.col
    drift = c("drift_critical") + c("drift_high")
    has_format = F.coalesce(c("format"), F.lit("")) != ""
    aibom_message = F.when(c("aibom_ran"), "an AI bill of materials is required and its scanner described nothing")
    return rows_where(
        (
            c("unresolved_results") > 0,
            _violation(
                "scanIncomplete", "High", _text(c("unresolved_results"), " result(s) came from unknown scanners")
            ),
        ),
        (
            c("incomplete_results") > 0,
            _violation("scanIncomplete", "High", _text(c("incomplete_results"), " scanner run(s) did not finish")),
        ),
        (
            _on("block_malware", True) & (c("malware_status") == "Detected"),
            _violation("blockMalware", "Critical", _text("malware reported: ", c("malware_findings"))),
        ),
        (
            _on("block_secrets", True) & (c("secrets_status") == "Detected"),
            _violation("blockSecrets", "High", _text("secrets reported: ", c("secret_findings"))),
        ),
        (
            _on("block_unsafe_model", True) & (c("model_critical") > 0),
            _violation("blockUnsafeModel", "Critical", _text("critical model findings: ", c("model_critical"))),
        ),
        (
            c("cve_critical") > c("max_critical_cves"),
            _violation(
                "maxCriticalCVEs",
                "Critical",
                _text("critical CVEs: ", c("cve_critical"), ", allowed: ", c("max_critical_cves")),
            ),
        ),
        (
            c("cve_high") > c("max_high_cves"),
            _violation("maxHighCVEs", "High", _text("high CVEs: ", c("cve_high"), ", allowed: ", c("max_high_cves"))),
        ),
        (
            _on("require_signature", False) & ~c("signature_verified"),
            _violation("requireSignature", "High", F.lit("a trusted signature is required")),
        ),
        (
            _on("require_provenance", False) & ~c("provenance_checked"),
            _violation("requireProvenance", "Medium", F.lit("provenance is required and was not checked")),
        ),
        (
            _on("require_sbom", False) & ~c("sbom_ran"),
            _violation("requireSBOM", "Medium", F.lit("a software bill of materials is required")),
        ),
        (
            _on("require_aibom", False) & ~c("aibom_generated"),
            _violation(
                "requireAIBOM",
                "Medium",
                F.coalesce(aibom_message, F.lit("an AI bill of materials is required and no scanner wrote one")),
            ),
        ),
        (
            _on("block_model_drift", False) & (drift > 0),
            _violation("blockModelDrift", "High", _text("declarations the weights contradict: ", drift)),
        ),
        (
            has_format & (F.size(F.coalesce("allowed_formats", F.array().cast("array<string>"))) > 0)
            & ~_listed("allowed_formats"),
            _violation("allowedFormats", "High", _text("format ", c("format"), " is not on the allowed list")),
        ),
        (
            has_format & _listed("blocked_formats"),
            _violation("blockedFormats", "Critical", _text("format ", c("format"), " is on the blocked list")),
        ),
    )


def waived_rules(exceptions: DataFrame, now: datetime) -> DataFrame:
    """Rules waived per artifact by exceptions still in force. NULL artifact means every artifact.

    The set is limited to the 13 rule names, so it is bounded however many exceptions there are.
    """
    in_force = F.col("expires_at").isNull() | (F.lit(now) <= F.col("expires_at"))
    return (
        exceptions.filter(in_force)
        .select("artifact_id", F.explode("rules").alias("rule"))
        .filter(F.col("rule").isin(V.GATE_RULES))
        .groupBy("artifact_id")
        .agg(F.collect_set("rule").alias("waived_rules"))
    )


def _with_waivers(rows: DataFrame, exceptions: DataFrame | None, now: datetime) -> DataFrame:
    empty = F.array().cast("array<string>")
    if exceptions is None:
        return rows.withColumn("waived_rules", empty)
    waived = waived_rules(exceptions, now)
    # at most one row (the fleet-wide exceptions) of at most 13 names
    everywhere = waived.filter("artifact_id IS NULL").agg(F.flatten(F.collect_list("waived_rules")).alias("r"))
    own = waived.filter("artifact_id IS NOT NULL").withColumnRenamed("waived_rules", "own_rules")
    return (
        rows.join(own, "artifact_id", "left")
        .withColumn(
            "waived_rules",
            F.concat(F.coalesce("own_rules", empty), F.coalesce(everywhere.scalar(), empty)),
        )
        .drop("own_rules")
    )


def judged(
    results: DataFrame,
    artifacts: DataFrame | None = None,
    rules: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Facts, policy, enforced and waived violations of every artifact on one row.

    A listed artifact that no scanner has seen is judged too: nothing was found, and nothing ran. It enters the
    aggregate as a skipped scanner, which adds to no fact, so no further shuffle is needed.
    """
    moment = now or datetime(2026, 1, 1)
    if artifacts is not None:
        skipped = next(name for name, category in V.SCANNER_CATEGORIES.items() if category == "cve")
        listed = artifacts.select("artifact_id", F.lit(skipped).alias("scanner"), F.lit("Skipped").alias("status"))
        results = results.unionByName(listed, allowMissingColumns=True)
    rows = _with_waivers(with_policy(facts(results), artifacts, rules), exceptions, moment)
    rows = rows.withColumn("violations", violations_array())
    is_waived = lambda v: F.array_contains(F.col("waived_rules"), v["rule"])
    return rows.withColumns(
        {
            "enforced": F.filter("violations", lambda v: ~is_waived(v)),
            "waived": F.filter("violations", is_waived),
        }
    )


def risk_score() -> Column:
    c = F.col
    weighted = F.lit(0).cast("bigint")
    for severity, weight in V.CVE_WEIGHTS.items():
        weighted = weighted + c(f"cve_{severity}") * weight
    for severity, weight in V.MODEL_WEIGHTS.items():
        weighted = weighted + c(f"model_{severity}") * weight
    weighted = weighted + F.when(c("secrets_status") == "Detected", V.SECRETS_WEIGHT).otherwise(0)
    weighted = weighted + F.when(
        c("provenance_checked") & ~c("signature_verified"), V.UNVERIFIED_WEIGHT
    ).otherwise(0)
    per_violation = F.transform(
        "enforced", lambda v: F.coalesce(lookup(V.VIOLATION_WEIGHTS, v["severity"]), F.lit(V.OTHER_VIOLATION_WEIGHT))
    )
    weighted = weighted + F.aggregate(per_violation, F.lit(0), lambda a, x: a + x)
    capped = F.least(F.lit(V.MAX_RISK).cast("bigint"), weighted)
    return F.when(c("malware_status") == "Detected", V.MAX_RISK).otherwise(capped).cast("int")


def verdict() -> Column:
    return (
        F.when(F.size("enforced") == 0, "Approved")
        .when(F.exists("enforced", lambda v: v["severity"] == "Critical"), "Quarantined")
        .otherwise("ReviewRequired")
    )


def evaluate(
    results: DataFrame,
    artifacts: DataFrame | None = None,
    rules: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Verdict per artifact."""
    rows = judged(results, artifacts, rules, exceptions, now)
    return rows.select(
        "artifact_id",
        verdict().alias("verdict"),
        risk_score().alias("risk_score"),
        F.size("enforced").alias("enforced_violations"),
        F.size("waived").alias("waived_violations"),
        "malware_status",
        "secrets_status",
        "signature_verified",
        "provenance_checked",
        "aibom_generated",
        *[f"{p}_{s}" for p in ("cve", "model", "aibom") for s in ("critical", "high", "medium", "low", "unknown")],
        *[f"drift_{s}" for s in ("critical", "high", "medium", "low", "unknown")],
    ).withColumn("exit_code", verdict_exit(F.col("verdict")))


def violations(
    results: DataFrame,
    artifacts: DataFrame | None = None,
    rules: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Long form: one row per violation, with whether an exception waives it."""
    rows = judged(results, artifacts, rules, exceptions, now)
    return rows.select("artifact_id", "waived_rules", F.posexplode("violations").alias("position", "v")).select(
        "artifact_id",
        "position",
        F.col("v.rule").alias("rule"),
        F.col("v.severity").alias("severity"),
        F.col("v.message").alias("message"),
        F.array_contains("waived_rules", F.col("v.rule")).alias("waived"),
    )
