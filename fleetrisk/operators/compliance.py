"""Control frameworks: evidence of each artifact to a status for each control.

The catalogues hold at most 72 controls, so they live in the plan as a literal array that is exploded per
artifact. Attestations and scope are joined as small per-artifact maps keyed by control.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import controls as K
from ..functions import text as S
from ..functions.lookups import literal_map, lookup, sql_literal

OPEN = {"NotSatisfied": 3, "PartiallySatisfied": 2, "AttestationRequired": 1}
STATUSES = [
    "Satisfied", "PartiallySatisfied", "NotSatisfied", "Attested", "AttestationRequired", "NotApplicable",
]
CONTROL_SCHEMA = (
    "framework string, control_id string, position int, function string, category string, automation string, "
    "evidence array<string>, reason string"
)


def controls(spark: SparkSession, framework: str | None = None) -> DataFrame:
    """The catalogue as a table, in its published order."""
    rows = [c for f in ([framework] if framework else [K.AI_RMF, K.SP_800_53]) for c in K.catalog(f)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], CONTROL_SCHEMA)


def natural_order(catalogue: DataFrame) -> DataFrame:
    """AI RMF controls by function and number; the other catalogue keeps its order."""
    key = S.control_sort_key(F.col("function"), F.col("control_id"))
    ranked = F.col("framework") == K.AI_RMF
    return catalogue.withColumns(
        {
            "function_order": F.when(ranked, key["function_order"]).otherwise(0),
            "major": F.when(ranked, key["major"]).otherwise(F.col("position")),
            "minor": F.when(ranked, key["minor"]).otherwise(0),
        }
    ).orderBy("framework", "function_order", "major", "minor")


def catalog_coverage(catalogue: DataFrame) -> DataFrame:
    """Totals by automation level per framework and function; NULL function is the framework total."""
    rows = catalogue.filter("framework IS NOT NULL")
    counts = [
        F.count(F.lit(1)).cast("int").alias("total"),
        *[F.count_if(F.col("automation") == a).cast("int").alias(a.lower()) for a in ("Full", "Partial", "None")],
    ]
    # two aggregates, each with its own groups in memory; a rollup holds three rows for each given one in one table
    totals = rows.groupBy("framework").agg(*counts).withColumn("function", F.lit(None).cast("string"))
    return rows.groupBy("framework", "function").agg(*counts).unionByName(totals)


def observed_kinds() -> Column:
    """Evidence kinds seen for a row of the evidence table; none at all while its scan is incomplete."""
    decided = (F.coalesce("verdict", F.lit("")) != "") & (F.col("verdict") != "Unknown")
    seen = {
        "inventory": F.col("inventoried"),
        "security-scan": F.col("security_scanned"),
        "sbom": F.col("sbom_generated"),
        "aibom": F.col("aibom_generated"),
        "provenance": F.col("signature_verified"),
        "secrets": F.col("secrets_scanned"),
        "policy": F.coalesce("policy_ref", F.lit("")) != "",
        "verdict": decided,
        "risk-score": F.col("risk_scored"),
        "residual-risk": F.col("residual_risks_documented"),
        "scan-history": F.col("continuous_monitoring"),
        "revocation": F.col("admission_enforcing"),
        "coverage-gap": F.lit(True),
        "bias-eval": F.col("bias_evaluated"),
    }
    kinds = F.array_compact(F.array(*[F.when(seen[k], F.lit(k)) for k in K.EVIDENCE_KINDS]))
    complete = F.coalesce("scan_complete", F.lit(False))
    return F.when(complete, kinds).otherwise(F.array().cast("array<string>"))


def evidence_observed(evidence: DataFrame) -> DataFrame:
    """Long form of what was seen."""
    return evidence.select("artifact_id", F.explode(observed_kinds()).alias("kind"))


def attestation_valid(attestations: DataFrame, now: datetime) -> DataFrame:
    """The last attestation of each control, whether it counts, and a warning."""
    fields = ["statement", "attested_by", "expires_at"]
    last = (
        attestations.groupBy("artifact_id", "control_id")
        .agg(F.max_by(F.struct(*fields), "ord").alias("a"))
        .select("artifact_id", "control_id", "a.*")
    )
    blank = lambda c: S.strip(F.coalesce(c, F.lit(""))) == ""
    expired = F.coalesce(F.lit(now) > F.col("expires_at"), F.lit(False))
    problem = (
        F.when(blank("attested_by"), "no named attester")
        .when(blank("statement"), "no statement")
        .when(expired, "expired")
    )
    warning = F.coalesce(problem, F.when(F.col("expires_at").isNull(), "no expiry"))
    return last.withColumns({"valid": problem.isNull(), "warning": warning})


def _map_of(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Per ``key`` a map from control to value. At most one entry per known control, so bounded."""
    known = [c["control_id"] for f in (K.AI_RMF, K.SP_800_53) for c in K.catalog(f)]
    entry = F.struct(F.col("control_id"), value)
    return (
        rows.filter(F.col("control_id").isin(known))
        .groupBy(key, "control_id")
        .agg(F.max(entry).alias("e"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list("e")).alias(name))
    )


def control_status(
    evidence: DataFrame,
    framework: str = K.AI_RMF,
    attestations: DataFrame | None = None,
    scope: DataFrame | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """One row per artifact and control. ``scope`` is keyed by the evidence column ``profile``."""
    rows = evidence.withColumn("_seen", observed_kinds())
    if attestations is None:
        rows = rows.withColumn("_attested", F.lit(None).cast("map<string,struct<valid:boolean,attested_by:string,warning:string>>"))
    else:
        judged = attestation_valid(attestations, now or datetime(2026, 1, 1))
        fields = F.struct("valid", "attested_by", "warning")
        rows = rows.join(_map_of(judged, "artifact_id", fields, "_attested"), "artifact_id", "left")
    if scope is None:
        rows = rows.withColumn("_scope", F.lit(None).cast("map<string,string>"))
    else:
        why = F.coalesce("justification", F.lit(""))
        rows = rows.join(_map_of(scope, "profile", why, "_scope"), "profile", "left")
    # a literal of at most 72 controls; artifacts are never joined to the catalogue
    entries = ", ".join(
        "named_struct('control_id', {}, 'function', {}, 'automation', {}, 'evidence', {})".format(
            *[sql_literal(c[k]) for k in ("control_id", "function", "automation", "evidence")]
        )
        for c in K.catalog(framework)
    )
    catalogue = F.expr(f"array({entries})")
    each = rows.select("artifact_id", "_seen", "_attested", "_scope", F.explode(catalogue).alias("c")).select(
        "artifact_id", "_seen", F.try_element_at("_attested", F.col("c.control_id")).alias("a"),
        F.try_element_at("_scope", F.col("c.control_id")).alias("why"), "c.*"
    )
    each = each.withColumns(
        {
            "evidence_seen": F.filter("evidence", lambda k: F.array_contains("_seen", k)),
            "evidence_missing": F.filter("evidence", lambda k: ~F.array_contains("_seen", k)),
            "attested": F.coalesce("a.valid", F.lit(False)),
        }
    )
    by_evidence = (
        F.when((F.col("automation") == "None") & F.col("attested"), "Attested")
        .when(F.col("automation") == "None", "AttestationRequired")
        .when(F.size("evidence_missing") > 0, "NotSatisfied")
        .when((F.col("automation") == "Full") | F.col("attested"), "Satisfied")
        .otherwise("PartiallySatisfied")
    )
    scoped = F.col("why").isNotNull()
    justified = S.strip(F.col("why")) != ""
    status = F.when(scoped & justified, "NotApplicable").when(scoped, "AttestationRequired").otherwise(by_evidence)
    empty = F.array().cast("array<string>")
    reason = (
        F.when(scoped & justified, F.col("why"))
        .when(scoped, "scoped out without a justification")
        .when(
            status == "NotSatisfied",
            F.concat(F.lit("evidence not produced: "), F.array_join("evidence_missing", ", ")),
        )
        .when(status == "Attested", F.concat(F.lit("attested by "), F.col("a.attested_by")))
        .otherwise(lookup(K.REASONS, F.col("automation")))
    )
    return each.select(
        "artifact_id",
        F.lit(framework).alias("framework"),
        "control_id",
        "function",
        "automation",
        status.alias("status"),
        reason.alias("reason"),
        F.when(scoped, empty).otherwise(F.col("evidence_seen")).alias("evidence_seen"),
        F.when(scoped, empty).otherwise(F.col("evidence_missing")).alias("evidence_missing"),
        F.when(~scoped & F.col("attested"), F.col("a.attested_by")).alias("attested_by"),
        F.when(~scoped, F.col("a.warning")).alias("warning"),
    )


def assessment(statuses: DataFrame) -> DataFrame:
    """Counts by status; conformant when no control is open."""
    counted = statuses.groupBy("artifact_id", "framework").agg(
        *[F.count_if(F.col("status") == s).cast("int").alias(s) for s in STATUSES]
    )
    names = {s: "".join("_" + ch.lower() if ch.isupper() else ch for ch in s).lstrip("_") for s in STATUSES}
    return counted.withColumnsRenamed(names).withColumn(
        "conformant",
        (F.col("partially_satisfied") == 0) & (F.col("not_satisfied") == 0) & (F.col("attestation_required") == 0),
    )


def open_controls(statuses: DataFrame) -> DataFrame:
    """Open controls, worst first within an artifact."""
    worst = lookup(OPEN, F.col("status"))
    return statuses.withColumn("openness", worst).filter("openness IS NOT NULL").orderBy(
        "artifact_id", F.desc("openness"), "control_id"
    )


def unmeasured_traits(evidence: DataFrame) -> DataFrame:
    """Trustworthiness traits nothing here measured, in a fixed order."""
    unseen = lambda c: ~F.coalesce("scan_complete", F.lit(False)) | ~F.coalesce(c, F.lit(False))
    traits = F.array_compact(
        F.array(
            F.lit(K.TRAITS["valid"]),
            F.lit(K.TRAITS["safe"]),
            F.lit(K.TRAITS["explainable"]),
            F.when(~F.coalesce("bias_evaluated", F.lit(False)), K.TRAITS["fair"]),
            F.when(unseen("security_scanned"), K.TRAITS["secure"]),
            F.when(unseen("secrets_scanned"), K.TRAITS["privacy"]),
            F.when(unseen("signature_verified"), K.TRAITS["accountable"]),
        )
    )
    return evidence.select("artifact_id", F.posexplode(traits).alias("ord", "trait"))


# --- attack techniques -----------------------------------------------------------------------------------
def techniques(spark: SparkSession) -> DataFrame:
    rows = [
        (tid, name, tactic, coverage, evidence, mitigations)
        for tid, (name, tactic, coverage, evidence, mitigations) in K.TECHNIQUES.items()
    ]
    return spark.createDataFrame(
        rows, "technique_id string, name string, tactic string, coverage string, evidence array<string>, mitigations array<string>"
    )


def atlas_lookup(technique_id: Column) -> Column:
    """Struct of the current technique; a retired identifier is followed first."""
    current = F.coalesce(lookup(K.RETIRED_TECHNIQUES, technique_id), technique_id)
    fields = {
        "name": {t: v[0] for t, v in K.TECHNIQUES.items()},
        "tactic": {t: v[1] for t, v in K.TECHNIQUES.items()},
        "coverage": {t: v[2] for t, v in K.TECHNIQUES.items()},
    }
    return F.struct(current.alias("technique_id"), *[lookup(m, current).alias(n) for n, m in fields.items()])


def mitigation_name(mitigation_id: Column) -> Column:
    return lookup(K.MITIGATIONS, mitigation_id)


def atlas_summary(findings: DataFrame) -> DataFrame:
    """Techniques each finding is evidence of, counted per artifact and coverage level.

    A finding belongs to a technique by its id prefix or its scanner; at most a handful per finding.
    """
    by_key: dict[str, list[str]] = {}
    for tid, (_, _, _, evidence, _) in K.TECHNIQUES.items():
        for key in evidence:
            by_key.setdefault(key, []).append(tid)
    arrays = literal_map(by_key)
    prefix = F.regexp_extract("id", r"^(AR-[A-Z]+)", 1)
    empty = F.array().cast("array<string>")
    both = F.array_union(
        F.coalesce(F.try_element_at(arrays, prefix), empty), F.coalesce(F.try_element_at(arrays, F.col("scanner")), empty)
    )
    coverage = literal_map({t: v[2] for t, v in K.TECHNIQUES.items()})
    hits = findings.select("artifact_id", F.explode(both).alias("technique_id"))
    counted = hits.groupBy("artifact_id", "technique_id").agg(F.count(F.lit(1)).alias("findings"))
    return counted.withColumn("coverage", F.try_element_at(coverage, F.col("technique_id")))


def atlas_coverage(spark: SparkSession) -> DataFrame:
    """How many techniques are covered at which level."""
    return techniques(spark).groupBy("coverage").agg(F.count(F.lit(1)).alias("techniques"))


