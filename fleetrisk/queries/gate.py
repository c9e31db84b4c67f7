"""Gate and findings operators over the given tables, each with its plain SQL statement."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..operators import findings as O
from ..operators import gate as G
from . import tables as T

NOW = datetime(1998, 1, 1)
NOW_SQL = "TIMESTAMP '1998-01-01'"
SEV = ["critical", "high", "medium", "low", "unknown"]


def _findings(spark, sf):
    return T.read(spark, sf, T.FINDINGS)


def _results(spark, sf):
    return T.read(spark, sf, T.SCANNER_RESULTS)


def _gate_inputs(spark, sf):
    return (
        _results(spark, sf),
        T.read(spark, sf, T.ARTIFACTS),
        T.read(spark, sf, T.RULES),
        T.read(spark, sf, T.EXCEPTIONS),
        NOW,
    )


NORM = """CASE upper(trim(severity)) WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High'
  WHEN 'MEDIUM' THEN 'Medium' WHEN 'MODERATE' THEN 'Medium' WHEN 'LOW' THEN 'Low' WHEN 'NEGLIGIBLE' THEN 'Low'
  WHEN 'INFO' THEN 'Low' WHEN 'INFORMATIONAL' THEN 'Low' ELSE 'Unknown' END"""
RANK = "CASE sev WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"
NORMED = "SELECT * EXCLUDE (severity), sev AS severity, " + RANK + " AS rnk FROM (SELECT *, " + NORM + " AS sev FROM f)"


def _count(prefix="", cond="true"):
    return ", ".join(
        [
            f"count(*) FILTER (WHERE ({cond}) AND severity = '{s}') AS {prefix}{s.lower()}"
            for s in ("Critical", "High", "Medium", "Low")
        ]
        + [f"count(*) FILTER (WHERE ({cond}) AND severity NOT IN ('Critical','High','Medium','Low')) AS {prefix}unknown"]
    )


def severity_scalars(spark, sf):
    f = _findings(spark, sf)
    sev = S.severity_normalize(F.col("severity"))
    return f.select(
        "ord",
        sev.alias("severity"),
        S.severity_rank(sev).alias("rank"),
        S.sarif_level(sev).alias("level"),
        S.security_score(sev).alias("score"),
        S.rule_name(F.col("id")).alias("rule_name"),
        F.array_join(S.finding_tags(F.col("category")), "|").alias("tags"),
    )


def cap_top500(spark, sf):
    # reports of the whole fleet per scanner, so that the cap binds
    f = _findings(spark, sf).withColumn("artifact_id", F.lit("fleet"))
    return O.cap_detail(f).select("scanner", "ord", "id", "severity")


def merge(spark, sf):
    f = O.normalized(_findings(spark, sf))
    parsed, walked = f.filter("category = 'drift'"), f.filter("category <> 'drift'").withColumn(
        "id", F.regexp_replace("id", "^AR-[OP]-", "AR-F-")
    )
    return O.merge_findings(parsed, walked).select("artifact_id", "id", "location", "ord", "category")


def results_from_findings(spark, sf):
    return O.scanner_results(O.normalized(_findings(spark, sf))).select(
        "artifact_id", "scanner", "status", "findings", *SEV, *[f"drift_{s}" for s in SEV]
    )


CATEGORY = """CASE scanner WHEN 'clamav' THEN 'malware' WHEN 'trivy' THEN 'cve' WHEN 'grype' THEN 'cve'
  WHEN 'syft' THEN 'sbom' WHEN 'trufflehog' THEN 'secret' WHEN 'model-inspector' THEN 'model'
  WHEN 'provenance' THEN 'provenance' WHEN 'aibom' THEN 'aibom' END"""

# plain SQL of the whole gate, one step per common table expression
GATE_STEPS = (
    """
c AS (SELECT *, """
    + CATEGORY
    + """ AS cat FROM r),
facts AS (
  SELECT artifact_id,
    CASE WHEN count(*) FILTER (WHERE cat='malware' AND findings>0)>0 THEN 'Detected'
         WHEN count(*) FILTER (WHERE cat='malware' AND status IN ('Passed','Failed'))>0 THEN 'Clean' ELSE 'Unknown' END AS malware_status,
    CASE WHEN count(*) FILTER (WHERE cat='secret' AND findings>0)>0 THEN 'Detected'
         WHEN count(*) FILTER (WHERE cat='secret' AND status IN ('Passed','Failed'))>0 THEN 'Clean' ELSE 'Unknown' END AS secrets_status,
    """
    + ", ".join(
        f"coalesce(max({s}) FILTER (WHERE cat='{k}'),0) AS {k}_{s}" for k in ("cve", "model", "aibom") for s in SEV
    )
    + ", "
    + ", ".join(f"CAST(sum(drift_{s}) AS BIGINT) AS drift_{s}" for s in SEV)
    + """,
    count(*) FILTER (WHERE cat='aibom' AND produced)>0 AS aibom_generated,
    count(*) FILTER (WHERE cat='aibom' AND status IN ('Passed','Failed'))>0 AS aibom_ran,
    count(*) FILTER (WHERE cat='sbom' AND status IN ('Passed','Failed'))>0 AS sbom_ran,
    count(*) FILTER (WHERE cat='provenance' AND status IN ('Passed','Failed'))>0 AS provenance_checked,
    count(*) FILTER (WHERE cat='provenance')>0 AND count(*) FILTER (WHERE cat='provenance' AND (status<>'Passed' OR findings>0))=0 AS signature_verified,
    coalesce(sum(findings) FILTER (WHERE cat='malware'),0) AS malware_findings,
    coalesce(sum(findings) FILTER (WHERE cat='secret'),0) AS secret_findings,
    count(*) FILTER (WHERE cat IS NULL) AS unresolved, count(*) FILTER (WHERE status NOT IN ('Passed','Failed','Skipped')) AS incomplete
  FROM c GROUP BY artifact_id),
p AS (SELECT facts.*, a.format, u.* EXCLUDE (policy_id) FROM facts LEFT JOIN a USING (artifact_id) LEFT JOIN u ON u.policy_id = a.policy_id),
v AS (
  SELECT artifact_id, 1 AS k, 'scanIncomplete' AS rule, 'High' AS severity FROM p WHERE unresolved>0
  UNION ALL SELECT artifact_id, 2, 'scanIncomplete','High' FROM p WHERE incomplete>0
  UNION ALL SELECT artifact_id, 3, 'blockMalware','Critical' FROM p WHERE coalesce(block_malware,true) AND malware_status='Detected'
  UNION ALL SELECT artifact_id, 4, 'blockSecrets','High' FROM p WHERE coalesce(block_secrets,true) AND secrets_status='Detected'
  UNION ALL SELECT artifact_id, 5, 'blockUnsafeModel','Critical' FROM p WHERE coalesce(block_unsafe_model,true) AND model_critical>0
  UNION ALL SELECT artifact_id, 6, 'maxCriticalCVEs','Critical' FROM p WHERE cve_critical>max_critical_cves
  UNION ALL SELECT artifact_id, 7, 'maxHighCVEs','High' FROM p WHERE cve_high>max_high_cves
  UNION ALL SELECT artifact_id, 8, 'requireSignature','High' FROM p WHERE coalesce(require_signature,false) AND NOT signature_verified
  UNION ALL SELECT artifact_id, 9, 'requireProvenance','Medium' FROM p WHERE coalesce(require_provenance,false) AND NOT provenance_checked
  UNION ALL SELECT artifact_id, 10, 'requireSBOM','Medium' FROM p WHERE coalesce(require_sbom,false) AND NOT sbom_ran
  UNION ALL SELECT artifact_id, 11, 'requireAIBOM','Medium' FROM p WHERE coalesce(require_aibom,false) AND NOT aibom_generated
  UNION ALL SELECT artifact_id, 12, 'blockModelDrift','High' FROM p WHERE coalesce(block_model_drift,false) AND drift_critical+drift_high>0
  UNION ALL SELECT artifact_id, 13, 'allowedFormats','High' FROM p WHERE format<>'' AND allowed_formats IS NOT NULL
     AND NOT list_contains(list_transform(allowed_formats, lambda x: lower(x)), lower(format))
  UNION ALL SELECT artifact_id, 14, 'blockedFormats','Critical' FROM p WHERE format<>'' AND blocked_formats IS NOT NULL
     AND list_contains(list_transform(blocked_formats, lambda x: lower(x)), lower(format))),
w AS (SELECT DISTINCT artifact_id, unnest(rules) AS rule FROM e WHERE expires_at IS NULL OR """
    + NOW_SQL
    + """ <= expires_at),
vv AS (SELECT v.*, w.rule IS NOT NULL AS waived FROM v LEFT JOIN w ON v.artifact_id=w.artifact_id AND v.rule=w.rule),
g AS (SELECT artifact_id, count(*) FILTER (WHERE NOT waived) AS enforced, count(*) FILTER (WHERE waived) AS waivedn,
       count(*) FILTER (WHERE NOT waived AND severity='Critical') AS crit,
       coalesce(sum(CASE severity WHEN 'Critical' THEN 25 WHEN 'High' THEN 10 ELSE 3 END) FILTER (WHERE NOT waived),0) AS pts
      FROM vv GROUP BY artifact_id),
j AS (SELECT p.*, coalesce(g.enforced,0) AS enforced, coalesce(g.waivedn,0) AS waivedn, coalesce(crit,0) AS crit, coalesce(pts,0) AS pts
      FROM p LEFT JOIN g USING (artifact_id))
"""
)
VERDICT_SQL = "CASE WHEN enforced=0 THEN 'Approved' WHEN crit>0 THEN 'Quarantined' ELSE 'ReviewRequired' END"
RISK_SQL = """CASE WHEN malware_status='Detected' THEN 100 ELSE least(100,
  20*cve_critical+8*cve_high+2*cve_medium+cve_low+35*model_critical+12*model_high+3*model_medium
  +CASE WHEN secrets_status='Detected' THEN 40 ELSE 0 END
  +CASE WHEN provenance_checked AND NOT signature_verified THEN 10 ELSE 0 END+pts) END"""


def _gate_sql(body: str) -> str:
    base = T.with_ctes("", r=T.SCANNER_RESULTS, a=T.ARTIFACTS, u=T.RULES, e=T.EXCEPTIONS)
    return base.rstrip() + ", " + GATE_STEPS + body


QUERIES = {
    "severity_normalize": lambda s, d: severity_scalars(s, d).select("ord", "severity"),
    "severity_rank": lambda s, d: severity_scalars(s, d).select("ord", "rank"),
    "sarif_level": lambda s, d: severity_scalars(s, d).select("ord", "level"),
    "security_score": lambda s, d: severity_scalars(s, d).select("ord", "score"),
    "rule_name": lambda s, d: severity_scalars(s, d).select("ord", "rule_name"),
    "finding_tags": lambda s, d: severity_scalars(s, d).select("ord", "tags"),
    "tally": lambda s, d: O.tally(O.normalized(_findings(s, d))),
    "finalize_counts": lambda s, d: O.finalize_counts(_findings(s, d)),
    "cap_top500": cap_top500,
    "merge_findings": merge,
    "worst_severity": lambda s, d: O.worst_severity(O.normalized(_findings(s, d))),
    "exit_class": lambda s, d: O.exit_class(O.normalized(_findings(s, d))),
    "fail_on": lambda s, d: O.fail_on(O.normalized(_findings(s, d)), "high"),
    "scanner_results": results_from_findings,
    "findings_sorted": lambda s, d: O.findings_sorted(O.normalized(_findings(s, d))).select(
        "artifact_id", "severity_rank", "id", "ord"
    ),
    "status_for": lambda s, d: _results(s, d).select(
        "artifact_id", "scanner", "findings", S.status_for(F.col("findings")).alias("derived_status")
    ),
    "gate_categorize": lambda s, d: G.unresolved_scanners(_results(s, d)),
    "gate_severity_max": lambda s, d: G.severity_max(_results(s, d)),
    "gate_drift_sum": lambda s, d: G.facts(_results(s, d)).select("artifact_id", *[f"drift_{x}" for x in SEV]),
    "gate_status": lambda s, d: G.facts(_results(s, d)).select("artifact_id", "malware_status", "secrets_status"),
    "gate_provenance": lambda s, d: G.facts(_results(s, d)).select(
        "artifact_id", "signature_verified", "provenance_checked"
    ),
    "gate_produced": lambda s, d: G.facts(_results(s, d)).select("artifact_id", "aibom_generated"),
    "gate_incomplete": lambda s, d: G.incomplete_scanners(_results(s, d)),
    "gate_violations": lambda s, d: G.violations(*_gate_inputs(s, d)[:3]).select("artifact_id", "rule", "severity"),
    "gate_format_lists": lambda s, d: G.violations(*_gate_inputs(s, d)[:3])
    .filter(F.col("rule").isin("allowedFormats", "blockedFormats"))
    .select("artifact_id", "rule", "severity", "message"),
    "gate_waivers": lambda s, d: G.violations(*_gate_inputs(s, d)).select("artifact_id", "rule", "severity", "waived"),
    "gate_risk_score": lambda s, d: G.evaluate(*_gate_inputs(s, d)).select("artifact_id", "risk_score"),
    "gate_verdict": lambda s, d: G.evaluate(*_gate_inputs(s, d)).select("artifact_id", "verdict"),
    "scan_exit": lambda s, d: G.evaluate(*_gate_inputs(s, d)).select("artifact_id", "verdict", "exit_code"),
    "gate_evaluate": lambda s, d: G.evaluate(*_gate_inputs(s, d)),
}

EXIT_SQL = "CASE WHEN worst='Critical' THEN 3 WHEN worst IN ('High','Medium') THEN 2 ELSE 0 END"
WORST = T.with_ctes(
    "", f=T.FINDINGS
) + f", n AS ({NORMED}), w AS (SELECT artifact_id, arg_min(severity, rnk) AS worst, min(rnk) AS r FROM n GROUP BY artifact_id) "


def _norm_sql(body: str) -> str:
    return T.with_ctes("", f=T.FINDINGS) + f", n AS ({NORMED}) " + body


EVAL_COLUMNS = (
    [f"{p}_{s}" for p in ("cve", "model", "aibom") for s in SEV] + [f"drift_{s}" for s in SEV]
)
EVALUATE_BODY = (
    f"SELECT artifact_id, {VERDICT_SQL} AS verdict, CAST({RISK_SQL} AS INTEGER) AS risk_score, enforced AS enforced_violations, "
    f"waivedn AS waived_violations, malware_status, secrets_status, signature_verified, provenance_checked, aibom_generated, "
    f"{', '.join(EVAL_COLUMNS)}, CASE WHEN enforced=0 THEN 0 WHEN crit>0 THEN 3 ELSE 2 END AS exit_code FROM j"
)

ORACLES = {
    "severity_normalize": _norm_sql("SELECT ord, severity FROM n"),
    "severity_rank": _norm_sql("SELECT ord, rnk AS rank FROM n"),
    "sarif_level": _norm_sql(
        "SELECT ord, CASE WHEN rnk<=1 THEN 'error' WHEN rnk=2 THEN 'warning' WHEN rnk=3 THEN 'note' ELSE 'none' END AS level FROM n"
    ),
    "security_score": _norm_sql(
        "SELECT ord, CASE rnk WHEN 0 THEN '9.5' WHEN 1 THEN '7.5' WHEN 2 THEN '5.0' WHEN 3 THEN '2.0' ELSE '0.0' END AS score FROM n"
    ),
    "rule_name": _norm_sql("SELECT ord, 'Ar' || split_part(id,'-',2) || split_part(id,'-',3) AS rule_name FROM n"),
    "finding_tags": _norm_sql(
        "SELECT ord, 'fleetrisk|' || category || CASE WHEN category='drift' THEN '|supply-chain' ELSE '' END AS tags FROM n"
    ),
    "tally": _norm_sql(
        f"SELECT artifact_id, {_count('', 'category<>' + chr(39) + 'drift' + chr(39))}, "
        f"{_count('drift_', 'category=' + chr(39) + 'drift' + chr(39))} FROM n GROUP BY artifact_id"
    ),
    "finalize_counts": _norm_sql(
        f"SELECT artifact_id, scanner, count(*) AS findings, {_count()}, "
        f"{_count('drift_', 'category=' + chr(39) + 'drift' + chr(39))} FROM n GROUP BY artifact_id, scanner"
    ),
    "cap_top500": _norm_sql(
        "SELECT scanner, ord, id, severity FROM n QUALIFY row_number() OVER (PARTITION BY scanner ORDER BY rnk, ord) <= 500"
    ),
    "merge_findings": _norm_sql(
        """, pr AS (SELECT artifact_id, id, location, ord, category FROM n WHERE category='drift'),
        wk AS (SELECT artifact_id, 'AR-F-' || split_part(id,'-',3) AS id, location, ord, category FROM n WHERE category<>'drift')
        SELECT * FROM pr UNION ALL
        (SELECT * FROM wk WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.artifact_id=wk.artifact_id AND pr.id=wk.id AND pr.location=wk.location)
         QUALIFY row_number() OVER (PARTITION BY artifact_id, id, location ORDER BY ord)=1)"""
    ).replace(") , pr", "), pr"),
    "worst_severity": WORST + "SELECT artifact_id, worst FROM w",
    "exit_class": WORST + f"SELECT artifact_id, worst, {EXIT_SQL} AS exit_code FROM w",
    "fail_on": WORST + f"SELECT artifact_id, worst, CASE WHEN r<=1 THEN {EXIT_SQL} ELSE 0 END AS exit_code FROM w",
    "scanner_results": _norm_sql(
        f"SELECT artifact_id, scanner, 'Failed' AS status, count(*) AS findings, "
        f"{_count('', 'category<>' + chr(39) + 'drift' + chr(39))}, "
        f"{_count('drift_', 'category=' + chr(39) + 'drift' + chr(39))} FROM n GROUP BY artifact_id, scanner"
    ),
    "findings_sorted": _norm_sql("SELECT artifact_id, rnk AS severity_rank, id, ord FROM n ORDER BY 1,2,3,4"),
    "status_for": T.with_ctes(
        "SELECT artifact_id, scanner, findings, CASE WHEN findings>0 THEN 'Failed' ELSE 'Passed' END AS derived_status FROM r",
        r=T.SCANNER_RESULTS,
    ),
    "gate_categorize": T.with_ctes(
        f"SELECT DISTINCT artifact_id, scanner FROM r WHERE {CATEGORY} IS NULL", r=T.SCANNER_RESULTS
    ),
    "gate_severity_max": T.with_ctes(
        f"SELECT artifact_id, {CATEGORY} AS category, {', '.join(f'max({s}) AS {s}' for s in SEV)} FROM r "
        f"WHERE {CATEGORY} IS NOT NULL GROUP BY 1, 2",
        r=T.SCANNER_RESULTS,
    ),
    "gate_drift_sum": _gate_sql(f"SELECT artifact_id, {', '.join(f'drift_{s}' for s in SEV)} FROM facts"),
    "gate_status": _gate_sql("SELECT artifact_id, malware_status, secrets_status FROM facts"),
    "gate_provenance": _gate_sql("SELECT artifact_id, signature_verified, provenance_checked FROM facts"),
    "gate_produced": _gate_sql("SELECT artifact_id, aibom_generated FROM facts"),
    "gate_incomplete": T.with_ctes(
        "SELECT artifact_id, scanner, count(*) AS runs FROM r WHERE status NOT IN ('Passed','Failed','Skipped') GROUP BY 1,2",
        r=T.SCANNER_RESULTS,
    ),
    "gate_violations": _gate_sql("SELECT artifact_id, rule, severity FROM v"),
    "gate_format_lists": _gate_sql(
        """SELECT v.artifact_id, rule, severity, 'format ' || format ||
        CASE rule WHEN 'allowedFormats' THEN ' is not on the allowed list' ELSE ' is on the blocked list' END AS message
        FROM v JOIN p USING (artifact_id) WHERE rule IN ('allowedFormats','blockedFormats')"""
    ),
    "gate_waivers": _gate_sql("SELECT artifact_id, rule, severity, waived FROM vv"),
    "gate_risk_score": _gate_sql(f"SELECT artifact_id, CAST({RISK_SQL} AS INTEGER) AS risk_score FROM j"),
    "gate_verdict": _gate_sql(f"SELECT artifact_id, {VERDICT_SQL} AS verdict FROM j"),
    "scan_exit": _gate_sql(
        f"SELECT artifact_id, {VERDICT_SQL} AS verdict, CASE WHEN enforced=0 THEN 0 WHEN crit>0 THEN 3 ELSE 2 END AS exit_code FROM j"
    ),
    "gate_evaluate": _gate_sql(EVALUATE_BODY),
}
