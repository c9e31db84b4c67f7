"""Policy gate and findings operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetrisk.functions import values as V
from fleetrisk.operators import findings as O
from fleetrisk.operators import gate as G

NOW = datetime(2026, 6, 1)
SEV = ["critical", "high", "medium", "low", "unknown"]
SCHEMA = (
    "artifact_id string, scanner string, status string, findings int, "
    + ", ".join(f"{p}{s} int" for p in ("", "drift_") for s in SEV)
    + ", produced boolean"
)


def result(artifact, scanner, status="Passed", findings=0, counts=(0, 0, 0, 0, 0), drift=(0, 0, 0, 0, 0), produced=None):
    return (artifact, scanner, status, findings, *counts, *drift, produced)


def judge(spark, rows, rules=None, exceptions=None, formats=None):
    results = spark.createDataFrame(rows, SCHEMA)
    artifacts = policy = None
    if rules is not None:
        names = list(G.RULE_DEFAULTS)
        schema = "policy_id string, " + ", ".join(f"{n} {t}" for n, t in G.RULE_DEFAULTS.items())
        policy = spark.createDataFrame([("p", *[rules.get(n) for n in names])], schema)
        ids = sorted({r[0] for r in rows})
        artifacts = spark.createDataFrame([(i, (formats or {}).get(i), "p") for i in ids], "artifact_id string, format string, policy_id string")
    waivers = None
    if exceptions is not None:
        waivers = spark.createDataFrame(exceptions, "artifact_id string, rules array<string>, reason string, expires_at timestamp")
    verdicts = {r.artifact_id: r for r in G.evaluate(results, artifacts, policy, waivers, NOW).collect()}
    broken = {}
    for r in G.violations(results, artifacts, policy, waivers, NOW).orderBy("artifact_id", "position").collect():
        broken.setdefault(r.artifact_id, []).append((r.rule, r.severity, r.waived))
    return verdicts, broken


CLEAN = ["clamav", "trivy", "trufflehog", "model-inspector"]


def test_default_policy(spark):
    rows = [result("clean", s) for s in CLEAN]
    rows += [result("malware", "clamav", "Failed", 1, (1, 0, 0, 0, 0))]
    rows += [result("pending", "clamav", "Running")]
    rows += [result("skipped", "clamav", "Skipped")]
    rows += [result("overlap", "trivy", "Failed", 3, (1, 2, 0, 0, 0)), result("overlap", "grype", "Failed", 5, (2, 1, 3, 4, 0))]
    rows += [result("stranger", "clamav"), result("stranger", "someone"), result("stranger", "someone")]
    rows += [result("secret", "trufflehog", "Failed", 2, (0, 2, 0, 0, 0))]
    rows += [result("unsafe", "model-inspector", "Failed", 1, (1, 0, 0, 0, 0))]
    rows += [result("drift", "aibom", "Failed", 1, drift=(0, 3, 0, 0, 0))]
    verdicts, broken = judge(spark, rows)
    assert (verdicts["clean"].verdict, verdicts["clean"].risk_score, verdicts["clean"].malware_status) == ("Approved", 0, "Clean")
    assert (verdicts["malware"].verdict, verdicts["malware"].risk_score) == ("Quarantined", 100)
    assert verdicts["pending"].verdict == "ReviewRequired" and verdicts["pending"].malware_status == "Unknown"
    assert verdicts["skipped"].verdict == "Approved" and verdicts["skipped"].malware_status == "Unknown"
    assert [verdicts["overlap"][f"cve_{s}"] for s in SEV] == [2, 2, 3, 4, 0]
    assert verdicts["overlap"].risk_score == 2 * 20 + 2 * 8 + 3 * 2 + 4
    assert broken["stranger"] == [("scanIncomplete", "High", False)]
    assert verdicts["secret"].risk_score == 40 + 10 and verdicts["secret"].verdict == "ReviewRequired"
    assert verdicts["unsafe"].verdict == "Quarantined" and verdicts["unsafe"].risk_score == 35 + 25
    # drift is counted and not gated by default
    assert verdicts["drift"].drift_high == 3 and verdicts["drift"].verdict == "Approved"


def test_incomplete_fires_twice(spark):
    _, broken = judge(spark, [result("a", "nobody", "Running")])
    assert broken["a"] == [("scanIncomplete", "High", False)] * 2


def test_policy_limits_and_switches(spark):
    rows = [
        result("a", "trivy", "Failed", 9, (1, 4, 0, 0, 0)),
        result("a", "clamav", "Failed", 1),
        result("a", "aibom", "Passed", produced=False, drift=(1, 0, 9, 9, 0)),
        result("a", "provenance", "Failed", 1),
        result("b", "trivy", "Passed", 0, (1, 3, 0, 0, 0)),
        result("b", "provenance", "Passed"),
        result("b", "syft", "Passed"),
        result("b", "aibom", "Passed", produced=True, drift=(0, 0, 5, 5, 0)),
    ]
    rules = dict(max_critical_cves=1, max_high_cves=3, block_malware=False, block_model_drift=True, require_signature=True,
                 require_provenance=True, require_sbom=True, require_aibom=True)
    verdicts, broken = judge(spark, rows, rules)
    assert broken["a"] == [
        ("maxHighCVEs", "High", False), ("requireSignature", "High", False), ("requireSBOM", "Medium", False),
        ("requireAIBOM", "Medium", False), ("blockModelDrift", "High", False),
    ]
    # malware sets the score even where the policy does not block it
    assert verdicts["a"].risk_score == 100 and verdicts["a"].verdict == "ReviewRequired"
    assert "b" not in broken and verdicts["b"].signature_verified and verdicts["b"].provenance_checked


def test_unverified_provenance_adds_risk(spark):
    verdicts, _ = judge(spark, [result("a", "provenance", "Failed", 0), result("b", "provenance", "Running")])
    assert verdicts["a"].risk_score == 10 and verdicts["b"].risk_score == 10  # b: one violation, nothing checked


def test_format_lists(spark):
    rows = [result(a, "clamav") for a in ("ok", "no", "bad", "none")]
    rules = dict(allowed_formats=["GGUF", "onnx", "pickle"], blocked_formats=["Pickle"])
    _, broken = judge(spark, rows, rules, formats={"ok": "gguf", "no": "h5", "bad": "PICKLE", "none": ""})
    assert broken == {"no": [("allowedFormats", "High", False)], "bad": [("blockedFormats", "Critical", False)]}


def test_waivers(spark):
    rows = [result(a, "trufflehog", "Failed", 1) for a in ("future", "past", "forever", "other", "moment")]
    waivers = [
        ("future", ["blockSecrets"], "r", datetime(2027, 1, 1)),
        ("past", ["blockSecrets"], "r", datetime(2026, 5, 31)),
        ("forever", ["x", "blockSecrets"], "r", None),
        ("other", ["blockMalware"], "r", None),
        ("moment", ["blockSecrets"], "r", NOW),
    ]
    verdicts, broken = judge(spark, rows, exceptions=waivers)
    approved = {a for a, v in verdicts.items() if v.verdict == "Approved"}
    assert approved == {"future", "forever", "moment"}
    assert broken["future"] == [("blockSecrets", "High", True)]
    assert verdicts["future"].risk_score == 40  # the violation no longer counts, the fact does


def test_fleet_wide_waiver(spark):
    rows = [result(a, "trufflehog", "Failed", 1) for a in ("a", "b")]
    verdicts, _ = judge(spark, rows, exceptions=[(None, ["blockSecrets"], "r", None)])
    assert {v.verdict for v in verdicts.values()} == {"Approved"}


def make_findings(spark, rows):
    return spark.createDataFrame(rows, "artifact_id string, scanner string, ord int, id string, title string, severity string, category string, location string, description string")


def test_cap_keeps_the_worst(spark):
    rows = [("a", "s", i, f"L{i}", "", "LOW", "", "", "") for i in range(500)] + [("a", "s", 500, "C", "", "CRITICAL", "", "", "")]
    rows += [("b", "s", i, f"M{i}", "", "medium", "", "", "") for i in range(750)]
    rows += [("c", "s", 0, "x", "", "odd", "DRIFT", "", "")]
    df = make_findings(spark, rows)
    kept = O.cap_detail(df)
    per = {r.artifact_id: r["count"] for r in kept.groupBy("artifact_id").count().collect()}
    assert per == {"a": 500, "b": 500, "c": 1}
    assert kept.filter("id = 'C'").count() == 1 and kept.filter("id = 'L499'").count() == 0
    counts = {r.artifact_id: r for r in O.finalize_counts(df).collect()}
    assert counts["b"].findings == 750 and counts["b"].medium == 750
    assert counts["c"].unknown == 1 and counts["c"].drift_unknown == 1


def test_merge_prefers_parsed(spark):
    parsed = make_findings(spark, [("a", "p", 0, "X", "p", "High", "", "f", ""), ("a", "p", 1, "X", "p", "High", "", "f", "")])
    walked = make_findings(
        spark,
        [("a", "w", 0, "X", "w", "High", "", "f", ""), ("a", "w", 1, "Y", "w1", "High", "", "f", ""), ("a", "w", 2, "Y", "w2", "High", "", "f", ""), ("b", "w", 0, "X", "w", "High", "", "f", "")],
    )
    got = sorted((r.artifact_id, r.id, r.title) for r in O.merge_findings(parsed, walked).collect())
    assert got == [("a", "X", "p"), ("a", "X", "p"), ("a", "Y", "w1"), ("b", "X", "w")]


def test_worst_and_thresholds(spark):
    df = make_findings(spark, [("a", "s", 0, "i", "", "Low", "", "", ""), ("a", "s", 1, "i", "", "High", "", "", ""), ("b", "s", 0, "i", "", "odd", "", "", "")])
    assert {r.artifact_id: (r.worst, r.exit_code) for r in O.exit_class(df).collect()} == {"a": ("High", 2), "b": ("Unknown", 0)}
    codes = {t: O.fail_on(df, t).filter("artifact_id = 'a'").first().exit_code for t in ("critical", "HIGH", "low", "never")}
    assert codes == {"critical": 0, "HIGH": 2, "low": 2, "never": 0}
    with pytest.raises(ValueError):
        O.fail_on(df, "urgent")


def test_scanner_results_keep_clean_scanners(spark):
    df = make_findings(spark, [("a", "s", 0, "i", "", "Low", "drift", "", "")])
    ran = spark.createDataFrame([("a", "s", True), ("a", "t", None)], "artifact_id string, scanner string, produced boolean")
    got = {r.scanner: (r.status, r.findings, r.low, r.drift_low, r.produced) for r in O.scanner_results(df, ran).collect()}
    assert got == {"s": ("Failed", 1, 0, 1, True), "t": ("Passed", 0, 0, 0, None)}


def test_order_of_input_rows_does_not_matter(spark):
    rows = [result(f"m{i % 7}", CLEAN[i % 4], ["Passed", "Failed", "Running"][i % 3], i % 2, (i % 2, i % 3, 0, 1, 0)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted(map(str, G.evaluate(df).collect()))
    again = sorted(map(str, G.evaluate(df.orderBy(F.rand(7)).repartition(11)).collect()))
    assert first == again


def test_every_rule_is_known():
    assert len(set(V.GATE_RULES)) == 13
