"""Content made to switch a scanner off: bytes that are not UTF-8, padding, huge sizes, reports of another shape."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import detect as D
from fleetrisk.operators import gate as G
from fleetrisk.operators import measure as M
from fleetrisk.plans.assess import judge_reports
from fleetrisk.sources import files as FI
from fleetrisk.sources import reports as R

FILES = "artifact_id string, path string, size bigint, content binary"


def files(spark, *rows):
    return spark.createDataFrame([("a", path, len(content), bytearray(content)) for path, content in rows], FILES)


def test_bytes_that_are_not_utf8_hide_nothing(spark):
    header = b'{"__metadata__":{"k":"\xff"}}'
    df = files(
        spark,
        ("m.py", b"\xff\xfe\nx = eval(y)\n"),
        ("config.json", b'{"trust_remote_code": true, "note": "\xff", "_target_": "os.system"}'),
        ("w.safetensors", len(header).to_bytes(8, "little") + header),
        ("p.pkl", b"\x80\x04cos\nsystem\n."),
    )
    found = {(r.id, r.location) for r in D.inspect_contents(df).collect()}
    assert {("AR-PICKLE-001", "p.pkl"), ("AR-HF-001", "config.json"), ("AR-CONFIG-001", "config.json")} <= found
    assert any(i.startswith("AR-PY-") and where == "m.py:2" for i, where in found)
    assert FI.header_findings(df).count() == 0
    _, lifted, _ = FI.header_safetensors(df.filter("path = 'w.safetensors'"))
    assert [tuple(r) for r in lifted.collect()] == [("a", "__metadata__.k", "�")]


def test_padding_hides_nothing(spark):
    padded = json.dumps({"trust_remote_code": True, "_target_": "os.system", "pad": "x" * (9 << 20)}).encode()
    found = {r.id for r in D.inspect_contents(files(spark, ("config.json", padded))).collect()}
    assert found >= {"AR-HF-001", "AR-CONFIG-001"}


def test_archive_sizes_near_the_end_of_int64(spark):
    rows = [("a", "x.zip", "zip", i, f"m{i}", False, 2**62, 1) for i in range(1, 6)]
    entries = spark.createDataFrame(rows, "artifact_id string, archive string, kind string, ord bigint, name string, is_link boolean, size bigint, compressed bigint")
    assert {r.id for r in D.detect_archive(entries).collect()} == {"AR-ARCHIVE-005", "AR-ARCHIVE-006"}


@pytest.mark.parametrize(
    "fmt, body",
    [
        ("trivy-json", '{"Results":{"x":1}}'),
        ("trivy-json", '{"Results":[{"Vulnerabilities":"no"}]}'),
        ("trivy-json", '{"Results":[1]}'),
        ("grype-json", '{"matches":"no"}'),
        ("grype-json", '{"matches":[{"artifact":{"locations":{}}}]}'),
        ("native", '{"findings":{}}'),
    ],
)
def test_reports_of_another_shape_are_not_clean(spark, fmt, body):
    reports = spark.createDataFrame([("a", "s", fmt, body)], "artifact_id string, scanner string, format string, body string")
    assert [(r.state, r.detail) for r in R.report_status(reports).collect()] == [("error", "malformed report")]
    assert judge_reports(reports)["results"].first().status == "Incomplete"


@pytest.mark.parametrize("fmt, body", [("trivy-json", "{}"), ("trivy-json", '{"Results":null,"More":[1]}'), ("grype-json", '{"matches":[]}'), ("native", '{"findings":null,"generated":true}')])
def test_absent_and_null_members_are_well_formed(spark, fmt, body):
    reports = spark.createDataFrame([("a", "s", fmt, body)], "artifact_id string, scanner string, format string, body string")
    assert [r.state for r in R.report_status(reports).collect()] == ["parsed"]


def test_an_artifact_that_no_scanner_has_seen_is_judged(spark):
    results = spark.createDataFrame(
        [("seen", "trivy", "Passed", None, *[0] * 11)],
        "artifact_id string, scanner string, status string, produced boolean, findings int, "
        + ", ".join(f"{p}{s} int" for p in ("", "drift_") for s in ("critical", "high", "medium", "low", "unknown")),
    )
    artifacts = spark.createDataFrame([("seen", "gguf", "p"), ("never", "gguf", "p"), ("free", None, None)], "artifact_id string, format string, policy_id string")
    rules = spark.createDataFrame([("p", True)], "policy_id string, require_sbom boolean")
    got = {r.artifact_id: r for r in G.evaluate(results, artifacts, rules, None, datetime(2026, 1, 1)).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"seen": "ReviewRequired", "never": "ReviewRequired", "free": "Approved"}
    assert got["never"].malware_status == "Unknown" and got["never"].cve_critical == 0 and not got["never"].signature_verified
    assert {r.artifact_id for r in G.violations(results, artifacts, rules).filter("rule = 'requireSBOM'").collect()} == {"seen", "never"}


def test_peers_lie_in_the_folder_of_the_primary_file(spark):
    names = ["w.safetensors", "x.bin", "old/x.bin", *[f"a{i:05d}.txt" for i in range(5000)]]
    listing = spark.createDataFrame([("a", n) for n in names], "artifact_id string, path string")
    primary = spark.createDataFrame([("a", "w.safetensors")], "artifact_id string, primary_path string")
    assert [r.path for r in M.peer_weights(listing, primary).collect()] == ["x.bin"]
    assert FI.file_inventory(listing).filter(~F.col("truncated")).count() == len(names)
