"""Readers on files, documents there and back, and the composed plans."""

import json
from datetime import datetime

import pytest

from fleetrisk.operators import coverage as CV
from fleetrisk.operators import findings as O
from fleetrisk.plans import assess, scan, verification
from fleetrisk.session import cut_lineage
from fleetrisk.sinks import cyclonedx as CX
from fleetrisk.sinks import parts as J
from fleetrisk.sinks import sarif as SA
from fleetrisk.sinks import spdx as SP
from fleetrisk.sources import boms as B
from fleetrisk.sources import files as FI
from fleetrisk.sources import reports as R
from fleetrisk.sources import sidecars as SC
from pyspark.sql import functions as F

REPORT = "artifact_id string, scanner string, format string, body string"
NOW = "2026-01-01T00:00:00Z"


def st_file(header: bytes) -> bytes:
    return len(header).to_bytes(8, "little") + header


def test_files_from_disk(spark, tmp_path):
    root = tmp_path / "fleet"
    (root / "m1" / "sub").mkdir(parents=True)
    header = json.dumps({"__metadata__": {"format": "pt", "license": "mit"}, "b": {"dtype": "F16", "shape": [2, 3]}, "a": {"dtype": "F32", "shape": [4]}}).encode()
    (root / "m1" / "w.safetensors").write_bytes(st_file(header) + b"\0" * 28)
    (root / "m1" / "sub" / "x.pkl").write_bytes(b"\x80\x04N.")
    (root / "m2").mkdir()
    (root / "m2" / ".hidden").write_bytes(b"x")
    (root / "m2" / "m.gguf").write_bytes(b"GGUF....")
    files = FI.read_files(spark, str(root))
    assert sorted((r.artifact_id, r.path, r["size"]) for r in files.select("artifact_id", "path", "size").collect()) == [
        ("m1", "sub/x.pkl", 4), ("m1", "w.safetensors", 8 + len(header) + 28), ("m2", "m.gguf", 8),
    ]
    listing = files.select("artifact_id", "path", "size").unionByName(spark.createDataFrame([("m2", ".hidden", 1)], "artifact_id string, path string, size bigint"))
    kept = FI.file_inventory(listing, 1, hide_dotfiles=True)
    assert sorted((r.artifact_id, r.path, r.truncated) for r in kept.collect()) == [("m1", "sub/x.pkl", True), ("m2", "m.gguf", False)]
    assert sorted((r.artifact_id, r.format) for r in FI.format_detect(files).collect()) == [("m1", "safetensors"), ("m2", "gguf")]
    listing = files.filter("path = 'w.safetensors'").select("artifact_id", "path", "uri")
    tensors, kv, found = FI.header_safetensors(FI.read_headers(listing))
    assert [tuple(r) for r in tensors.orderBy("ord").select("ord", "name", "dtype", "shape").collect()] == [(0, "a", "F32", [4]), (1, "b", "F16", [2, 3])]
    assert sorted(tuple(r)[1:] for r in kv.collect()) == [("__metadata__.format", "pt"), ("__metadata__.license", "mit")]
    assert found.count() == 0


def test_header_problems(spark):
    good = st_file(b"{}")
    rows = [("short", b"123"), ("zero", b"\0" * 9), ("long", (2**60).to_bytes(8, "little") + b"{}"), ("huge", b"\xff" * 8 + b"{}"), ("text", st_file(b"nope")), ("list", st_file(b"[1]")), ("ok", good)]
    df = spark.createDataFrame([(n, n + ".safetensors", bytearray(c), len(c)) for n, c in rows], "artifact_id string, path string, content binary, size bigint")
    strict = {r.artifact_id: r.id for r in FI.header_safetensors(df)[2].collect()}
    assert strict == {"short": "AR-ST-001", "zero": "AR-ST-002", "long": "AR-ST-002", "huge": "AR-ST-002", "text": "AR-ST-003", "list": "AR-ST-003"}
    walk = {r.artifact_id: r.id for r in FI.header_findings(df).collect()}
    assert walk == {**strict, "zero": "AR-ST-003"}


def test_reports(spark):
    long = "é" * 300
    bodies = [
        ("blank", "trivy-json", " \n"), ("none", "clamav", None), ("bad", "grype-json", "{"), ("odd", "yaml", "x"), ("list", "native", "[]"),
        ("clam", "clamav", "/a: Eicar FOUND\nok: OK\nno separator FOUND\n"),
        ("grype", "grype-json", json.dumps({"matches": [{"vulnerability": {"id": "G", "severity": "Negligible", "description": long}, "artifact": {"name": "n", "locations": []}}]})),
        ("hog", "trufflehog-json", 'x\n{"DetectorName":"AWS","Verified":true,"SourceMetadata":{"Data":{"Filesystem":{"file":"f","line":3}}}}\n{"a":\n'),
        ("own", "native", json.dumps({"findings": [{"id": "D", "severity": "high", "category": "Drift"}], "generated": False})),
        ("old", "native-legacy", '{"findings": []}'), ("sbom", "syft-spdx", '{"packages": []}'),
    ]
    reports = spark.createDataFrame([(a, "s", f, b) for a, f, b in bodies], REPORT)
    found, status = R.ingest(reports)
    states = {r.artifact_id: (r.state, r.produced) for r in status.collect()}
    assert {a for a, (s, _) in states.items() if s == "error"} == {"bad", "odd", "list"} and states["none"][0] == "absent"
    assert states["own"] == ("parsed", False) and states["old"] == ("parsed", None) and states["blank"][0] == "parsed"
    rows = {r.artifact_id: r for r in found.collect()}
    assert set(rows) == {"clam", "grype", "hog", "own"}
    assert (rows["clam"].id, rows["clam"].location) == ("Eicar", "/a") and (rows["hog"].severity, rows["hog"].location) == ("Critical", "f:3")
    assert rows["grype"].severity == "Low" and rows["grype"].location == "n"
    assert rows["grype"].description == "é" * 256 + "..."
    judged = assess.judge_reports(reports)
    verdicts = {r.artifact_id: r for r in judged["results"].collect()}
    assert verdicts["bad"].status == verdicts["none"].status == "Incomplete" and verdicts["sbom"].status == "Passed"
    assert verdicts["own"].drift_high == 1 and verdicts["own"].high == 1


def test_sidecars(spark):
    card = "---\nlicense: 'mit'\nbase_model:\n  - a/b\n- c\ntags:\n- x\ninfo:\n  nested: 1\nlibrary_name: lib\n---\nlicense: no"
    cards = spark.createDataFrame([("m", card), ("none", "no front matter"), ("open", "---\na: b")], "artifact_id string, body string")
    got = SC.sidecar_card(cards).collect()
    assert [(r.artifact_id, r.license, r.base_model, r.library, r.task) for r in got] == [("m", "mit", "a/b,c", "lib", None)]
    known = spark.createDataFrame([("m", "base_model", "c")], "artifact_id string, kind string, name string")
    refs = [(r.name, r.url) for r in SC.card_references(SC.sidecar_card(cards), known).collect()]
    assert refs == [("a/b", "https://huggingface.co/a/b")]
    configs = spark.createDataFrame([("a", '{"architectures":["X"],"num_parameters":7000000000}'), ("b", '{"model_type":"y","num_parameters":"8B"}'), ("c", "[]")], "artifact_id string, body string")
    declared = {r.artifact_id: (r.declared_architecture, r.declared_parameter_count) for r in SC.sidecar_config(configs).collect()}
    assert declared == {"a": ("X", "7000000000"), "b": ("y", "8B")}


@pytest.fixture(scope="module")
def fleet(spark):
    artifacts = spark.createDataFrame(
        [("a", "Model \"A\"", "1.0", "org", "https://hf.co/o/r", "llama", "gguf", 10, "F16", [("x", "F32", [1, -1])]), ("b", "", None, None, None, None, "onnx", None, None, None)],
        "artifact_id string, name string, version string, organization string, repo_url string, architecture string, format string, measured_parameters bigint, dtype string, inputs array<struct<name:string,dtype:string,shape:array<bigint>>>",
    )
    files = spark.createDataFrame(
        [("a", "w.gguf", 5, "ab" * 32, "cd" * 48, "", "primary"), ("a", "s\\1.gguf", 6, "ef" * 32, "", "", "shard"), ("b", "m.onnx", 1, "", "", "", "primary")],
        "artifact_id string, path string, size bigint, sha256 string, sha384 string, sha512 string, role string",
    )
    licenses = spark.createDataFrame([("a", 0, "mit", "MIT")], "artifact_id string, ord int, raw string, spdx_id string")
    datasets = spark.createDataFrame([("a", 0, "ds one"), ("a", 1, "ds two")], "artifact_id string, ord int, name string")
    domains = spark.createDataFrame([("b", "com.x")], "artifact_id string, domain string")
    found = spark.createDataFrame(
        [("a", "s", 0, "AR-B-1", "t", "Low", "model", "w.gguf", "d"), ("a", "s", 1, "AR-A-1", "t", "Critical", "drift", "", ""), ("a", "s", 2, "AR-B-1", "t2", "High", "model", "x\\y", "d2")],
        "artifact_id string, scanner string, ord int, id string, title string, severity string, category string, location string, description string",
    )
    profiles = cut_lineage(CV.profile(artifacts, files, licenses, datasets, domains, found))
    return dict(profiles=profiles, artifacts=artifacts, files=files, licenses=licenses, datasets=datasets, domains=domains, findings=found)


def test_cyclonedx_round_trip(spark, fleet, tmp_path):
    f = fleet
    nodes = CX.cyclonedx_nodes(f["profiles"], f["files"], f["licenses"], f["datasets"], f["domains"], f["findings"])
    J.write_documents(CX.emit_cyclonedx(f["profiles"], nodes, NOW, "1.7"), nodes, str(tmp_path / "boms"))
    documents = spark.read.json(str(tmp_path / "boms" / "documents"))
    texts = {r.artifact_id: json.loads(r.document) for r in documents.collect()}
    a = texts["a"]
    assert a["specVersion"] == "1.7" and a["metadata"]["component"]["purl"] == "pkg:huggingface/o/r"
    assert [c["name"] for c in a["components"]] == ["s\\1.gguf"] and [v["id"] for v in a["vulnerabilities"]] == ["AR-B-1", "AR-A-1", "AR-B-1"]
    assert a["metadata"]["component"]["modelCard"]["modelParameters"]["inputs"] == [{"format": "F32[1,?]"}]
    assert texts["b"]["components"][0]["type"] == "library" and "vulnerabilities" not in texts["b"]
    with pytest.raises(ValueError):
        CX.emit_cyclonedx(f["profiles"], nodes, NOW, "1.5")
    checked = verification.verify_documents(
        documents.select(F.concat(F.lit("doc-"), "artifact_id").alias("doc_id"), "artifact_id", F.col("document").alias("body")),
        f["artifacts"].withColumn("quantization", F.lit(None).cast("string")), f["files"],
    )
    summary = {r.artifact_id: r for r in checked["summary"].collect()}
    assert summary["a"].verified and summary["a"].failed == 0 and checked["refused"].count() == 0
    # name, version, two digests, architecture, dtype and parameters
    assert summary["a"].passed == 7
    # changed bytes and an extra file are both noticed
    tampered = f["files"].withColumn("sha384", F.when(F.col("path") == "w.gguf", "ee").otherwise(F.col("sha384")))
    extra = tampered.unionByName(spark.createDataFrame([("a", "new", 1, "", "", "", "shard")], f["files"].schema))
    body = documents.select("artifact_id", F.col("artifact_id").alias("doc_id"), F.col("document").alias("body"))
    outcome = verification.verify_documents(body, f["artifacts"].withColumn("quantization", F.lit(None).cast("string")), extra)
    row = {r.artifact_id: r for r in outcome["summary"].collect()}["a"]
    assert not row.verified and row.failed == 1 and row.not_in_document == 1


def test_spdx_round_trip(spark, fleet, tmp_path):
    f = fleet
    refs = spark.createDataFrame([("a", 0, "o/base", "u", None)], "artifact_id string, ord int, name string, url string, doi string")
    nodes = SP.spdx_nodes(f["profiles"], f["files"], f["datasets"], f["findings"], references=refs)
    J.write_documents(SP.emit_spdx(f["profiles"], nodes, NOW), nodes, str(tmp_path / "boms"))
    documents = spark.read.json(str(tmp_path / "boms" / "documents"))
    graph = json.loads(documents.filter("artifact_id = 'a'").first().document)["@graph"]
    kinds = [n["type"] for n in graph]
    assert kinds.count("software_File") == 1 and kinds.count("dataset_DatasetPackage") == 2 and kinds.count("ai_AIPackage") == 2
    model = next(n for n in graph if n["type"] == "ai_AIPackage")
    assert model["ai_limitation"].split("\n")[0].startswith("[Critical] AR-A-1")
    relations = {n["relationshipType"]: len(n["to"]) for n in graph if n["type"] == "Relationship"}
    assert relations == {"contains": 1, "trainedOn": 2, "descendantOf": 1, "hasDeclaredLicense": 1}
    assert len({n["spdxId"] for n in graph if "spdxId" in n}) == len(graph) - 1
    body = documents.select(F.col("artifact_id").alias("doc_id"), "artifact_id", F.col("document").alias("body"))
    claims, files = B.bom_read_spdx(B.bom_detect(body))
    a = claims.filter("artifact_id = 'a'").first()
    assert a.model_name == 'Model "A"' and a.version == "1.0" and a["properties"]["architecture"] == "llama"
    assert sorted((r.path, bool(r.sha384)) for r in files.filter("doc_id = 'a'").collect()) == [("s\\1.gguf", False), ("w.gguf", True)]


def test_sarif(spark, fleet):
    f = fleet
    log = SA.emit_sarif(f["profiles"], SA.sarif_nodes(f["profiles"], f["findings"]), NOW)
    run = json.loads(log.filter("artifact_id = 'a'").first().document)["runs"][0]
    assert [(r["id"], r["defaultConfiguration"]["level"]) for r in run["tool"]["driver"]["rules"]] == [("AR-A-1", "error"), ("AR-B-1", "error")]
    results = [(r["ruleId"], r["level"], r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for r in run["results"]]
    assert results == [("AR-A-1", "error", "w.gguf"), ("AR-B-1", "error", "x/y"), ("AR-B-1", "note", "w.gguf")]
    assert run["tool"]["driver"]["rules"][0]["properties"]["tags"] == ["fleetrisk", "drift", "supply-chain"]
    assert json.loads(log.filter("artifact_id = 'b'").first().document)["runs"][0]["results"] == []


def test_documents_are_whole_at_every_size(spark):
    findings = spark.range(60_000).selectExpr(
        "'a' AS artifact_id", "concat('AR-', id % 7) AS id", "'t' AS title", "'High' AS severity", "'model' AS category",
        "concat('f', id) AS location", "'d' AS description", "id AS ord",
    )
    profiles = spark.createDataFrame([("a", "n", None, None, None, None)], "artifact_id string, name string, primary_path string, primary_sha256 string, primary_sha384 string, primary_sha512 string")
    log = SA.emit_sarif(profiles, SA.sarif_nodes(profiles, findings), NOW).first()
    results = json.loads(log.document)["runs"][0]["results"]
    assert not log.large and len({r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results}) == 60_000


def test_large_documents_are_written_as_nodes(spark, fleet, tmp_path):
    f = fleet
    nodes = SA.sarif_nodes(f["profiles"], f["findings"])
    documents = SA.emit_sarif(f["profiles"], nodes, NOW, limit=3)
    flags = {r.artifact_id: (r.large, len(json.loads(r.document)["runs"][0]["results"])) for r in documents.collect()}
    assert flags == {"a": (True, 0), "b": (False, 0)}
    J.write_documents(documents, nodes, str(tmp_path / "out"), limit=3)
    written = spark.read.json(str(tmp_path / "out" / "nodes"))
    assert written.count() == nodes.count() == 5
    assert spark.read.json(str(tmp_path / "out" / "documents")).count() == 2


def test_scan_plan(spark):
    def file(artifact, path, content):
        return (artifact, path, bytearray(content), len(content))

    header = json.dumps({"w": {"dtype": "F32", "shape": [1000, 1000]}}).encode()
    files = spark.createDataFrame(
        [file("bad", "w.pkl", b"cos\nsystem\n."), file("bad", "config.json", b'{"trust_remote_code": true}'), file("ok", "w.safetensors", st_file(header)), file("drift", "w.safetensors", st_file(header)), file("hurt", "w.safetensors", b"12")],
        "artifact_id string, path string, content binary, size bigint",
    )
    ids = ["bad", "ok", "drift", "hurt"]
    artifacts = spark.createDataFrame([(i, "safetensors", "w.safetensors", "p") for i in ids], "artifact_id string, format string, primary_path string, policy_id string")
    licenses = spark.createDataFrame([(i, 0, "mit", "MIT") for i in ids], "artifact_id string, ord int, raw string, spdx_id string")
    declared = spark.createDataFrame([("drift", "8B", "config.json"), ("ok", "1M", "config.json")], "artifact_id string, declared_parameter_count string, declared_source string")
    tensors, kv, _ = FI.header_safetensors(files.filter("path = 'w.safetensors'"))
    fleet = scan.Fleet(artifacts, files, raw_kv=kv, tensors=tensors.select("artifact_id", "ord", "name", "dtype", "shape"), licenses=licenses, declared=declared)
    out = scan.scan(fleet, now=datetime(2026, 1, 1))
    found = sorted((r.artifact_id, r.id) for r in out["findings"].collect())
    # the parser and the walk both see the broken header; it is reported once
    assert found == [("bad", "AR-HF-001"), ("bad", "AR-PICKLE-001"), ("drift", "AR-DRIFT-007"), ("hurt", "AR-ST-001")]
    verdicts = {r.artifact_id: r.verdict for r in out["verdicts"].collect()}
    assert verdicts == {"bad": "Quarantined", "ok": "Approved", "drift": "Approved", "hurt": "Approved"}
    assert out["results"].count() == 8
    assert O.FINDING_COLUMNS[0] == "artifact_id"
