"""Verification, manifests, coverage, controls, provenance and fetch planning."""

import random
from datetime import datetime

import pytest

from fleetrisk.functions import controls as K
from fleetrisk.operators import compliance as C
from fleetrisk.operators import coverage as CV
from fleetrisk.operators import fetch as FE
from fleetrisk.operators import provenance as PR
from fleetrisk.operators import verify as VF
from pyspark.sql import functions as F

NOW = datetime(2026, 6, 1)


# --- verification -------------------------------------------------------------------------------------------
FILE = "artifact_id string, path string, sha256 string, sha384 string, size bigint"


def test_file_checks(spark):
    docs = spark.createDataFrame([("d", "a"), ("e", "a")], "doc_id string, artifact_id string")
    claimed = spark.createDataFrame(
        [("d", "same", "AB", "", 5), ("d", "changed", "AB", None, 5), ("d", "strong", "xx", "cd", 0), ("d", "nodigest", "", "", 0), ("d", "gone", "ab", "", 1), ("d", "size", "ab", "", 9)],
        "doc_id string, path string, sha256 string, sha384 string, size bigint",
    )
    files = spark.createDataFrame(
        [("a", "same", "ab", "", 5), ("a", "changed", "ba", "", 5), ("a", "strong", "yy", "CD", 1), ("a", "nodigest", "ab", "", 1), ("a", "size", "ab", "", 8), ("a", "extra", "0123456789abcdef0", "", 1)],
        FILE,
    )
    got = VF.verify_files(docs, claimed, files)
    rows = {r.subject: r for r in got.filter("doc_id = 'd'").collect()}
    assert {s: r.outcome for s, r in rows.items()} == {
        "file same (SHA-256)": "pass", "file changed (SHA-256)": "fail", "file strong (SHA-384)": "pass", "file nodigest": "uncheckable",
        "file gone": "fail", "file size (SHA-256)": "pass", "file size (size)": "fail", "file extra": "extra",
    }
    assert rows["file extra"].measured == "0123456789abcdef…"
    # a document without files describes none of them
    assert got.filter("doc_id = 'e'").select("outcome").distinct().collect()[0][0] == "extra"
    order = [r.outcome for r in VF.sorted_checks(got.filter("doc_id = 'd'")).collect()]
    assert order == ["fail", "fail", "fail", "extra", "uncheckable", "pass", "pass", "pass"]


def test_identity_properties_and_summary(spark):
    docs = spark.createDataFrame(
        [("d", "a", "Model", "1", {"architecture": "LLAMA", "dtype": "F16", "measuredParameters": "7", "unknown": "x", "quantization": ""}),
         ("n", "a", None, "1", {}), ("m", "gone", "x", None, None)],
        "doc_id string, artifact_id string, model_name string, version string, properties map<string,string>",
    )
    models = spark.createDataFrame([("a", "model", "2", "llama", None, None, 7)], "artifact_id string, name string, version string, architecture string, quantization string, dtype string, measured_parameters bigint")
    identity = sorted((r.doc_id, r.subject, r.outcome) for r in VF.verify_identity(docs, models).collect())
    assert identity == [("d", "model name", "pass"), ("d", "model version", "fail"), ("m", "model name", "fail"), ("n", "model version", "fail")]
    properties = sorted((r.subject, r.outcome) for r in VF.verify_properties(docs, models).collect())
    assert properties == [("architecture", "pass"), ("dtype", "uncheckable"), ("measuredParameters", "pass")]
    checks = spark.createDataFrame([("p", "a", "pass"), ("p", "a", "uncheckable"), ("u", "a", "uncheckable"), ("x", "a", "pass"), ("x", "a", "extra")], "doc_id string, artifact_id string, outcome string")
    assert {r.doc_id: r.verified for r in VF.verify_summary(checks).collect()} == {"p": True, "u": False, "x": False}


def test_manifest_failures(spark):
    manifests = spark.createDataFrame([("ok", 1), ("old", 2), ("none", 1)], "manifest_id string, format_version int")
    entry = "manifest_id string, path string, size bigint, sha256 string, sha512 string"
    entries = spark.createDataFrame([("ok", "a", 1, "x", "y"), ("ok", "b", 1, "x", "y"), ("ok", "lost", 1, "x", "y")], entry)
    members = spark.createDataFrame(
        [("ok", 0, "early", 1, "x", "y", "file"), ("ok", 1, "manifest.json", 9, "", "", "file"), ("ok", 2, "a", 1, "x", "y", "file"), ("ok", 3, "b", 2, "x", "z", "file"),
         ("ok", 4, "../c", 1, "x", "y", "file"), ("ok", 5, "dir", 0, "", "", "dir"), ("ok", 6, "dev", 0, "", "", "char"), ("old", 0, "manifest.json", 1, "", "", "file")],
        "manifest_id string, ord int, name string, size bigint, sha256 string, sha512 string, kind string",
    )
    got = sorted((r.manifest_id, r.name, r.failure) for r in VF.manifest_verify(manifests, entries, members).collect())
    assert got == [
        ("none", "", "no manifest"), ("ok", "../c", "not listed"), ("ok", "../c", "traversal"), ("ok", "b", "digest differs"), ("ok", "b", "size differs"),
        ("ok", "dev", "not a regular file"), ("ok", "dev", "not listed"), ("ok", "early", "before the manifest"), ("ok", "early", "not listed"),
        ("ok", "lost", "missing"), ("old", "manifest.json", "unsupported version"),
    ]


# --- coverage -------------------------------------------------------------------------------------------------
def test_coverage(spark):
    artifacts = spark.createDataFrame([("a", "m", "dev", "x@y.z", "gguf", "tpl"), ("b", None, "dev", None, "safetensors", "tpl")], "artifact_id string, name string, author string, organization string, format string, chat_template string")
    files = spark.createDataFrame(
        [("a", "w.gguf", 1, "s256", "s384", "", "primary"), ("a", "s1", 1, "", "", "", "shard"), ("b", "x.safetensors", 1, "s", "", "s512", "primary"), ("b", "part", 1, "", "", "", "shard")],
        "artifact_id string, path string, size bigint, sha256 string, sha384 string, sha512 string, role string",
    )
    licenses = spark.createDataFrame([("a", 0, "first", ""), ("a", 1, "mit", "MIT"), ("b", 0, "terms", "")], "artifact_id string, ord int, raw string, spdx_id string")
    profile = CV.profile(artifacts, files, licenses)
    rows = {(r.artifact_id, r.standard, r.name): r for r in CV.coverage(profile).collect()}
    hash_row = "Hash value of the deployable component (SHA-512)"
    assert rows[("a", "bsi", hash_row)].status == "absent" and rows[("b", "bsi", hash_row)].value == "s512"
    # contact needs an address, not a bare name
    assert rows[("a", "bsi", "Component creator")].value == "x@y.z" and rows[("b", "bsi", "Component creator")].status == "absent"
    assert rows[("a", "g7", "Model license")].value == "MIT" and rows[("b", "g7", "Model license")].value == "terms"
    assert rows[("a", "bsi", "Original licences")].value == "first"
    assert rows[("a", "bsi", "Executable property")].value == "executable" and rows[("b", "bsi", "Executable property")].value == "non-executable"
    assert rows[("a", "g7", "Model training properties")].status == "out-of-scope"
    assert rows[("a", "cisa-2026", "Component Dependency Relationship")].value == "model contains 1 shard(s)"
    report = {(r.artifact_id, r.standard): (r.populated + r.absent + r.out_of_scope) for r in CV.coverage_report(CV.coverage(profile)).collect()}
    assert {s: report[("a", s)] for s in CV.STANDARDS} == {"g7": 24, "cert-in": 19, "bsi": 18, "cisa-2026": 23}
    structured = {r.path: r.structured for r in CV.bsi_properties(profile, files).collect()}
    assert structured == {"w.gguf": "structured", "s1": "unstructured", "x.safetensors": "structured", "part": "structured"}
    with pytest.raises(ValueError):
        CV.coverage(profile, ["nobody"])


def test_joined_names_are_whole(spark):
    rows = spark.createDataFrame([("a", i, f"n{i}") for i in range(1500)], "artifact_id string, ord int, name string")
    row = CV.joined_names(rows.repartition(5), "name", "ord", "names").first()
    assert row.names == ", ".join(f"n{i}" for i in range(1500)) and row.names_count == 1500


# --- controls ---------------------------------------------------------------------------------------------------
EVIDENCE = [
    "scan_complete", "risk_scored", "security_scanned", "secrets_scanned", "sbom_generated", "aibom_generated", "signature_verified",
    "inventoried", "continuous_monitoring", "admission_enforcing", "residual_risks_documented", "bias_evaluated",
]


def evidence(spark, rows):
    schema = "artifact_id string, profile string, verdict string, policy_ref string, " + ", ".join(f"{e} boolean" for e in EVIDENCE)
    return spark.createDataFrame([(a, p, v, r, *[(e in on) for e in EVIDENCE]) for a, p, v, r, on in rows], schema)


def test_catalogues():
    rmf, sp = K.catalog(K.AI_RMF), K.catalog(K.SP_800_53)
    count = lambda rows: [sum(r["automation"] == a for r in rows) for a in ("Full", "Partial", "None")]
    assert count(rmf) == [9, 24, 39] and count(sp) == [7, 11, 3]
    assert len({r["category"] for r in rmf}) == 19
    for row in rmf + sp:
        assert set(row["evidence"]) <= set(K.EVIDENCE_KINDS)
        assert row["automation"] == "None" or row["evidence"]
    levels = [t[2] for t in K.TECHNIQUES.values()]
    assert [levels.count(x) for x in ("Detected", "Partial", "OutOfScope")] == [5, 6, 12]
    named = {m for t in K.TECHNIQUES.values() for m in t[4]}
    assert named == set(K.MITIGATIONS)
    with pytest.raises(ValueError):
        K.catalog("nobody")


def test_control_status(spark):
    ev = evidence(spark, [("all", "p", "Approved", "pol", EVIDENCE), ("broken", "p", "Approved", "pol", EVIDENCE[1:]), ("bare", "q", "Unknown", "", ["scan_complete"])])
    late, soon = datetime(2027, 1, 1), datetime(2026, 1, 1)
    attest = spark.createDataFrame(
        [
            ("all", "GOVERN 1.1", 0, "s", "me", late), ("all", "MAP 2.1", 0, "s", "me", None), ("all", "GOVERN 2.1", 0, "s", "  ", late),
            ("all", "GOVERN 2.2", 0, "s", "me", soon), ("all", "GOVERN 3.1", 0, "s", "me", late), ("all", "GOVERN 3.1", 1, "", "me", late),
            ("bare", "MAP 2.1", 0, "s", "me", late),
        ],
        "artifact_id string, control_id string, ord int, statement string, attested_by string, expires_at timestamp",
    )
    scope = spark.createDataFrame([("p", "GOVERN 5.1", "no"), ("p", "GOVERN 5.2", " ")], "profile string, control_id string, justification string")
    got = {(r.artifact_id, r.control_id): r for r in C.control_status(ev, K.AI_RMF, attest, scope, NOW).collect()}
    status = lambda a, c: got[(a, c)].status
    assert status("all", "GOVERN 1.1") == "Attested"
    assert status("all", "GOVERN 1.6") == "Satisfied" and status("all", "GOVERN 1.2") == "PartiallySatisfied"
    assert status("all", "MAP 2.1") == "Satisfied" and got[("all", "MAP 2.1")].warning == "no expiry"
    assert status("all", "GOVERN 2.1") == "AttestationRequired" and got[("all", "GOVERN 2.1")].warning == "no named attester"
    assert status("all", "GOVERN 2.2") == "AttestationRequired" and got[("all", "GOVERN 2.2")].warning == "expired"
    # the last attestation of a control is the one that counts
    assert status("all", "GOVERN 3.1") == "AttestationRequired" and got[("all", "GOVERN 3.1")].warning == "no statement"
    assert status("all", "GOVERN 5.1") == "NotApplicable" and status("all", "GOVERN 5.2") == "AttestationRequired"
    # nothing counts as evidence while the scan is incomplete
    assert status("broken", "GOVERN 1.6") == "NotSatisfied" and got[("broken", "MEASURE 3.2")].evidence_missing == ["coverage-gap"]
    # an attestation does not replace missing technical evidence
    assert status("bare", "MAP 2.1") == "NotSatisfied" and status("bare", "MEASURE 3.2") == "PartiallySatisfied"
    statuses = C.control_status(ev, K.AI_RMF, attest, scope, NOW)
    totals = {r.artifact_id: r for r in C.assessment(statuses).collect()}
    assert totals["all"].not_applicable == 1 and not totals["all"].conformant
    assert sum(totals["all"][c] for c in ("satisfied", "partially_satisfied", "not_satisfied", "attested", "attestation_required", "not_applicable")) == 72
    openness = [r.openness for r in C.open_controls(statuses.filter("artifact_id = 'all'")).collect()]
    assert openness == sorted(openness, reverse=True) and openness
    traits = [r.trait for r in C.unmeasured_traits(ev.filter("artifact_id = 'all'")).orderBy("ord").collect()]
    assert traits == ["Valid and Reliable", "Safe", "Explainable and Interpretable"]


def test_natural_order_and_totals(spark):
    table = C.controls(spark)
    order = [r.control_id for r in C.natural_order(table.filter(F.col("framework") == K.AI_RMF).repartition(3)).collect()]
    assert order == list(K.AI_RMF_CONTROLS) and order.index("MEASURE 2.9") + 1 == order.index("MEASURE 2.10")
    assert [r.control_id for r in C.natural_order(table.filter(F.col("framework") == K.SP_800_53).repartition(3)).collect()] == list(K.SP_800_53_CONTROLS)
    total = C.catalog_coverage(table).filter("function IS NULL").orderBy("framework").collect()
    assert [(r.total, r.full, r.partial, r.none) for r in total] == [(72, 9, 24, 39), (21, 7, 11, 3)]
    assert {r.coverage: r.techniques for r in C.atlas_coverage(spark).collect()} == {"Detected": 5, "Partial": 6, "OutOfScope": 12}


# --- provenance ---------------------------------------------------------------------------------------------------
def test_signatures_and_publishers(spark):
    names = ["w.bin", "w.bin.sig", "w.bin.pem", "w.bin.crt", "d/MODEL.SIG", "v.sigstore.json", ".bundle", "z.cosign.bundle", "lone.crt", "n.sig"]
    files = spark.createDataFrame([("a", n) for n in names], "artifact_id string, path string")
    got = {r.path: (r.kind, r.target, r.cert_path) for r in PR.signatures(files).collect()}
    assert got == {
        "w.bin.sig": ("detached", "w.bin", "w.bin.crt"), "d/MODEL.SIG": ("manifest", None, None), "v.sigstore.json": ("bundle", "v", None),
        "z.cosign.bundle": ("bundle", "z.cosign", None), "n.sig": ("detached", "n", None),
    }
    assert sorted(r.path for r in PR.plain_files(files).collect()) == [".bundle", "lone.crt", "w.bin", "w.bin.pem"]
    pubs = spark.createDataFrame(
        [("any", "", "", "", "", None), ("hf", "HF", "iss", "sub*", "", ["hf://o/", "hf://p"]), ("s3", "", "", "", "PEM", ["s3://"])],
        "name string, display_name string, issuer string, subject string, public_key string, uri_prefixes array<string>",
    )
    uris = spark.createDataFrame([("1", "hf://o/m"), ("2", "hf://px"), ("3", "s3://b"), ("4", "HF://o/m")], "artifact_id string, uri string")
    scope = sorted((r.artifact_id, r.publisher, r.keyless, r.label) for r in PR.publisher_scope(uris, pubs).collect())
    hf, anyone = ("hf", True, "HF (sub* via iss)"), ("any", False, "any")
    assert scope == [("1", *anyone), ("1", *hf), ("2", *anyone), ("2", *hf), ("3", *anyone), ("3", "s3", False, "s3 (public key)"), ("4", *anyone)]
    pairs = spark.createDataFrame([("a*", "abc"), ("a*", "xa"), ("a", "a"), ("a", "ab")], "s string, san string")
    assert [r[0] for r in pairs.select(PR.subject_matches(F.col("s"), F.col("san"))).collect()] == [True, False, True, False]


def test_provenance_rollup(spark):
    cases = {"none": [], "good": ["w.bin", "w.bin.sig"], "part": ["w.bin", "w.bin.sig", "x.pkl"], "safe": ["q.safetensors", "q.sig"], "fail": ["w.bin", "w.bin.sig"]}
    files = spark.createDataFrame([(a, p) for a, ps in cases.items() for p in ps], "artifact_id string, path string")
    artifacts = spark.createDataFrame([(a,) for a in cases], "artifact_id string")
    outcomes = spark.createDataFrame(
        [("good", "s", True, False, "zed", ["w.bin"]), ("good", "t", True, False, "amy", []), ("part", "s", True, False, "z", ["w.bin"]), ("safe", "s", True, False, "", []), ("fail", "s", True, True, "z", ["w.bin"])],
        "artifact_id string, sig_path string, valid boolean, failed boolean, signer string, covered array<string>",
    )
    got = {r.artifact_id: (r.verified, r.signer, r.finding_id) for r in PR.rollup(artifacts, files, outcomes).collect()}
    assert got == {
        "none": (False, None, "AR-PROV-001"), "good": (True, "amy", "AR-PROV-000"), "part": (False, "z", "AR-PROV-005"), "safe": (True, None, "AR-PROV-000"), "fail": (False, "z", None),
    }
    unconfigured = {r.artifact_id: r.finding_id for r in PR.rollup(artifacts, files, outcomes, configured=False).collect()}
    assert unconfigured["good"] == "AR-PROV-006" and unconfigured["none"] == "AR-PROV-001"


def test_fetch_plan_against_a_loop(spark):
    import random

    rng = random.Random(3)
    exts = [".bin", ".gguf", ".json", ".npy", ".py"]
    files = {a: [(f"f{i:03d}{rng.choice(exts)}", rng.randrange(1, 120)) for i in range(n)] for a, n in (("hot", 90), ("b", 12), ("c", 1))}
    limits = dict(max_files=50, max_file_bytes=100, max_total_bytes=900, header_bytes=10)
    want = {}
    for a, entries in files.items():
        total = 0
        for k, (path, size) in enumerate(sorted(entries)):
            if k >= limits["max_files"]:
                want[(a, path)] = "skipped"
            elif path.endswith((".gguf", ".npy")):
                total += min(size, limits["header_bytes"])
                want[(a, path)] = "header"
            elif size <= limits["max_file_bytes"] and total + size <= limits["max_total_bytes"]:
                total += size
                want[(a, path)] = "whole"
            else:
                want[(a, path)] = "skipped"
    df = spark.createDataFrame([(a, p, s) for a, e in files.items() for p, s in e], "artifact_id string, path string, size bigint").repartition(5)
    plan = FE.fetch_plan(df, limits)
    assert {(r.artifact_id, r.path): r.action for r in plan.collect()} == want
    coverage = {r.artifact_id: r for r in FE.fetch_coverage(plan).collect()}
    assert coverage["hot"].whole + coverage["hot"].header_only + coverage["hot"].skipped == 90 and not coverage["hot"].complete


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_prefix_join_against_all_pairs(spark, ranges):
    """Nested prefixes over borders, a URI that is a third of all rows, texts beyond ASCII and prefixes of nothing."""
    rng = random.Random(ranges)
    part = lambda: rng.choice(["a", "b", "ab", "é", "日", "/"])
    uris = [(f"m{i}", "".join(part() for _ in range(rng.randrange(0, 7)))) for i in range(400)] + [(f"h{i}", "ab/hot") for i in range(200)]
    prefixes = sorted({"".join(part() for _ in range(rng.randrange(0, 5))) for _ in range(60)} | {"", "ab/hot", "ab/hot/x"})
    left = spark.createDataFrame(uris, "artifact_id string, uri string").repartition(3)
    right = spark.createDataFrame([(p, (p, i)) for i, p in enumerate(prefixes)] + [("a", ("again", -1))], "prefix string, entry struct<p: string, i: int>")
    got = sorted((r.artifact_id, r.uri, r.entry.p, r.entry.i) for r in PR.prefix_join(left, right, ranges).collect())
    rows = [(p, p, i) for i, p in enumerate(prefixes)] + [("a", "again", -1)]
    assert got == sorted((a, u, name, i) for a, u in uris for p, name, i in rows if u.startswith(p))
    assert PR.prefix_join(left.filter("false"), right, ranges).count() == 0 and PR.prefix_join(left, right.filter("false"), ranges).count() == 0


def test_fetch_plan_without_a_file_limit(spark):
    rng = random.Random(1)
    files = [("a", f"f{i:05d}" + rng.choice([".bin", ".safetensors", ""]), rng.randrange(400)) for i in range(3000)] + [("b", "x", 10), ("b", "y", None)]
    limits = {"max_files": None, "max_file_bytes": 300, "max_total_bytes": 50_000, "header_bytes": 20}
    got = {(r.artifact_id, r.path): (r.action, r.reason) for r in FE.fetch_plan(spark.createDataFrame(files, "artifact_id string, path string, size long").repartition(5), limits).collect()}
    total, want = {}, {}
    for a, path, size in sorted(files):
        size, used = size or 0, total.get(a, 0)
        if path.endswith(".safetensors"):
            want[a, path], total[a] = ("header", None), used + min(size, 20)
        elif size > 300:
            want[a, path] = ("skipped", "file too large and without a readable header")
        elif used + size > 50_000:
            want[a, path] = ("skipped", "total fetch limit reached")
        else:
            want[a, path], total[a] = ("whole", None), used + size
    assert got == want and ("skipped", "total fetch limit reached") in want.values()
    limits["max_files"] = 5000
    assert {(r.artifact_id, r.path): (r.action, r.reason) for r in FE.fetch_plan(spark.createDataFrame(files, "artifact_id string, path string, size long"), limits).collect()} == want
