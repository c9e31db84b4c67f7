"""Measured facts, drift, coverage inputs and digests."""

import hashlib

from fleetrisk.operators import digest as DG
from fleetrisk.operators import drift as D
from fleetrisk.operators import measure as M
from fleetrisk.operators import skew
from pyspark.sql import functions as F


def test_parameters_saturate_and_dominant_type_breaks_ties(spark):
    tensors = spark.createDataFrame(
        [
            ("big", 0, "a", "F32", [2**62, 4]), ("big", 1, "b", "F32", [2**62]), ("big", 2, "c", "F32", [2**62]),
            ("tie", 0, "a", "F16", [4]), ("tie", 1, "b", "BF16", [2, 2]), ("tie", 2, "c", "BF16", [0]),
            ("none", 0, "a", "Q8", []),
        ],
        "artifact_id string, ord int, name string, dtype string, shape array<bigint>",
    )
    got = {r.artifact_id: (r.measured_parameters, r.tensor_count) for r in M.measured_parameters(tensors).collect()}
    assert got == {"big": (2**63 - 1, 3), "tie": (8, 3), "none": (0, 1)}
    # a zero dimension is skipped for the weighting, so BF16 weighs 4 + 1
    assert {r.artifact_id: r.dtype for r in M.dominant_dtype(tensors).collect()} == {"big": "F32", "tie": "BF16", "none": "Q8"}
    tied = tensors.filter("name <> 'c'")
    assert {r.artifact_id: r.dtype for r in M.dominant_dtype(tied).collect()}["tie"] == "BF16"


def test_tensor_inventory_keeps_the_true_count(spark):
    rows = [("hot", i, f"t{i:04d}", "F32", [1]) for i in range(300)] + [("cold", 0, "t", "F32", [1])]
    tensors = spark.createDataFrame(rows, "artifact_id string, ord int, name string, dtype string, shape array<bigint>")
    kept = M.tensor_inventory(tensors.repartition(7)).collect()
    hot = sorted((r.position, r.name, r.tensor_count) for r in kept if r.artifact_id == "hot")
    assert hot == [(i + 1, f"t{i:04d}", 300) for i in range(64)]


def test_lineage_is_numeric_and_falls_back(spark):
    rows = [("m", f"general.base_model.{i}.{k}", v) for i, k, v in [
        (10, "name", "ten"), (2, "organization", "org"), (2, "repo_url", "u"), (3, "name", ""), (4, "doi", "d"), (0, "organization", "o"), (0, "name", "n")]]
    rows += [("m", "general.base_model.count", "4"), ("m", "general.other.1.name", "x")]
    kv = spark.createDataFrame(rows, "artifact_id string, key string, value string")
    got = [tuple(r) for r in M.lineage_collect(kv).orderBy("ord").select("ord", "name", "url", "doi").collect()]
    assert got == [(0, "n", None, None), (2, "org", "u", None), (4, None, None, "d"), (10, "ten", None, None)]


def test_components(spark):
    files = spark.createDataFrame(
        [("g", f"m-0000{i}-of-00003.gguf") for i in (1, 2, 3)] + [("g", "other-00001-of-00001.gguf"), ("g", "readme"), ("o", "w.onnx"), ("o", "d.bin")],
        "artifact_id string, path string",
    )
    primary = M.primary_file(files)
    assert {r.artifact_id: r.primary_path for r in primary.collect()} == {"g": "m-00001-of-00003.gguf", "o": "w.onnx"}
    none = spark.createDataFrame([], "artifact_id string, path string")
    external = spark.createDataFrame([("o", "d.bin"), ("o", "../up"), ("o", "gone")], "artifact_id string, path string")
    got = sorted((r.artifact_id, r.path, r.role) for r in M.component_set(files, primary, none, external).collect())
    assert got == [
        ("g", "m-00001-of-00003.gguf", "primary"), ("g", "m-00002-of-00003.gguf", "shard"), ("g", "m-00003-of-00003.gguf", "shard"),
        ("o", "d.bin", "external-data"), ("o", "w.onnx", "primary"),
    ]
    peers = sorted((r.artifact_id, r.path) for r in M.peer_weights(files, primary).collect())
    assert peers == [("o", "d.bin")]


def drift_ids(spark, **columns):
    schema = ", ".join(f"{n} {D.INPUTS[n]}" for n in columns)
    df = spark.createDataFrame([("a", *columns.values())], f"artifact_id string, {schema}")
    return [r.id for r in D.drift(df).orderBy("ord").collect()]


def test_parameter_band_is_open(spark):
    rows = [("r80", "100", 80), ("r81", "100", 81), ("r124", "100", 124), ("r125", "100", 125), ("zero", "100", 0), ("label", "large", 50)]
    df = spark.createDataFrame(rows, "artifact_id string, declared_parameter_count string, measured_parameters bigint")
    assert sorted(r.artifact_id for r in D.drift(df).collect()) == ["r125", "r80"]
    # the second declared field is used when the first does not parse
    assert drift_ids(spark, declared_parameter_count="huge", size_label="8B", measured_parameters=3_000_000_000) == ["AR-DRIFT-007"]


def test_drift_rules(spark):
    assert drift_ids(spark, declared_architecture="LlamaForCausalLM", architecture="llama") == []
    assert drift_ids(spark, declared_architecture="Bert", architecture="llama") == ["AR-DRIFT-001"]
    assert drift_ids(spark, declared_architecture="Bert", format="gguf") == ["AR-DRIFT-005"]
    assert drift_ids(spark, declared_architecture="Bert", format="safetensors") == []
    assert drift_ids(spark, declared_dtype="bfloat16", dtype="BF16") == []
    assert drift_ids(spark, declared_dtype="float16", dtype="BF16") == ["AR-DRIFT-002"]
    assert drift_ids(spark, declared_quantization=" q4_k_m", quantization="Q4_K_M") == []
    assert drift_ids(spark, declared_quantization="gptq", quantization="Q4_K_M") == ["AR-DRIFT-003"]
    assert drift_ids(spark, declared_shards=3, present_shards=2) == ["AR-DRIFT-004"]
    assert drift_ids(spark, declared_shards=3, present_shards=3) == []
    assert drift_ids(spark, format="safetensors", peer_count=1, first_peer="a.bin") == ["AR-DRIFT-006"]
    assert drift_ids(spark, format="onnx", peer_count=1, first_peer="a.bin") == []


def test_digests_match_hashlib(spark):
    contents = {("a", "b"): b"x" * 1000, ("a", "a/z"): b"", ("a", "é"): b"\x00\xff", ("s", ""): b"single"}
    rows = [(a, p, bytearray(c)) for (a, p), c in contents.items()]
    files = spark.createDataFrame(rows, "artifact_id string, path string, content binary")
    digests = DG.file_digests(files)
    for r in digests.collect():
        c = contents[(r.artifact_id, r.path)]
        assert (r.size, r.sha256, r.sha384, r.sha512) == (len(c), hashlib.sha256(c).hexdigest(), hashlib.sha384(c).hexdigest(), hashlib.sha512(c).hexdigest())
    assert DG.file_digests(files, skip_hashing=True).filter("sha256 IS NULL AND size IS NOT NULL").count() == 4
    lines = "".join(f"{hashlib.sha256(contents[('a', p)]).hexdigest()} {p}\n" for p in sorted(["b", "a/z", "é"], key=str.encode))
    trees = {r.artifact_id: (r.tree_digest, r.total_size) for r in DG.tree_digest(digests).collect()}
    assert trees == {
        "a": ("sha256:" + hashlib.sha256(lines.encode()).hexdigest(), 1002),
        "s": ("sha256:" + hashlib.sha256(b"single").hexdigest(), 6),
    }


def test_tree_digest_streams_across_batches(spark):
    rows = [("hot", f"f{i:05d}", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)] + [(f"c{i}", "x", 1, "00") for i in range(20)]
    df = spark.createDataFrame(rows, "artifact_id string, path string, size bigint, sha256 string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = {r.artifact_id: r.tree_digest for r in DG.tree_digest(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    text = "".join(f"{h} {p}\n" for a, p, _, h in rows if a == "hot")
    assert got["hot"] == "sha256:" + hashlib.sha256(text.encode()).hexdigest() and len(got) == 21


def test_streamed_file_digests(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(b"q" * 100_000)
    listing = spark.createDataFrame([("a", "w.bin", (tmp_path / "w.bin").as_uri())], "artifact_id string, path string, uri string")
    row = DG.stream_digests(listing).first()
    assert (row["size"], row["sha512"]) == (100_000, hashlib.sha512(b"q" * 100_000).hexdigest())


def test_first_n_per_key_is_exact_on_a_hot_key(spark):
    rows = [("hot", i) for i in range(2000)] + [(f"k{i % 50}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    got = skew.first_n_per_key(df, ["k"], [F.col("v").desc()], 30).groupBy("k").agg(F.min("v").alias("lo"), F.count("*").alias("n"))
    hot = got.filter("k = 'hot'").first()
    assert (hot.lo, hot.n) == (1970, 30) and got.count() == 51


def test_tree_digest_keeps_files_without_an_artifact(spark):
    rows = [(None, "b", 1, "22"), (None, "a", 2, "11"), ("m", "x", 3, "33")]
    got = {r.artifact_id: (r.tree_digest, r.total_size) for r in DG.tree_digest(spark.createDataFrame(rows, "artifact_id string, path string, size long, sha256 string")).collect()}
    digest = lambda text: "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    assert got == {None: (digest("11 a\n22 b\n"), 3), "m": (digest("33 x\n"), 3)}
