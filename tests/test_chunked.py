"""Files as byte ranges give the digests and findings of the whole files."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import chunked, detect, patterns
from fleetrisk.sources import chunks
from fleetrisk.sources.files import header_findings

FILES = "artifact_id string, path string, content binary"


def padded(rng, *parts, gap=90):
    fill = lambda: bytes(rng.choice(b"qzjv \n") for _ in range(rng.randrange(gap)))
    return b"".join(fill() + p for p in parts) + fill()


def sample():
    rng = random.Random(2)
    short = lambda s: b"\x8c" + bytes([len(s)]) + s
    rows = [
        ("inline.pkl", b"\x80\x03" + padded(rng, b"cos\nsystem\n", b"R")),
        ("stacked.bin", b"\x80\x04" + padded(rng, short(b"subprocess"), short(b"check_output"), b"\x93")),
        ("apart.pkl", b"\x80\x04" + padded(rng, short(b"posix"), short(b"system"))),
        ("plain.pkl", b"\x80\x04" + b"}" * 200),
        ("zip.pt", b"PK\x03\x04" + padded(rng, b"os\nsystem\n")),
        ("unknown.weights", b"\x80\x02" + padded(rng, b"builtins\neval\n")),
        ("code.py", padded(rng, b"os.system (cmd)", b"x = eval  \n (z)", b"requests.get(u)", b"torch.load(f)", b"base64.b64decode(s)", b"load_inline")),
        ("late.py", b"\n" * 333 + b"my_eval(z)\nexec\t(c) # \xc3\xa9\nexec(d)"),
        ("clean.py", b"print('eval')\n" * 40),
        ("named.h5", padded(rng, b'"module": "evil.before"', b'"class_name": "Lambda"', b'"module" : "evil.after"', b'"module":"keras.layers"')),
        ("true.hdf5", b"\x89HDF\r\n\x1a\n" + padded(rng, b'"class_name":"TFSMLayer"')),
        ("none.h5", b"x" * 300),
        ("m.keras!config.json", padded(rng, b'"module": "evil.first"', b'"class_name" : "Lambda"')),
        ("g.pb", padded(rng, b"PyFunc", b"SaveV2", b"ReadFile")),
        ("g.onnx", padded(rng, b"com.microsoft.PythonOp", b"external_data", b"../up")),
        ("a.npy", b"\x93NUMPY\x01\x00" + struct.pack("<H", 118) + b"{'descr': '|O'}".ljust(118) + b"1" * 99),
        ("b.npy", b"\x93NUMPY\x01\x00\x00\x00" + b"1" * 99),
        ("lib", b"\x7fELF" + b"\0" * 100),
        ("run", b"#!/bin/sh\n" + b"ls\n" * 50),
        ("c.json", json.dumps({"pad": "y" * 150, "trust_remote_code": True, "auto_map": {}, "net": {"_target_": "os.system"}}).encode()),
        ("bad.json", b'{"trust_remote_code": true' + b" " * 100),
        ("good.safetensors", struct.pack("<Q", 120) + b'{"w": {"dtype": "F32", "shape": [2]}}'.ljust(120) + b"\0" * 300),
        ("short.safetensors", b"\x01\x02"),
        ("long.safetensors", struct.pack("<Q", 1 << 40) + b"{}" * 80),
        ("text.safetensors", struct.pack("<Q", 90) + b"[]".ljust(90) + b"\0" * 90),
        ("empty.py", b""),
        ("empty.pkl", b""),
    ]
    return [("m", path, bytearray(content)) for path, content in rows] + [("n", "code.py", bytearray(b"eval(x)"))]


def as_rows(df):
    return sorted(tuple(r) for r in df.select("artifact_id", "id", "title", "severity", "category", "location", "description").collect())


@pytest.mark.parametrize("chunk, overlap", [(41, 64), (100, 64), (1 << 20, 64)])
def test_findings_and_digests_are_those_of_the_whole(spark, chunk, overlap):
    files = spark.createDataFrame(sample(), FILES)
    ranges = chunks.chunked(files, chunk, overlap)
    whole = detect.inspect_contents(files).unionByName(header_findings(files.withColumn("size", F.length("content").cast("bigint"))))
    assert as_rows(chunked.inspect_ranges(ranges)) == as_rows(whole)
    got = {(r.artifact_id, r.path): (r.size, r.sha256, r.sha384, r.sha512, r.complete) for r in chunked.digests(ranges).collect()}
    assert got == {(a, p): (len(c), *(hashlib.new(n, c).hexdigest() for n in ("sha256", "sha384", "sha512")), True) for a, p, c in sample()}


def test_missing_range_is_told(spark):
    ranges = chunks.chunked(spark.createDataFrame([("m", "w.pkl", bytearray(b"\x80\x04" + b"x" * 500))], FILES), 100, 64).filter("offset <> 200")
    assert ("AR-IO-003", "w.pkl") in {(r.id, r.location) for r in chunked.inspect_ranges(ranges).collect()}
    assert [r.complete for r in chunked.digests(ranges).collect()] == [False]


def test_large_json_is_told(spark):
    ranges = chunks.chunked(spark.createDataFrame([("m", "c.json", bytearray(b'{"auto_map": 1}'))], FILES), 4, 4)
    assert [r.id for r in chunked.inspect_ranges(ranges, whole_bytes=5).collect()] == ["AR-IO-002"]
    assert [r.id for r in chunked.inspect_ranges(ranges).collect()] == ["AR-HF-002"]


def test_no_rows(spark):
    ranges = chunks.chunked(spark.createDataFrame([], FILES))
    assert chunked.inspect_ranges(ranges).count() == 0 and chunked.digests(ranges).count() == 0


def test_source_reads_ranges_of_files(spark, tmp_path):
    rng = random.Random(4)
    want = {}
    for name, size in (("m/a.bin", 1000), ("m/sub/.hidden", 7), ("n/empty", 0), ("n/b.pkl", 301)):
        data = bytes(rng.randrange(256) for _ in range(size))
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
        want[tuple(name.split("/", 1))] = data
    ranges = chunks.read_ranges(spark, str(tmp_path), 100, 16)
    rows = ranges.collect()
    assert len(rows) == 10 + 1 + 1 + 4
    for r in rows:
        data = want[r.artifact_id, r.path]
        assert (r.size, r.content, r.before) == (len(data), data[r.offset : r.offset + 100], data[max(0, r.offset - 16) : r.offset])
    assert {(r.artifact_id, r.path): r.sha256 for r in chunked.digests(ranges).collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()}
    assert ranges.rdd.getNumPartitions() > 5


def test_automaton_finds_overlapping_patterns_across_slices():
    search = patterns.searcher([b"abc", b"bcd", b"c", b"\xff\x00"], 4)()
    assert search(b"xxabcd") == [0, 1, 2] and search(b"xxx\xff\x00") == [3] and search(b"") == []
