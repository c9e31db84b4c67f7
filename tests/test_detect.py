"""Detectors: what must be found, and what must stay clean."""

import json
import pickle
import re

import pytest

from pyspark.sql import functions as F

from fleetrisk.functions import values as V
from fleetrisk.operators import detect as D
from fleetrisk.sources import files as FI


def table(spark, rows):
    data = [("a", path, bytearray(content), len(content)) for path, content in rows]
    return spark.createDataFrame(data, "artifact_id string, path string, content binary, size bigint")


def found(df):
    return sorted((r.location, r.id, r.severity) for r in df.collect())


class Evil:
    def __reduce__(self):
        import os

        return os.system, ("true",)


def test_pickles(spark):
    streams = {f"p{p}.pkl": pickle.dumps(Evil(), protocol=p) for p in range(6)}
    rows = list(streams.items()) + [
        ("list.pkl", pickle.dumps([1, 2], protocol=4)),
        ("zeros.pkl", b"\x80\x04N."),
        ("raw.bin", bytes(range(256)) * 4),
        ("prose.bin", b"posix system are words"),
        ("empty.pkl", b""),
        ("torch.pt", b"PK\x03\x04rest"),
        ("hidden", b"\x80\x04\x8c\x05posix\x8c\x06system\x93"),
        ("hidden.npy", b"\x80\x02cos\nsystem\n...."),
        ("long.pkl", b"\x80\x04X\x05\x00\x00\x00posixX\x06\x00\x00\x00system\x93"),
        ("hub.pkl", b"\x80\x02ctorch\nhub.load\n."),
    ]
    files = table(spark, rows)
    critical = {r[0] for r in found(D.detect_dangerous_import(files))}
    # every protocol names posix.system, in one of the two encodings
    assert critical == set(streams) | {"hidden", "hidden.npy", "long.pkl", "hub.pkl"}
    rest = found(D.detect_pickle_fallback(files))
    assert ("list.pkl", "AR-PICKLE-003", "Low") in rest or ("list.pkl", "AR-PICKLE-004", "Medium") in rest
    assert ("zeros.pkl", "AR-PICKLE-004", "Medium") in rest
    assert ("torch.pt", "AR-PICKLE-002", "Medium") in rest
    assert not {r[0] for r in rest} & (critical | {"raw.bin", "prose.bin", "empty.pkl"})


def test_python_rules_report_first_match_by_line(spark):
    code = b"import os\n\nos.system ('a')\nos.system('b')\nretrieval(x)\nx = eval(y)\n"
    files = table(spark, [("m.py", code), ("clean.py", b"# os.system is dangerous\nmodel.eval_mode\nmy_exec(1)\n"), ("m.txt", code)])
    assert found(D.detect_python_rules(files)) == [("m.py:3", "AR-PY-001", "Critical"), ("m.py:6", "AR-PY-002", "High")]
    late = b"x\n" * 50_000 + b"yaml.load(f)\ntorch.utils.cpp_extension"
    assert found(D.detect_python_rules(table(spark, [("l.py", late)]))) == [("l.py", "AR-PY-006", "High"), ("l.py:50001", "AR-PY-004", "High")]


def test_config_flags(spark):
    rows = [
        ("on.json", b'{"trust_remote_code": true, "auto_map": null}'),
        ("text.json", b'{"trust_remote_code": "true"}'),
        ("list.json", b'[{"trust_remote_code": true}]'),
        ("broken.json", b'{"trust_remote_code": true'),
        ("twice.json", b'{"trust_remote_code": false, "trust_remote_code": true}'),
    ]
    assert found(D.detect_config_flags(table(spark, rows))) == [
        ("on.json", "AR-HF-001", "Critical"), ("on.json", "AR-HF-002", "High"), ("twice.json", "AR-HF-001", "Critical"),
    ]


def brute_targets(node, where=""):
    hits = []
    if isinstance(node, dict):
        hits += [(where, k, node[k]) for k in V.INSTANTIATION_KEYS if isinstance(node.get(k), str) and node[k]]
        for k, v in node.items():
            hits += brute_targets(v, f"{where}.{k}" if where else k)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            hits += brute_targets(v, f"{where}.{i}" if where else str(i))
    return hits


def test_instantiation_at_any_depth(spark):
    deep = {"_target_": "a.subprocess.run"}
    for i in range(25):
        deep = {"k": deep, "callable": f"pkg.mod{i}"} if i % 2 else [deep, 1]
    docs = [
        {"_target_": "torch.nn.Linear", "x": [{"class_path": "os.system"}, {"target_": ""}]},
        {"callable": 5, "n": {"_recursive_target_": "evaluate"}},
        {"w": deep, "_target_": "sys.os.path"},
        {"a": 1},
    ]
    texts = [json.dumps(d).encode() for d in docs]
    # an escaped key is the same key
    texts[0] = texts[0].replace(b"_target_", b"\\u005ftarget_")
    files = table(spark, [(f"c{i}.json", t) for i, t in enumerate(texts)] + [("list.json", b'[{"_target_": "os.x"}]')])
    got = {(r.location, r.description, r.severity) for r in D.detect_instantiation(files).collect()}
    want = set()
    for i, d in enumerate(docs):
        for where, key, target in brute_targets(d):
            low = target.lower()
            bad = any(low.startswith(t) or "." + t in low for t in V.DANGEROUS_TARGETS)
            want.add((f"c{i}.json at {where}" if where else f"c{i}.json", f"{key} names {target}", "Critical" if bad else "Low"))
    assert got == want and len(want) > 12


def test_keras_graphs_magic_and_arrays(spark):
    rows = [
        ("lambda.h5", V.MAGIC_HDF5 + b'..{"class_name": "Lambda"}'),
        ("word.h5", V.MAGIC_HDF5 + b"Lambda layers are described here"),
        ("renamed.hdf5", b"not hdf5"),
        ("m.keras!config.json", b'{"class_name" : "TFSMLayer", "module": "keras.layers", "module" : "os"}'),
        ("hidden", V.MAGIC_HDF5 + b'"class_name":"Lambda"'),
        ("g.pb", b"..PyFunc..ReadFile"),
        ("g.onnx", b"location: ../../etc"),
        ("clean.onnx", b"Add Mul"),
        ("elf", b"\x7fELF...."), ("exe.dat", b"MZ.."), ("mac", b"\xcf\xfa\xed\xfe"), ("run", b"#!/bin/sh\nx"), ("tiny", b"MZ"),
        ("num.npy", b"\x93NUMPY\x01\x00\x0a\x00{'<f4'}   "),
        ("obj.npy", b"\x93NUMPY\x01\x00\x0a\x00{'|O'}    "),
        ("obj2.npy", b"\x93NUMPY\x02\x00\x08\x00\x00\x00{'O'}   "),
        ("zero.npy", b"\x93NUMPY\x01\x00\x00\x00"),
        ("huge.npy", b"\x93NUMPY\x02\x00\xff\xff\xff\xff"),
        ("short.npy", b"\x93NUM"),
        ("script.npy", b"#!/usr/bin/env python\n"),
    ]
    files = table(spark, rows)
    assert found(D.detect_keras_config(files)) == [
        ("hidden", "AR-KERAS-001", "Critical"), ("lambda.h5", "AR-KERAS-001", "Critical"),
        ("m.keras!config.json", "AR-KERAS-002", "Critical"), ("m.keras!config.json", "AR-KERAS-003", "High"),
        ("renamed.hdf5", "AR-KERAS-004", "Medium"),
    ]
    assert found(D.detect_graph_ops(files)) == [
        ("g.onnx", "AR-ONNX-002", "Critical"), ("g.pb", "AR-TF-001", "High"), ("g.pb", "AR-TF-001", "Medium"),
    ]
    assert [(a, b) for a, b, _ in found(D.detect_magic(files))] == [
        ("elf", "AR-BIN-001"), ("exe.dat", "AR-BIN-002"), ("mac", "AR-BIN-003"), ("run", "AR-SHELL-002"), ("script.npy", "AR-SHELL-002"),
    ]
    assert [(a, b) for a, b, _ in found(D.detect_npy(files))] == [
        ("huge.npy", "AR-NPY-002"), ("obj.npy", "AR-NPY-001"), ("obj2.npy", "AR-NPY-001"), ("zero.npy", "AR-NPY-002"),
    ]


def brute_archive(entries, max_entries, max_bytes, max_ratio):
    """The rule read one member at a time: all are judged, sums stop at a limit."""
    out, compressed, expanded, kind, stopped = [], 0, 0, entries[0][2], False
    for i, name, kind, ins, outs, link in entries:
        escapes = bool(re.search(r"^/|(^|/)\.\.(/|$)", name))
        if escapes or link:
            out.append("AR-ARCHIVE-003" if escapes else "AR-ARCHIVE-004")
        elif i <= max_entries and not stopped:
            compressed += ins
            expanded += outs
            stopped = expanded > max_bytes
    if stopped:
        out.append("AR-ARCHIVE-005")
    elif len(entries) > max_entries:
        out.append("AR-ARCHIVE-002")
    if kind == "zip" and compressed > 0 and expanded / compressed > max_ratio:
        out.append("AR-ARCHIVE-006")
    return sorted(out)


@pytest.mark.parametrize("members", [1, 4, 1024])
def test_archives_against_a_walk(spark, monkeypatch, members):
    import random

    monkeypatch.setattr(D, "SLICE_MEMBERS", members)
    rng = random.Random(5)
    archives, rows = {}, []
    for n in range(80):
        kind = "zip" if n % 3 else "tar"
        size = rng.randrange(1, 24)
        low = -40 if n % 4 == 0 else 0
        entries = [
            (i, rng.choice(["ok", "ok", "../x", "a/b", "/abs"]) + str(i), kind, rng.randrange(3), rng.randrange(low, 60), rng.random() < 0.15)
            for i in range(1, size + 1)
        ]
        archives[f"z{n}"] = entries
        rows += [("a", f"z{n}", kind, i, name, ins, outs, link, None) for i, name, kind, ins, outs, link in entries]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "artifact_id string, archive string, kind string, ord int, name string, compressed bigint, size bigint, is_link boolean, link_target string")
    limits = dict(max_entries=17, max_bytes=150, max_ratio=20.0)
    got = {}
    for r in D.detect_archive(df, **limits).collect():
        got.setdefault(r.location.split("!")[0], []).append(r.id)
    for name, entries in archives.items():
        assert sorted(got.get(name, [])) == brute_archive(entries, *limits.values()), name


def test_a_hostile_member_behind_the_entry_limit_is_found(spark):
    rows = spark.range(1, 10_002).selectExpr("'a' AS artifact_id", "'z.zip' AS archive", "'zip' AS kind", "id AS ord", "if(id = 10001, '../x', 'ok') AS name", "1L AS compressed", "1L AS size", "false AS is_link")
    assert {r.id for r in D.detect_archive(rows).collect()} == {"AR-ARCHIVE-002", "AR-ARCHIVE-003"}


def test_listing_and_failures(spark):
    listing = spark.createDataFrame(
        [("a", "lib.so", False, None), ("a", "x.sh", True, None), ("a", "d/l", False, "../../y"), ("a", "d/k", True, "../y"), ("b", "t", False, None)],
        "artifact_id string, path string, is_exec boolean, link_target string",
    )
    assert [(a, b) for a, b, _ in found(D.detect_file_meta(listing))] == [
        ("d/l", "AR-LINK-001"), ("lib.so", "AR-NATIVE-001"), ("x.sh", "AR-EXEC-001"), ("x.sh", "AR-SHELL-001"),
    ]
    assert [r.description for r in D.detect_truncated(listing, 3).collect()] == ["examined 3 of 4"]
    failures = spark.createDataFrame([("a", "w.pkl", "e"), ("a", "README", "e"), ("a", "w.safetensors", "e")], "artifact_id string, path string, error string")
    assert [(a, c) for a, _, c in found(D.detect_unreadable(failures))] == [("README", "Low"), ("w.pkl", "High"), ("w.safetensors", "Low")]


def test_metadata(spark):
    kv = spark.createDataFrame(
        [("t1", "tokenizer.chat_template", "{% for %}"), ("t2", "tokenizer.chat_template", "{{ x }}"), ("t3", "tokenizer.chat_template", "{{ cycler }}"),
         *[(f"n{v}", "general.alignment", v) for v in ("0", "32", "33", "1048576", "2097152", "18446744073709551615", "18446744073709551616", "x")],
         ("o", "onnx.external_data.traversal", "true")],
        "artifact_id string, key string, value string",
    )
    ids = [r.artifact_id for r in kv.select("artifact_id").distinct().collect()]
    artifacts = spark.createDataFrame([(i, "onnx" if i == "o" else "gguf", "w") for i in ids], "artifact_id string, format string, primary_path string")
    licenses = spark.createDataFrame([(i, "MIT") for i in ids if i != "t2"], "artifact_id string, spdx_id string")
    domains = spark.createDataFrame([("o", "com.x")], "artifact_id string, domain string")
    got = sorted((r.artifact_id, r.id) for r in D.detect_metadata(artifacts, kv, licenses, domains).collect())
    assert got == [
        ("n0", "AR-GGUF-011"), ("n18446744073709551615", "AR-GGUF-011"), ("n2097152", "AR-GGUF-011"), ("n33", "AR-GGUF-011"),
        ("o", "AR-ONNX-010"), ("o", "AR-ONNX-011"), ("t1", "AR-GGUF-010"), ("t2", "AR-LIC-001"), ("t3", "AR-GGUF-010"),
    ]


def test_harmless_files_are_clean(spark):
    rows = [
        ("notes.md", b"This model card mentions os.system( and pickle.loads( in prose."),
        ("tokenizer.json", b'{"model": {"vocab": {"eval": 1, "exec": 2}}}'),
        ("config.json", b'{"architectures": ["LlamaForCausalLM"], "torch_dtype": "bfloat16"}'),
        ("empty.bin", b""),
        ("w.safetensors", (2).to_bytes(8, "little") + b"{}"),
        ("num.npy", b"\x93NUMPY\x01\x00\x0a\x00{'<f4'}   "),
    ]
    files = table(spark, rows)
    assert found(D.inspect_contents(files)) == [] and found(FI.header_findings(files)) == []


def test_one_pass_equals_the_single_detectors(spark):
    rows = [
        ("a.pkl", pickle.dumps(Evil(), protocol=4)), ("b.pkl", pickle.dumps([1], protocol=2)), ("c.pt", b"PK\x03\x04"), ("raw.bin", bytes(range(256))),
        ("m.py", b"exec(x)\nload_inline"), ("c.json", b'{"trust_remote_code": true, "n": [{"_target_": "os.x"}]}'), ("l.json", b"[1]"), ("x.json", b"{"),
        ("k.h5", b"none"), ("k", V.MAGIC_HDF5 + b'"class_name": "Lambda", "module": "os"'), ("m.keras!config.json", b'{"class_name":"TFSMLayer","module":"x.y"}'),
        ("g.pb", b"WriteFile"), ("g.onnx", b"PythonOp location ../"), ("e", b"\x7fELF"), ("s", b"#!/bin/sh\n"), ("h", b"\x80\x04c"),
        ("o.npy", b"\x93NUMPY\x01\x00\x0a\x00{'|O'}    "), ("z.npy", b"\x93NUMPY\x01\x00\x00\x00"), ("p.npy", b"\x80\x02cos\nsystem\n.."), ("empty.pkl", b""), ("t", b"a"),
    ]
    files = table(spark, rows)
    key = lambda r: (r.location, r.id, r.severity, r.title, r.description)
    single = sorted(key(r) for d in D.CONTENT_DETECTORS for r in d(files).collect())
    assert sorted(key(r) for r in D.inspect_contents(files).collect()) == single and len(single) >= 20


def test_source_ids_are_unique_per_rule():
    ids = [r[0] for r in V.PYTHON_RULES]
    assert len(set(ids)) == len(ids)
    assert F.col("x") is not None
