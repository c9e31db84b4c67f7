"""The pull parser against the library's, on random values, cuts and damage."""

import json
import random

import pytest

from fleetrisk.sources.json_events import puller

EVENTS, ITEMS = puller()


def parts(text, n):
    return [text[i : i + n] for i in range(0, len(text), n)]


def value(rng, depth=0):
    r = rng.random()
    if depth > 4 or r < 0.4:
        return rng.choice([None, True, False, 0, -1, 1.5e10, 'a"\\b\u00e9\n', "", 123456789])
    if r < 0.7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcde"): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_values_are_those_of_the_library():
    rng = random.Random(1)
    for _ in range(1500):
        v = value(rng)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert list(ITEMS(parts(text, rng.randrange(1, 9)), lambda path: path == ())) == [((), v)]


def test_damage_is_seen_where_the_library_sees_it():
    rng = random.Random(2)
    for _ in range(2000):
        text = json.dumps(value(rng))
        k = rng.randrange(len(text) + 1)
        text = text[:k] + rng.choice('{}[],:"1x ') + text[k:]
        try:
            json.loads(text)
        except ValueError:
            with pytest.raises(ValueError):
                list(EVENTS(parts(text, 3)))
        else:
            list(EVENTS(parts(text, 3)))


def test_items_by_path_and_depth():
    text = '{"a": [{"b": 1}, {"b": [2]}], "c": {"a": 3}, "d": "x"}'
    wanted = {("a", "*"), ("c", "a"), ("d",)}
    assert list(ITEMS(parts(text, 2), wanted.__contains__)) == [(("a", "*"), {"b": 1}), (("a", "*"), {"b": [2]}), (("c", "a"), 3), (("d",), "x")]
    assert sum(1 for _ in EVENTS(["[" * 20_000, "]" * 20_000])) == 40_000


CONFIGS = [
    '{"a": {"_target_": "os.system"}, "b": [1, {"callable": "x.y", "n": [[{"class_path": "z"}]]}], "target_": 5}',
    '{"_target_": "", "c": [{}, [], {"callable": "k"}]}',
    '[{"_target_": "x"}]',
    '"_target_"',
]


def test_deep_configurations_are_walked_like_others(spark):
    from fleetrisk.operators import detect

    n = 5000
    deep = '{"a":' * n + '{"_target_": "os.system"}' + "}" * n
    mixed = '{"b":[' * n + '{"callable": "f"}' + "]}" * n
    broken = '{"a":' * n + "}" * n
    texts = [*CONFIGS, deep, mixed, broken, "[" * n + "]" * n]
    files = spark.createDataFrame([("m", f"c{i}.json", bytearray(t.encode())) for i, t in enumerate(texts)], "artifact_id string, path string, content binary")
    got = {r.location: r.description for r in detect.detect_instantiation(files).collect()}
    assert got == {
        "c0.json at a": "_target_ names os.system", "c0.json at b.1": "callable names x.y", "c0.json at b.1.n.0.0": "class_path names z",
        "c1.json at c.2": "callable names k",
        "c4.json at " + ".".join("a" * n): "_target_ names os.system", "c5.json at " + ".".join(["b.0"] * n): "callable names f",
    }


def test_deep_walk_equals_the_recursive_one(monkeypatch):
    from fleetrisk.operators import detect

    walk = detect._named_callables(["_target_", "target_", "callable", "class_path"])
    want = [sorted(map(str, h)) for h in walk(CONFIGS)]
    real = json.loads

    def refuses(text):
        if text in CONFIGS:
            raise RecursionError
        return real(text)

    monkeypatch.setattr(json, "loads", refuses)
    assert [sorted(map(str, h)) for h in walk(CONFIGS)] == want


def test_documents_in_ranges_equal_whole_ones(spark):
    from pyspark.sql import functions as F

    from fleetrisk.sources import boms, chunks

    cdx = {"specVersion": "1.6", "bomFormat": "CycloneDX", "metadata": {"component": {"name": "é", "version": "1", "hashes": [{"alg": "sha-256", "content": "aa"}], "properties": [{"name": "fleetrisk:primaryFile", "value": "w"}]}},
           "components": [{"type": "file", "name": f"f{i}", "hashes": [{"alg": "SHA-384", "content": str(i)}], "properties": [{"name": "fleetrisk:size", "value": str(i)}]} for i in range(40)] + [{"type": "library", "name": "l"}]}
    spdx = {"@graph": [{"type": "software_File", "name": "a", "verifiedUsing": [{"algorithm": "sha256", "hashValue": "h"}]}, {"type": "ai_AIPackage", "name": ""}, {"type": "ai_AIPackage", "name": "m", "ai_hyperparameter": [{"key": "primaryFile", "value": "p"}, {"key": "quantization", "value": "Q"}], "verifiedUsing": [{"algorithm": "sha384", "hashValue": "k"}]}, {"type": "ai_AIPackage", "name": "second"}]}
    bodies = {"cdx": json.dumps(cdx), "bare": '{"bomFormat": 1}', "spdx": json.dumps(spdx, indent=1), "cut": json.dumps(cdx)[:-5], "other": '{"x": {"@graph": 1}}', "list": '[{"@graph": []}]', "text": "x", "none": "", "open": '{"@graph": []}'}
    whole = spark.createDataFrame([(k, "m", v) for k, v in bodies.items()], "doc_id string, artifact_id string, body string")
    ranges = chunks.chunked(whole.select("artifact_id", F.col("doc_id").alias("path"), F.encode("body", "UTF-8").alias("content")), 7, 0).withColumnRenamed("path", "doc_id")
    kinds, claims, files = boms.read_ranges(ranges)
    detected = boms.bom_detect(whole)
    rows = lambda df, *cols: sorted(map(str, df.select(*cols).collect()))
    assert rows(kinds, "doc_id", "kind", "error") == rows(detected, "doc_id", "kind", "error")
    read = [boms.bom_read_cyclonedx(detected.filter("kind = 'cyclonedx'")), boms.bom_read_spdx(detected.filter("kind = 'spdx'"))]
    assert rows(claims, *claims.columns) == sorted(r for c, _ in read for r in rows(c, *claims.columns))
    assert rows(files, *files.columns) == sorted(r for _, f in read for r in rows(f, *files.columns))
