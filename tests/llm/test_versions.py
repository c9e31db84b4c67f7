"""The next document by id, for ids anywhere in the 64-bit range, and the exact difference where peeling fails."""

import random

import pytest
from pyspark.sql import functions as F

from fleetrisk.llm import fingerprint

SCHEMA = "doc_id long, text string, bucket long, head long"


@pytest.mark.parametrize("ids", [
    [-9 * 10**18, 3, 9 * 10**18],
    [*range(200), 10**15],
    [-(1 << 63), (1 << 63) - 1, 0, 1, -1],
    [7],
    [random.Random(1).randrange(-(1 << 63), 1 << 63) for _ in range(150)],
])
def test_next_by_descending_id(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "BUCKET", 4)
    monkeypatch.setattr(fingerprint, "EDGES", 7)
    ids = sorted(set(ids), reverse=True)
    rows = [(i, f"text of {i}", 1, 2) for i in ids]
    random.Random(2).shuffle(rows)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {i: f"text of {ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_rows_without_id_come_last(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 2)
    rows = [(None, f"n{i}", 1, 2) for i in range(15)] + [(i, f"t{i}", 1, 2) for i in range(5)]
    got = {r.text: r.next_text for r in fingerprint.with_next(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {t: got[t] for t in ("t4", "t3", "t2", "t1")} == {"t4": "t3", "t3": "t2", "t2": "t1", "t1": "t0"}
    seen, at = [], got["t0"]
    while at.startswith("n"):
        seen.append(at)
        at = got[at]
    assert at == "t4" and sorted(seen) == sorted(t for t in got if t.startswith("n"))
    none = spark.createDataFrame([(None, "a", 1, 2), (None, "b", 1, 2)], SCHEMA)
    assert {r.text: r.next_text for r in fingerprint.with_next(none).collect()} == {"a": "b", "b": "a"}


def test_difference_is_exact_where_peeling_fails(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROUNDS", 1)
    monkeypatch.setattr(fingerprint, "RETRIES", (1,))
    rng = random.Random(3)
    rows = [(i, [rng.randrange(40) for _ in range(rng.randrange(30))], [rng.randrange(40) for _ in range(rng.randrange(30))]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>").select("i", F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))
    df = df.withColumns({"s": fingerprint.sketch(F.col("a"), F.lit(fingerprint.FIRST), 1), "t": fingerprint.sketch(F.col("b"), F.lit(fingerprint.FIRST), 1)})
    got = fingerprint.with_difference(df, "a", "b", "s", "t", "d").collect()
    assert not all(r.d.ok for r in got)
    for r in got:
        assert set(r.d.left) == set(r.a) - set(r.b) and set(r.d.right) == set(r.b) - set(r.a)
