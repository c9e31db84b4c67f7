"""Exact duplicates against brute force."""

import collections
import hashlib
import re

import pytest

from fleetrisk.llm import exact

SCHEMA = "doc_id long, text string, lang string, digest string, run long, place long, row string"


def table(spark, pairs, parts=3):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "r") for i, t in pairs], SCHEMA).repartition(parts)


def brute(pairs):
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            out[(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_groups(spark, parts):
    pairs = [(5, "a  b"), (3, "a\tb"), (9, "a\n\r\x0b\x0c b"), (2, "a\xa0b"), (None, "a b"), (None, "only null"), (None, "only  null"), (4, None), (1, ""), (7, " "), (7, " "), (8, "é😀" * 50_000), (6, "é😀" * 50_000), (10, "ab")]
    pairs += [(100 + i, "hot") for i in range(60)] + [(-(1 << 62), "far"), (1 << 62, "far")] + [(1000 + i, f"text {i % 23}") for i in range(90)]
    got = collections.Counter(tuple(r) for r in exact.deduplicate(table(spark, pairs, parts)).collect())
    assert got == brute(pairs)
    assert sum(r[3] for r in got.elements()) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in pairs})


def test_no_rows(spark):
    df = exact.deduplicate(table(spark, []))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0


def test_runs_meet_in_rounds(spark):
    """17 runs need two rounds; every digest ends as one row at whatever runs it began."""
    rows = exact.digests(table(spark, [(i, f"t{i % 5}") for i in range(400)], 17))
    merged = exact.merge_tree(rows, 17).collect()
    assert len(merged) == 5 and all(r.n == 80 for r in merged) and sorted(r.least.doc_id for r in merged) == [0, 1, 2, 3, 4]


def test_no_python(spark):
    plan = exact.deduplicate(table(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
