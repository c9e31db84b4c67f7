"""Source divergence against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from fleetrisk.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, block int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs):
    docs, groups = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for g, t in docs if g == lang and docs[g, t] >= min_docs]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        own[None] = sum((c for c in own.values()), collections.Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in set(own) - {None}:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in set(own) - {None, s}]
            term = [(t, f(p[s][t], p[None][t])) for t in kept if own[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found, 1) if part == "pair" or i <= 10]
    return sorted(out)


def sample():
    rng = random.Random(3)
    words = ["The", "the", "of", "é", "Éa", "naïve", "x1y", "a-b", "日本", "WORD", "z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for i in range(160):
        source = rng.choice(["a", "a", "b", "é", "c", None])
        pool = words if source != "c" else words[:14]
        rows.append((" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) + rng.choice(["", ".", "\n!"]), rng.choice(["en", "en", "fr", None]), source))
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("123 !!", "de", "x"), ("rare words only", "de", "y"), ("alone", "xx", "one"), ("the " * 5000, "en", "b")]
    return rows + rows[:7]


@pytest.mark.parametrize("cells, entries, at_once", [(1 << 19, 700_000, 4 << 20), (64, 50, 64)])
def test_against_brute_force(spark, monkeypatch, cells, entries, at_once):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "TEXT_AT_ONCE", at_once)
    rows = sample()
    docs = spark.createDataFrame([(i, *r, "clash", 1, 1) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(docs, 4).collect())
    assert got == brute(rows, 4)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact():
    count = np.array([2, 3, 10**15, 4 * 10**15], np.int64)
    total = np.array([7, 3, 3 * 10**15 + 1, 4 * 10**15 + 3], np.int64)
    assert divergence.scaled(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]


def test_equal_subtrees_share_nodes():
    leaves = np.zeros((3, 8), np.int64)
    leaves[2, 5] = 9
    values, levels, root = divergence.consed(leaves)
    assert values.tolist() == [0, 9] and [len(x[0]) for x in levels] == [2, 2, 2] and root[0] == root[1] != root[2]


def test_long_text_is_cut_between_terms():
    data = np.frombuffer(("ab " * 10 + "é" * 40 + " cd").encode(), np.uint8)
    old, divergence.TEXT_AT_ONCE = divergence.TEXT_AT_ONCE, 8
    try:
        found = [t for part in divergence.pieces(data, 0, len(data)) for t in part]
    finally:
        divergence.TEXT_AT_ONCE = old
    assert found == [b"ab"] * 10 + ["é".encode() * 40, b"cd"]
