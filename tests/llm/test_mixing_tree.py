"""The splitting tree and its draws against what they must sum to, and the law of the draws."""

import collections
import math
import random

import numpy as np
import pytest

from fleetrisk.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def test_law_of_a_draw():
    """Against the exact terms of the law, by chi-squared."""
    good, bad, draw, n = 30, 50, 25, 20_000
    seen = collections.Counter(mixing.univariate(np.random.default_rng(i), good, bad, draw) for i in range(n))
    want = {k: math.comb(good, k) * math.comb(bad, draw - k) / math.comb(good + bad, draw) for k in range(0, draw + 1)}
    chi = sum((seen[k] - n * p) ** 2 / (n * p) for k, p in want.items() if n * p > 5)
    assert chi < 40 and sum(seen.values()) == n


@pytest.mark.parametrize("total", [10**4, 10**9, 6 * 10**10, 10**13])
def test_draws_at_any_size(total):
    """Mean and spread of the law, below and above what the library draws."""
    good, draw = total // 3, total // 2
    mean, sd = draw * good / total, (draw * good / total * (1 - good / total) * (total - draw) / (total - 1)) ** 0.5
    n = 400 if total < 10**12 else 12
    got = [(mixing.univariate(np.random.default_rng(i), good, total - good, draw) - mean) / sd for i in range(n)]
    assert abs(np.mean(got)) < 5 / n**0.5 and (n < 100 or 0.85 < np.std(got) < 1.15) and max(map(abs, got)) < 6


def test_edges_of_the_law():
    rng = np.random.default_rng(1)
    assert mixing.univariate(rng, 0, 5, 3) == 0 and mixing.univariate(rng, 5, 0, 3) == 3 and mixing.univariate(rng, 4, 4, 8) == 4 and mixing.univariate(rng, 4, 4, 0) == 0


def test_quotas_sum_to_the_blocks():
    counts = np.array([1000, 0, 37, 5 * 10**10, 1], np.int64)
    for n in (1, 2, 7, 64):
        dealt = mixing.split(counts, n, 3)
        assert (dealt.sum(axis=0) == counts).all() and (dealt >= 0).all()
        sizes = dealt.sum(axis=1)
        assert sizes.max() - sizes.min() <= math.ceil(math.log2(n)) + 1


def test_shards_obey_the_tree(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.randrange(0, 60))), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    block, n = 16, 5
    got = mixing.shards(docs, block=block, shards=n).collect()
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    sources = mixing.prepare(list(sizes.items()), [1, 2, 3], 1.0, 3.0, block, n, 1)
    by_name = {s.name: s for s in sources}
    words, taken, blocks = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in got:
        for w in r.text.split():
            words[w, r.epoch] += 1
        taken[r.source] += len(r.text.split())
        blocks[r.source, r.shard].add(r.order)
    assert max(words.values()) == 1  # draws of one epoch are disjoint
    assert all(taken[s.name] == s.words for s in sources)
    for s in sources:
        quota = np.diff(np.concatenate([[0], s.cuts]))
        spare = 1 if s.rest else 0  # the rest may end a block early, so one planned block may be empty
        have = [len(blocks[s.name, k]) for k in range(n)]
        assert all(q - spare <= h <= q for h, q in zip(have, quota)) and sum(quota) - sum(have) <= spare
    orders = [o for key, own in blocks.items() for o in own]
    assert len(orders) == len(set(orders))
    local = [r.order for r in sorted(got, key=lambda r: (r.source or "", r.epoch, r.doc_id)) if r.source == "a"]
    assert local != sorted(local)
    assert by_name["a"].blocks > n


def test_written_shards_come_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c d e f g h " * 5, "en", "s") for i in range(40)], SCHEMA)
    mixing.write(docs, str(tmp_path / "m"), block=8, shards=3)
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == mixing.shards(docs, block=8, shards=3).count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
