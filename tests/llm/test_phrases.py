"""Collocations against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetrisk.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, fingerprint long, n long, words int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, max_words):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, max_words + 1) for i in range(len(words) - m + 1))
    return f, n


def brute(rows, max_words, min_count, top):
    f, n = counts(rows, max_words)
    found = collections.defaultdict(list)
    often = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    for (lang, p), a in often.items():
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in often.items()):
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, own in found.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def sample():
    rng = random.Random(7)
    words = ["The", "the", "É", "é", "new", "york", "New", "a\xa0b", "日本", "x", "y", "don't"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(0, 50)))
        rows.append((text + rng.choice(["", " new york city", "machine learning of new york"]), rng.choice(["en", "en", "fr", None, ""])))
    rows += [(None, "en"), ("", "en"), (" \t ", "en"), ("a a a a a a a", "en"), ("alone", "xx"), ("long " * 3000 + "new york " * 2000, "fr"), ("w" * 5000 + " new york", "fr")]
    return rows + rows[:9]


@pytest.mark.parametrize("at_once, entries, bits", [(2 << 20, 2 << 20, 16), (97, 300, 16), (4000, 10, 6)])
def test_against_brute_force(spark, monkeypatch, at_once, entries, bits):
    """Slices of any size, small runs, and a filter of 64 bits that lets nearly all through give the same rows."""
    monkeypatch.setattr(phrases, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    if bits < 16:
        monkeypatch.setattr(phrases, "LEAST_BITS", bits)
        monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rows = sample()
    docs = spark.createDataFrame([(i if i % 7 else None, *r, "s", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(docs, 4, 8, 12).collect())
    assert got == brute(rows, 4, 8, 12)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequent_counts_are_those_of_the_texts(spark):
    rows = sample()
    docs = phrases.keyed(spark.createDataFrame([(i, *r, "s", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA))
    f, _ = counts(rows, 3)
    got = phrases.frequent_phrases(docs, 3, 5).where("words > 0").groupBy("words").agg(F.count("*"), F.sum("n")).collect()
    want = {m: [a for (_, p), a in f.items() if len(p) == m and a >= 5] for m in (1, 2, 3)}
    assert {tuple(r) for r in got} == {(m, len(a), sum(a)) for m, a in want.items()}


def test_scores_beyond_64_bits(spark):
    """The product 1000 * a * n passes 64 bits."""
    a, n, left, right = 3 * 10**14, 10**16, 4 * 10**14, 5 * 10**14
    df = spark.createDataFrame([(a, n, left, right)], "a long, total long, l long, r long")
    assert df.select(phrases.quotient()).first()[0] == 1000 * a * n // (left * right)


def test_slices_cover_each_phrase_once(monkeypatch):
    monkeypatch.setattr(phrases, "BYTES_AT_ONCE", 11)
    text = "a bb ccc dd. e fffffffffffffffff g h i, j k"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array([text])], ["doc", "lang", "text"])
    for n in (1, 2, 3):
        seen = collections.Counter()
        for data, bounds, _, _ in phrases.slices([batch], n - 1):
            starts, ends, piece, _ = phrases.find_words(data, bounds)
            seen.update(tuple(data[starts[k] : ends[k]].tobytes() for k in range(i, i + n)) for i in phrases.within_pieces(piece, n))
        f, _ = counts([(text, "en")], n)
        assert seen == {tuple(w.encode() for w in p): c for (_, p), c in f.items() if len(p) == n}


def test_hashes_tell_order_and_length():
    data = np.frombuffer(b"a b a b ab", np.uint8)
    starts, ends, _, _ = phrases.find_words(data, np.array([0, len(data)]))
    hasher = phrases.Hasher()
    words = hasher.words(data, starts, ends)
    key = np.zeros(4, np.uint64)
    f = hasher.phrases(words, key, 2, np.arange(4))[0]
    assert f[0] == f[2] and len(set(f.tolist())) == 3
