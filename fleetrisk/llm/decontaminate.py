"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy

SEED_TOKENS = 5  # a document and an item meet where they share a run of so many tokens
LEAST_TILE = 4  # tokens of the shortest tile that counts
BLOCK_BYTES = 32 << 20  # benchmark text that one pass over the documents carries; larger benchmarks take more passes
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(tokens: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``n`` token numbers, modulo 2^64, by doubling."""
    with np.errstate(over="ignore"):
        power, have, out, length = BASE, (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), None, 0
        size = 1
        while n:
            if n & 1:
                m = len(tokens) - length - size + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = have if out is None else out[:m] * power + have[length : length + m]
                length += size
            n >>= 1
            if n:
                m = len(have) - size
                if m <= 0:
                    return np.zeros(0, np.uint64)
                have, power, size = have[:m] * power + have[size : size + m], power * power, 2 * size
        return out


def open_runs(free: np.ndarray, n: int) -> np.ndarray:
    """Where ``n`` unmarked tokens begin."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.nonzero(marked[n:] == marked[: len(marked) - n])[0]


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest matches of unmarked tokens first, then shorter ones, until ``least`` tokens.

    Returns (start in item, start in text, length), none of which overlap on either side; of equal lengths the first in
    the text is taken, with the first place of the item. Where a run of n tokens is shared, so is one of n - 1, so the
    next length that has a match is searched by halving; equal hashes are compared token by token before they are marked.
    """
    free_item, free_text, found = np.ones(len(item), bool), np.ones(len(text), bool), []

    def shared(n: int):
        """Open runs of the item and of the text with a hash that both have."""
        a, b = open_runs(free_item, n), open_runs(free_text, n)
        if not len(a) or not len(b):
            return a[:0], b[:0], None, None
        hash_a, hash_b = rolling(item, n), rolling(text, n)
        b = b[np.isin(hash_b[b], hash_a[a])]
        return (a[np.isin(hash_a[a], hash_b[b])] if len(b) else a[:0]), b, hash_a, hash_b

    most = min(len(item), len(text))
    while most >= least:
        low, high = least - 1, most  # the longest match lies in between, or is none
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[1]) else (low, middle - 1)
        if low < least:
            break
        a, b, hash_a, hash_b = shared(low)
        at: dict[int, deque] = {}
        for i in a.tolist():
            at.setdefault(int(hash_a[i]), deque()).append(i)
        for j in b.tolist():
            places = at.get(int(hash_b[j]))
            if not places or not free_text[j : j + low].all():
                continue
            while places and not free_item[places[0] : places[0] + low].all():
                places.popleft()  # what is marked stays so
            i = next((i for i in places if free_item[i : i + low].all() and np.array_equal(item[i : i + low], text[j : j + low])), None)
            if i is not None:
                free_item[i : i + low] = free_text[j : j + low] = False
                found.append((i, j, low))
        most = low - 1
    return found


def coverage(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_TOKENS, least: int = LEAST_TILE, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, contaminated`` for every row of ``docs``.

    Tokens are runs without white space, with A-Z in lower case. Of the benchmark items that share a run of ``seed``
    tokens (or the whole item, if shorter) with a document, the one whose tokens tiles cover best is reported, ties
    by item_id, items without id last (their match has a null item and its coverage); a document is contaminated from ``threshold`` on. Tiles may come in any order, so reordered passages
    count. Whole texts are read. Rows without a match, with null or empty text have null item, coverage 0 and are
    clean; items without text match nothing. The benchmark is measured first and carried in blocks of at most about
    ``block_bytes``, one pass for each block.
    """
    found = texts(docs).select("doc_id", "text", F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(0).alias("n_tiles"))
    blocks = benchmark_blocks(benchmark, block_bytes)
    for k, block in enumerate(blocks):
        found = _pass(found, block, seed, least, k + 1 < len(blocks))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", (F.col("coverage") >= threshold).alias("contaminated"))


def keep(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_TOKENS, least: int = LEAST_TILE, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is covered by ``threshold`` or more."""
    place = docs.columns.index("text")
    for block in benchmark_blocks(benchmark, block_bytes):
        judge = tiler(block, seed, least)

        def run(batches, judge=judge):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([judge(t.as_py() or "", (None, 0.0, 0))[1] < threshold for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[list]:
    """Items as tokens, in blocks of about ``block_bytes`` of text, by hash of id and text; the text is measured first."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [sorted(((r.item_id, w) for r in items.where(block == k).collect() if (w := r.text.encode("utf-8", "surrogatepass").lower().split())), key=lambda x: (place_of(x[0]), x[1])) for k in range(blocks)]


def place_of(item_id: int | None) -> tuple[bool, int]:
    """Order of items: by id, those without one last."""
    return item_id is None, item_id or 0


def _pass(rows: DataFrame, items: list, seed: int, least: int, more: bool) -> DataFrame:
    """The better of what earlier blocks found and this block; the text goes on only while ``more`` blocks follow."""
    judge = tiler(items, seed, least)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [judge(t.as_py(), f) for t, f in zip(batch.column(1), zip(*(c.to_pylist() for c in batch.columns[2:5])))]
            out = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if more else []), *out], names)

    names = ["doc_id", *(["text"] if more else []), "item_id", "coverage", "n_tiles"]
    return rows.mapInArrow(tidy(run), f"doc_id long, {'text string, ' if more else ''}item_id long, coverage double, n_tiles int")


def tiler(items: list, seed: int, least: int):
    """A function of a text and what earlier blocks found, ``(item_id, coverage, tiles)``, that returns the better of both."""
    number: dict[bytes, int] = {}
    numbered = [(i, np.array([number.setdefault(t, len(number)) for t in w], np.int64)) for i, w in items]
    seeds: dict[int, dict[int, set[int]]] = {}
    for at, (_, w) in enumerate(numbered):
        n = min(seed, len(w))
        for h in rolling(w, n):
            seeds.setdefault(n, {}).setdefault(int(h), set()).add(at)
    known = {n: np.sort(np.fromiter(s, np.uint64, len(s))) for n, s in seeds.items()}

    def judge(text: str, found: tuple):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        get = number.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        inside = ids >= 0
        if not inside.any():
            return found
        near: dict[int, list[int]] = {}
        for n, hashes in known.items():
            got = rolling(ids, n)
            if not len(got):
                continue
            place = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            for p in np.nonzero(hashes[place] == got)[0]:
                for at in seeds[n][int(got[p])]:
                    near.setdefault(at, []).append(int(p))
        for at in sorted(near):
            item_id, item = numbered[at]
            keep = np.isin(ids, item)  # only the item's own tokens can be tiled; runs between them become single marks
            short = keep | np.concatenate([[True], keep[:-1]])
            of_item = np.where(keep, ids, -1)[short]
            made = tiles(item, of_item, min(least, len(item)))
            share = sum(t[2] for t in made) / len(item)
            if share > found[1] or (share == found[1] > 0 and place_of(item_id) < place_of(found[0])):
                found = (item_id, share, len(made))
        return found

    return judge
