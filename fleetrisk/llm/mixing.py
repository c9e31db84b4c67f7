"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, in a permuted order of its documents, are cut into blocks of equal size. A target of T words
out of W takes every block T // W times and the first blocks of one more permutation for the rest, the last of them in
part, so that the sum is T to the word. The blocks of all sources are dealt to output shards by a binary tree: at each
node the counts of the left half are one multivariate-hypergeometric draw, so quotas are exact and shards are alike.
A shard draws the blocks of its interval of each source's permutation, disjoint from all others, and orders them by a
keyed hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

WORD = r"[^\x20\x09-\x0D]+"
SPACED = r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"  # words with the white space that follows them
BLOCK_WORDS = 256
SHARDS = 64
BUCKET_ROWS = 2000
STEP_ROWS = 1000  # documents that are cut into pieces at once
PIECES = "array<struct<epoch int, shard int, order long, first long, words long>>"


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    key: int
    words: int = 0  # to take
    full: int = 0  # times every block is taken
    rest: int = 0  # words of one more permutation
    blocks: int = 0
    units: int = 0
    cuts: np.ndarray | None = None  # of the units, by shard


def targets(sizes: list[int], weights: list[float], total: float, cap: float = 3.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; what is cut off is shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in sorted(free))
        full = {i for i in free if left * weights[i] / weight > cap * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in sorted(full):
            out[i] = cap * sizes[i]
            left -= out[i]
        free -= full
    return out


def mix64(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(key & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each index in a keyed permutation of ``range(n)``: a Feistel network walked until it is in range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for turn in range(6):
            left, right = right, left ^ (mix64(right, key * 8 + turn) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def univariate(rng, good: int, bad: int, draw: int) -> int:
    """How many of ``draw`` blocks are among the ``good`` ones, by inversion of the hypergeometric law, at any size.

    Weights follow from the mode outwards by the exact ratios of neighbouring terms. Beyond ten standard deviations they
    are below what a double of the sum can hold, so nothing is left out that could be drawn.
    """
    total = good + bad
    low, high = max(0, draw - bad), min(draw, good)
    if low == high:
        return low
    mode = min(high, max(low, (draw + 1) * (good + 1) // (total + 2)))
    spread = (draw * good / total * (bad / total) * ((total - draw) / max(1, total - 1))) ** 0.5
    reach = int(10 * spread) + 60
    first, last = max(low, mode - reach), min(high, mode + reach)
    # ratio of the terms k + 1 and k: (good - k)(draw - k) / ((k + 1)(bad - draw + k + 1))
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((draw - k) / (bad - draw + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], "right"))


def hypergeometric(rng, counts: np.ndarray, draw: int) -> np.ndarray:
    """One multivariate-hypergeometric draw, as a chain of marginal ones."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(map(int, counts)):
        left -= c
        out[i] = univariate(rng, c, left, draw)
        draw -= int(out[i])
    return out


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by shard and source: the leaves of the tree, in order."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    draw = int(counts.sum()) * left // shards
    one = hypergeometric(np.random.default_rng([seed, shards, draw]), counts, draw)
    return np.concatenate([split(one, left, 2 * seed + 1), split(counts - one, shards - left, 2 * seed + 2)])


def prepare(sizes: list[tuple[str | None, int]], weights, share: float, cap: float, block: int, shards: int, seed: int) -> list[Source]:
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in order], [weights[i % len(weights)] for i in range(len(order))], share * sum(n for _, n in order), cap)
    sources = [Source(name, n, t, seed * 1000003 + i) for i, ((name, n), t) in enumerate(zip(order, goal))]
    for s in sources:
        s.words, s.blocks = round(s.target), -(-s.size // block)
        s.full, s.rest = divmod(s.words, s.size) if s.size else (0, 0)
        s.units = s.full * s.blocks + -(-s.rest // block) + 1 if s.rest else s.full * s.blocks
    dealt = split(np.array([s.units for s in sources], np.int64), shards, seed) if sources else np.zeros((shards, 0), np.int64)
    for i, s in enumerate(sources):
        s.cuts = np.cumsum(dealt[:, i])
    return sources


def pieces(s: Source, start: np.ndarray, size: np.ndarray, block: int) -> np.ndarray:
    """What the mix takes of documents that cover words ``start`` to ``start + size`` of their source.

    A column for each piece, by document, epoch and block: place of the document, epoch, shard, order, first word, words.
    """
    docs = np.nonzero(size)[0] if s.words else np.zeros(0, np.int64)
    lead = start[docs] // block
    n = (start[docs] + size[docs] - 1) // block - lead + 1
    doc = np.repeat(docs, n)
    blocks = np.arange(n.sum()) + np.repeat(lead - np.cumsum(n) + n, n)
    begin = start[doc]
    low, high = np.maximum(begin, blocks * block), np.minimum(begin + size[doc], (blocks + 1) * block)
    out = [np.zeros((6, 0), np.int64)]
    for epoch in range(s.full + (s.rest > 0)):
        key = s.key * 64 + epoch
        rank, end = permuted(blocks, s.blocks, key), high
        if epoch == s.full:  # each block gives what is left of the rest when its turn comes
            short = int(permuted(np.array([s.blocks - 1]), s.blocks, key)[0])
            before = rank * block - (rank > short) * (s.blocks * block - s.size)
            end = np.minimum(high, blocks * block + np.maximum(0, s.rest - before))
        unit = epoch * s.blocks + rank
        shard = np.searchsorted(s.cuts, unit, "right")
        order = mix64(unit, s.key + 17).view(np.int64)
        out.append(np.stack([doc, np.full_like(doc, epoch), shard, order, low - begin, end - low])[:, end > low])
    made = np.concatenate(out, axis=1)
    return made[:, np.argsort(made[0], kind="stable")]


def plan(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, cap: float = 3.0, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """``doc_id, digest, size, source_size, target, taken, pieces`` for every row of ``docs``.

    Sizes are numbers of words; null and empty texts have size 0 and nothing is taken. Sources weigh in turn by code
    point, null last. ``pieces`` name epoch, output shard, order in the shard, first word and words; ``taken`` is their
    sum and never above ``cap`` times the size. One row for each source reaches the driver. The words before a document
    are counted in two steps: within buckets of a source of about ``BUCKET_ROWS`` rows and over the buckets, so a
    source with most rows is many groups. An empty table gives an empty plan.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    seen = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sources = prepare([(r.source, r["size"]) for r in seen], list(weights), share, cap, block, shards, seed)
    buckets = max(1, -(-sum(r.n for r in seen) // BUCKET_ROWS))
    spread = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), F.lit(buckets)))
    group = Window.partitionBy("source", "bucket")
    inside = spread.withColumn("upto", F.sum("size").over(group.orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0)))
    totals = spread.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    placed = inside.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("doc_id", "digest", "source", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))
    by_name = {s.name: s for s in sources}

    def run(batches):
        import pyarrow as pa

        kinds = {"epoch": pa.int32(), "shard": pa.int32(), "order": pa.int64(), "first": pa.int64(), "words": pa.int64()}
        names = ["doc_id", "digest", "size", "source_size", "target", "taken", "pieces"]
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                own = [by_name[n] for n in batch.column(2).to_pylist()]
                size, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                rows: dict[int, list[int]] = {}
                for i, s in enumerate(own):
                    rows.setdefault(s.key, []).append(i)
                parts = []
                for places in map(np.array, rows.values()):
                    part = pieces(own[places[0]], start[places], size[places], block)
                    part[0] = places[part[0]]
                    parts.append(part)
                made = np.concatenate(parts, axis=1)
                made = made[:, np.argsort(made[0], kind="stable")]
                ends = np.searchsorted(made[0], np.arange(len(own) + 1))
                taken = np.diff(np.concatenate([[0], np.cumsum(made[5])])[ends])
                fields = [pa.array(c, kind) for c, kind in zip(made[1:], kinds.values())]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, list(kinds)))
                sources_of = [pa.array([s.size for s in own], pa.int64()), pa.array([s.target for s in own], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), *sources_of, pa.array(taken, pa.int64()), lists], names)

    return placed.mapInArrow(run, f"doc_id long, digest long, size long, source_size long, target double, taken long, pieces {PIECES}")


def shards(docs: DataFrame, **options) -> DataFrame:
    """``shard, order, doc_id, source, epoch, first, text``: what each output shard holds, a row for each block's part of a document.

    The quotas of the splitting tree say how many blocks of each source a shard has; the blocks are disjoint draws from
    the source's permutation, and ``order`` is their place in the shard, the parts of a block one after the other.
    Rows that repeat an id and text share one plan.
    """
    chosen = plan(docs, **options).where("taken > 0").groupBy("doc_id", "digest").agg(F.first("pieces").alias("pieces"))
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = full.join(chosen.withColumnRenamed("doc_id", "id").withColumnRenamed("digest", "d"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    spaced = F.regexp_extract_all("text", F.lit(SPACED), F.lit(1))
    parts = joined.select("doc_id", "source", spaced.alias("words"), F.explode("pieces").alias("p"))
    cut = F.array_join(F.slice("words", (F.col("p.first") + 1).cast("int"), F.col("p.words").cast("int")), "")
    return parts.select("p.shard", "p.order", "doc_id", "source", "p.epoch", "p.first", cut.alias("text"))


def write(docs: DataFrame, path: str, **options) -> None:
    """The shards as Parquet below ``path``, a folder each, in shuffled order."""
    rows = shards(docs, **options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "shard", "order").sortWithinPartitions("shard", "order", "doc_id", "first").write.partitionBy("shard").parquet(path)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns ``doc_id, text, lang, source, n_chars``: a row for each document and time it is taken.

    A document taken whole keeps its text; of one taken in part the words drawn are kept, with the white space between
    them. Rows that repeat an id and text share one plan. Rows of which nothing is taken go; so do those without words.
    """
    chosen = plan(docs, **options).where("taken > 0").groupBy("doc_id", "digest").agg(F.first("size").alias("size"), F.first("pieces").alias("pieces"))
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = full.join(chosen.withColumnRenamed("doc_id", "id").withColumnRenamed("digest", "d"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")))
    epochs = joined.select("doc_id", "text", "lang", "source", "size", "pieces", F.explode(F.array_distinct(F.transform("pieces", lambda p: p["epoch"]))).alias("epoch"))
    drawn = epochs.withColumn("drawn", F.filter("pieces", lambda p: p["epoch"] == F.col("epoch")))
    words = F.aggregate("drawn", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    # words with the white space that follows them; a piece is a slice of that list
    spaced = F.regexp_extract_all("text", F.lit(SPACED), F.lit(1))
    part = F.array_join(F.flatten(F.transform(F.array_sort(F.transform("drawn", lambda p: F.struct(p["first"].alias("first"), p["words"].alias("words")))), lambda p: F.slice(spaced, (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")
    text = F.when(words == F.col("size"), F.col("text")).otherwise(part)
    return drawn.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
