"""SimHash near duplicates found through Golay codewords.

Two 64-bit fingerprints that differ in at most four bits differ in at most two bits in two of their three segments
(22, 21 and 21 bits): the two smaller of three counts that sum to four are at most two each. A segment, filled up
to 23 bits, is hashed by the perfect binary Golay code: its keys are the codewords nearest to all words within one
bit of it, at most six. Two segments within two bits have a word in the middle, so they share the codeword of that
word. Every fingerprint therefore meets every other within four bits under a pair of codewords; the meeting is
verified by the true distance.

``similar_groups`` finds copies by the similarity of their word shingles. SimHash fingerprints of the shingle sets meet
by the same codewords, all pairs within four bits. Looser copies have fingerprints further apart, so texts meet by least
hashes too: a hash function has the same least value over two sets with the probability of their similarity, wherever
the texts differ. Texts meet where all ``BAND_HASHES`` of one of ``BANDS`` bands are equal, one bit of each function weeds
out chance. Every pair that meets either way is verified by the exact similarity of the shingle sets.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, joined, texts, tidy

GENERATOR = 0b110001110101  # of the (23, 12) Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
RUN_ROWS = 4096  # rows of one bucket that are compared at once; longer buckets are compared in pairs of such chunks
DISTANCE = 4  # bits in which the fingerprints of candidates may differ, all of which the codewords find
SLICE = 1 << 16  # shingle hashes that are counted at once
BANDS, BAND_HASHES = 40, 6  # a pair of similarity s meets in none with probability (1 - s ** 6) ** 40: 0.8 gives 0.000005
HASHES = 256  # hash functions; the bands take the first 240, the sketch one bit of each
SKETCH_BITS = 64  # of 256 in which sketches of candidates may differ; similarity 0.8 differs in 26 and exceeds 64 with probability under 1e-10
XORS, FACTORS = np.random.default_rng(8).integers(1 << 62, 1 << 63, (2, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)
SET_ROWS = 512  # texts of one candidate group in a chunk; longer groups are verified in pairs of chunks
COLUMNS = 2048  # shingles that are counted at once


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Bit is set where it is set in over half of the XXH64 of all word shingles, repeats included; 0 without words."""
    return majority(hashes(words_of(text), shingle, seed))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words; of the whole sequence, if shorter."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    ends, digest = ends[min(shingle, len(words)) - 1 :], xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends))


def majority(found: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), SLICE):
        ones += np.unpackbits(found[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The least value of each of ``HASHES`` hash functions over the numbers ``found``; the highest, if there are none."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), HASHES):
        least = np.minimum(least, ((found[None, at : at + HASHES] ^ XORS[:, None]) * FACTORS[:, None]).min(axis=1))
    return least


def bands_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of least hashes the sketch of 256 bits and a key of each band."""
    used = least[: BANDS * BAND_HASHES].reshape(BANDS, BAND_HASHES)
    mixed = (used ^ used >> np.uint64(31)) * FACTORS[:BAND_HASHES]
    bit = np.bitwise_count(least) & 1
    return np.packbits(bit).view(np.uint64), (mixed.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)) * XORS[0]


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, bits``: the fingerprint of every document as a signed 64-bit number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "bits"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, bits long")


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of at most three bits of every syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    ones = [1 << i for i in range(23)]
    errors = [0] + ones + [a | b for i, a in enumerate(ones) for b in ones[:i]] + [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    leaders = np.zeros(2048, np.int64)
    for e in errors:
        leaders[syndrome(e)] = e
    return np.array([syndrome(x) for x in range(4096)]), np.array([syndrome(x << 12) for x in range(2048)]), leaders


def codewords(words: np.ndarray, tables) -> np.ndarray:
    """For each 23-bit word the indices of the codewords nearest to all words within one bit, -1 in unused places."""
    low, high, leaders = tables
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    found = np.sort((near ^ leaders[low[near & 4095] ^ high[near >> 12]]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def keys_of(bits: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the keys of each row: pairs of codewords of two segments."""
    word = bits.view(np.uint64)
    found = [codewords(((word >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64), tables) for a, w in SEGMENTS]
    rows, keys = [], []
    for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = np.where((found[i][:, :, None] >= 0) & (found[j][:, None, :] >= 0), (p << 24) | (found[i][:, :, None] << 12) | found[j][:, None, :], -1).reshape(len(bits), -1)
        r, c = np.nonzero(both >= 0)
        rows.append(r)
        keys.append(both[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def forest(key: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: pairs (row, smallest row joined to it by links within its key), which keep every component."""
    bits = bits.view(np.uint64)  # the count of set bits takes absolute values of signed numbers
    label, left, right, step = np.arange(len(key)), [], [], 1
    while step < len(key):
        at = np.nonzero(key[step:] == key[:-step])[0]
        if not len(at):
            break
        at = at[label[at] != label[at + step]]
        at = at[np.bitwise_count(bits[at] ^ bits[at + step]).sum(axis=1, dtype=np.int64) <= distance]
        left.append(at)
        right.append(at + step)
        step += 1
        if sum(map(len, left)) > len(key):  # rows that are joined by now need no further link
            label, left, right = joined(label, np.concatenate(left), np.concatenate(right)), [], []
    if left:
        label = joined(label, np.concatenate(left), np.concatenate(right))
    rows = np.nonzero(label != np.arange(len(key)))[0]
    return rows, label[rows]


def links(distinct: DataFrame, distance: int = 4, ready: str | None = None) -> DataFrame:
    """``(a, b)`` over ``distinct(node, bits, ...)``: links that connect all fingerprints within ``distance`` bits.

    Further columns are further fingerprints: each gives keys, and the distance is that of all together. A binary column
    ``ready`` holds the keys of its row, equally many in all rows; rows then meet by those alone.

    Buckets are compared in sorted streams. A bucket longer than ``RUN_ROWS`` is not compared where it is found:
    its rows go on in numbered chunks, and every pair of chunks is compared by a task of its own.
    """
    tables = golay_tables()
    names = [c for c in distinct.columns if c not in ("node", ready)]
    bits_type = ", ".join(f"{c} long" for c in names)

    def stacked(columns):
        return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            whole, every = batch.column(0).to_numpy(zero_copy_only=False), stacked(batch.columns[1 : 1 + len(names)])
            for at in range(0, len(whole), 4096):
                node, bits = whole[at : at + 4096], every[at : at + 4096]
                if ready:
                    keys = np.frombuffer(b"".join(batch.column(1 + len(names))[at : at + 4096].to_pylist()), np.int64)
                    rows = np.repeat(np.arange(len(node)), len(keys) // len(node))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, bits[rows].T.copy()), pa.array(node[rows])], ["key", *names, "node"])
                    continue
                for i in range(len(names)):
                    rows, keys = keys_of(np.ascontiguousarray(bits[:, i]), tables)
                    yield pa.RecordBatch.from_arrays([pa.array(keys + (i << 26)), *map(pa.array, bits[rows].T.copy()), pa.array(node[rows])], ["key", *names, "node"])

    def compare(batches):
        import pyarrow as pa

        def out(a, b, key=None, bits=None, chunk=None):
            n = len(a)
            none = pa.nulls(n, pa.int64())
            shown = [none] * len(names) if bits is None else map(pa.array, bits.T.copy())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else none, none if key is None else pa.array(np.full(n, key)), *shown, none if chunk is None else pa.array(np.full(n, chunk))], ["a", "b", "key", *names, "chunk"])

        def settle(key, bits, node):
            rows, low = forest(key, bits, distance)
            return out(node[rows], node[low])

        def on(key, bits, node, chunk):  # rows of a long bucket go on as numbered chunks
            for at in range(0, len(node), RUN_ROWS):
                yield out(node[at : at + RUN_ROWS], None, key, bits[at : at + RUN_ROWS], chunk + at // RUN_ROWS)

        rest, chunk = (np.zeros(0, np.int64), np.zeros((0, len(names)), np.int64), np.zeros(0, np.int64)), 0  # rows of the last bucket so far, after so many chunks of it
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for r, i in ((rest[0], 0), (rest[2], len(names) + 1)))
            bits = np.concatenate([rest[1], stacked(batch.columns[1:-1])])
            edges = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
            short = np.ones(len(key), bool)
            for i in np.nonzero((np.diff(edges)[:-1] > RUN_ROWS) | ((np.arange(len(edges) - 2) == 0) & (chunk > 0)))[0]:
                s, e = edges[i], edges[i + 1]
                yield from on(key[s], bits[s:e], node[s:e], chunk if i == 0 else 0)
                short[s:e] = False
            s = edges[-2]
            chunk = chunk if s == 0 else 0
            short[s:] = False
            yield settle(key[short], bits[short], node[short])
            ready = (len(key) - s - 1) // RUN_ROWS * RUN_ROWS
            yield from on(key[s], bits[s : s + ready], node[s : s + ready], chunk)
            chunk += ready // RUN_ROWS
            rest = (key[s + ready :], bits[s + ready :], node[s + ready :])
        if chunk:
            yield from on(rest[0][0], rest[1], rest[2], chunk)
        elif len(rest[0]):
            yield settle(*rest)

    def cross(batches):
        import pyarrow as pa

        held = {}
        for batch in batches:
            for name, part in (("pair", batch.column("pair").to_numpy(zero_copy_only=False)), ("bits", stacked(batch.columns[1:-1])), ("node", batch.column("node").to_numpy(zero_copy_only=False))):
                held.setdefault(name, []).append(part)
            pair = np.concatenate(held["pair"])
            cut = int(np.searchsorted(pair, pair[-1])) if len(pair) else 0
            done = {k: np.concatenate(v) for k, v in held.items()}
            held = {k: [v[cut:]] for k, v in done.items()}
            rows, low = forest(done["pair"][:cut], done["bits"][:cut], distance)
            yield pa.RecordBatch.from_arrays([pa.array(done["node"][rows]), pa.array(done["node"][low])], ["a", "b"])
        if held:
            pair, bits, node = (np.concatenate(held[k]) for k in ("pair", "bits", "node"))
            rows, low = forest(pair, bits, distance)
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[low])], ["a", "b"])

    spread_out = distinct.select("node", *names, *([ready] if ready else [])).mapInArrow(tidy(spread), f"key long, {bits_type}, node long")
    n = distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")
    met = checkpointed(spread_out.repartition(int(n), "key").sortWithinPartitions("key", "node").mapInArrow(tidy(compare), f"a long, b long, key long, {bits_type}, chunk long"))
    chunks = met.where("b is null")
    last = chunks.groupBy("key").agg(F.max("chunk").alias("last"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    pairs = chunks.withColumnRenamed("a", "node").join(last, "key").select("key", "chunk", *names, "node", other)
    pairs = pairs.where("chunk <> other").select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("pair"), *names, "node")
    crossed = pairs.repartition(int(n), "pair").sortWithinPartitions("pair", "node").mapInArrow(tidy(cross), "a long, b long")
    return met.where("b is not null").select("a", "b").union(crossed)


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for every row of ``docs``.

    Nulls and texts without words have fingerprint zero, which links like any other. Equal fingerprints are one
    node, named by their smallest doc_id, so large groups of copies add no pairs. ``component_id`` is the smallest
    doc_id that links of at most ``distance`` bits reach; rows without doc_id belong to the component of their
    fingerprint and never name one. An empty table gives an empty result.
    """
    marked = checkpointed(fingerprints(docs, shingle, seed))
    distinct = checkpointed(marked.groupBy("bits").agg(F.min("doc_id").alias("node")))
    found = components(links(distinct.where("node is not null"), distance))
    named = distinct.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``sets`` of numbers whose intersection is ``similarity`` or more of their union; two empty ones are alike."""
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    common = many[column] > 1
    owner, column = owner[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.concatenate([np.zeros(0, np.int64), np.cumsum(np.diff(column[order], prepend=-1) > 0) - 1])
    shared = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        shared += part @ part.T
    union = size[:, None] + size[None, :] - shared
    return np.nonzero(np.triu(shared >= similarity * union - 1e-9, 1))


def verified(texts_of: DataFrame, candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(a, b)``: links that connect all texts of a candidate group whose shingle sets are alike, by exact counts.

    Groups meet in sorted streams, a group of more than about ``SET_ROWS`` texts in pairs of chunks, each a task's own.
    """

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            made = [np.unique(hashes(words_of(t.as_py()), shingle, 0)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(made, pa.binary())], ["node", "component", "chunks", "shingles"])

    def compare(batches):
        import pyarrow as pa

        def settle(node, held):
            node = np.array(node, np.int64)
            low = joined(np.arange(len(node)), *alike([np.frombuffer(x, np.uint64) for x in held], similarity))
            rows = np.nonzero(low != np.arange(len(node)))[0]
            return pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[low[rows]])], ["a", "b"])

        now, node, held = None, [], []
        for batch in batches:
            for pair, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                if pair != now:
                    if len(node) > 1:
                        yield settle(node, held)
                    now, node, held = pair, [], []
                node.append(n)
                held.append(x)
        if len(node) > 1:
            yield settle(node, held)

    n = int(texts_of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = F.ceil(F.count("*") / SET_ROWS).cast("long").alias("chunks")
    sized = candidates.join(candidates.groupBy("component").agg(chunks), "component")
    members = texts_of.join(sized, texts_of["doc_id"] == sized["node"]).select("node", "component", "text", "chunks")
    rows = members.mapInArrow(tidy(sets), "node long, component long, chunks long, shingles binary")
    chunk, other = F.pmod(F.xxhash64("node"), F.col("chunks")), F.col("other")
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.where("chunk <> other or chunks = 1").select(F.xxhash64("component", F.least("chunk", other), F.greatest("chunk", other)).alias("pair"), "node", "shingles")
    return rows.repartition(n, "pair").sortWithinPartitions("pair", "node").mapInArrow(tidy(compare), "a long, b long")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``: groups of near copies.

    Two texts are linked if the sets of their ``shingle``-word shingles have ``similarity`` (a shorter text is one
    shingle; texts without words are equal). Texts of the same words are one node, so large groups of copies add no
    pairs. ``component_id`` is the smallest doc_id that links reach; rows without doc_id belong to the group of their text
    and never name one. Null texts are empty, repeated rows stay, an empty table gives an empty result.

    Candidates are all pairs whose SimHash fingerprints differ in at most four bits, and pairs that least hashes of the
    same sets add, so a pair of similarity 0.8 is missed with probability 0.000005 at most and closer ones less; for a
    ``similarity`` below 0.8 more are missed. What is found is exact. The fingerprint is the majority over the set, each
    shingle once: in that of ``near_duplicates``, which counts repeats, a line that is repeated often decides all bits.
    """

    def mark(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            made, keys = [], []
            for t in batch.column(1):
                words = words_of(t.as_py())
                line = xxhash.xxh3_128_intdigest(b" ".join(words))
                found = np.unique(hashes(words, shingle, 0))
                sketch, of_bands = bands_of(least_hashes(found))
                made.append((line >> 64, line & (1 << 64) - 1, majority(found), *sketch.tolist()))
                keys.append(of_bands.tobytes())
            columns = np.array(made, np.uint64).reshape(-1, 7).view(np.int64).T.copy()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(keys, pa.binary())], ["doc_id", "d1", "d2", "bits", *names, "bands"])

    names = [f"s{i}" for i in range(HASHES // 64)]
    own = texts(docs)
    sketches = own.mapInArrow(tidy(mark), f"doc_id long, d1 long, d2 long, bits long, {', '.join(f'{c} long' for c in names)}, bands binary")
    marked = checkpointed(sketches)
    distinct = checkpointed(marked.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("bits", *names, "bands")]))
    nodes = distinct.where("node is not null")
    lowest = checkpointed(nodes.groupBy("bits").agg(F.min("node").alias("node")))
    equal = nodes.select("bits", F.col("node").alias("a")).join(lowest.withColumnRenamed("node", "b"), "bits").where("a <> b").select("a", "b")
    near = links(lowest, DISTANCE)
    looser = links(nodes.select("node", *names, "bands"), SKETCH_BITS, "bands")
    candidates = checkpointed(components(near.union(equal).union(looser)))
    found = components(verified(own.where("doc_id is not null"), candidates, shingle, similarity))
    named = distinct.join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, ["d1", "d2"]).select("doc_id", "component_id")
