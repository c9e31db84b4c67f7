"""Suffix-array dedup: bytes of long strings that occurred earlier, by the tree of common-prefix intervals.

Every 100-byte string has an anchor, the run of ``GRAM`` bytes in it with the least hash. Equal strings have equal
anchors at equal places, so strings meet by anchor: anchors that occur once are dropped, the others go on as snippets,
the bytes of all windows of one anchor occurrence. Snippets with one anchor form an enhanced suffix array: window starts
in sorted order with the common prefixes of neighbours. One scan with a stack walks its intervals; an interval whose
occurrences differ in the byte before (or begin a snippet) is a maximal repeat, given out with all occurrences.

An anchor that occurs very often is divided: its windows meet by longer runs that they share, in the end by the whole
window, so that no group with different contents grows with the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_binary, checkpointed, tidy

LENGTH = 100
GRAM = 28
WARM, HOT = 2000, 100_000  # occurrences from which windows meet in eights, and one by one
TEXT_AT_ONCE = 1 << 20
COMBINE_BYTES = 64 << 20  # snippets of a task among which equal ones are combined before the shuffle
GROUP_BYTES = 1 << 20  # snippet bytes of whole groups that are sorted together
LAST = (1 << 63) - 1
FACTOR = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Hash modulo 2^64 of every run of ``n`` bytes, by doubling, well mixed."""
    with np.errstate(over="ignore"):
        seeds = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64)
        have, power, size, out, length = seeds[data], np.uint64(FACTOR), 1, None, 0
        while n:
            if n & 1:
                m = len(data) - length - size + 1
                out = have if out is None else out[:m] * power + have[length : length + m]
                length += size
            n >>= 1
            if n:
                m = len(have) - size
                have, power, size = have[:m] * power + have[size : size + m], power * power, 2 * size
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def window_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor place of every window of ``length`` bytes (leftmost least hash), and the hashes by place."""
    hashes = rolling(data, gram)
    span, size = length - gram + 1, 1
    # the upper half of the hash and the place in one number, so that the least one is the leftmost least hash
    least = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, hashes


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in its text and hash of the anchors of all windows that lie within one text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, hashes = window_anchors(data)
    first, last = offsets[:-1], offsets[1:] - LENGTH
    inside = np.zeros(len(data) + 1, np.int64)
    real = last >= first
    np.add.at(inside, first[real], 1)
    np.add.at(inside, last[real] + 1, -1)
    at = np.unique(at[np.cumsum(inside)[: len(at)] > 0])
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at - offsets[row], hashes[at].view(np.int64)


def by_size(offsets: np.ndarray, limit: int):
    """Ranges of rows of about ``limit`` bytes; a longer row goes alone."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``gram, doc_id, place`` of every anchor of ``docs(doc_id, text, order, h1, h2)``.

    Of equal texts (equal hashes) that come in one batch, only the first by ``order`` is read: it alone can be the one
    that is searched.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            order, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            by = np.lexsort((order, h2, h1))
            first = np.ones(len(by), bool)
            first[by[1:]] = (h1[by[1:]] != h1[by[:-1]]) | (h2[by[1:]] != h2[by[:-1]])
            batch = batch.filter(pa.array(first))
            data, offsets = arrow_binary(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in by_size(offsets, TEXT_AT_ONCE):
                row, place, gram = anchors_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids[a:b][row]), pa.array(place.astype(np.int32))], ["gram", "doc_id", "place"])

    return docs.mapInArrow(tidy(run), "gram long, doc_id long, place int")


def snippets_of(text: bytes, places: np.ndarray, counts: np.ndarray, grams: list | None = None) -> list[tuple[int, int, bytes]]:
    """Key, start and bytes of the windows of each of the anchors at ``places``, which occur ``counts`` times.

    With ``grams``, the hash of each anchor with a count, anchors of other texts may be among them: a count holds where the
    text has that hash.
    """
    data = np.frombuffer(text, np.uint8)
    at, hashes = window_anchors(data)
    if grams is not None:
        own, signed = {}, hashes.view(np.int64)
        for place, count, gram in zip(places.tolist(), counts.tolist(), grams):
            if not count:
                own.setdefault(place, 0)
            elif place < len(signed) and int(signed[place]) == gram:
                own[place] = count
        places = np.array(sorted(own), np.int64)
        counts = np.array([own[p] for p in places.tolist()], np.int64)
    starts = np.searchsorted(at, places, "left")  # anchors of successive windows never go back
    ends = np.searchsorted(at, places, "right")
    out, shared = [], {}
    for place, count, s, e in zip(places.tolist(), counts.tolist(), starts.tolist(), ends.tolist()):
        if s == e:
            continue
        step = 1 if count > HOT else 8 if count > WARM else 0
        if not step:
            out.append((int(hashes[place].view(np.int64)), s, text[s : e + LENGTH - 1]))
            continue
        if step not in shared:
            shared[step] = rolling(data, LENGTH - step + 1)
        # windows are divided by how far before the anchor they start, so equal windows fall into equal divisions
        for offset in range((place - e + 1) // step * step, place - s + 1, step):
            low, high = max(s, place - offset - step + 1), min(e - 1, place - offset)
            if low <= high:
                core = place - offset  # the bytes that all windows of the division share begin at its last start
                key = np.uint64(int(shared[step][core]) ^ (offset + 1) * FACTOR & (1 << 64) - 1)
                out.append((int(key.view(np.int64)), low, text[low : high + LENGTH]))
    return out


def repeat_groups(lcp: np.ndarray, before: np.ndarray, least: int):
    """Maximal repeats ``(length, first, last)`` of an enhanced suffix array, by one scan with a stack of open intervals.

    ``lcp[i]`` is the common prefix of entries i and i + 1, ``before`` the byte before each entry, or a number below 0 of
    its own where nothing may stand before. An interval is maximal if its entries have more than one such byte.
    """
    stack: list[list] = []  # length, first entry, the one byte before all entries so far or None
    lcp, before = lcp.tolist(), before.tolist()
    for i, now in enumerate([*lcp, 0]):
        first, left = i, before[i]
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            left = own if own == left else None
            if left is None:
                yield length, first, i
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = left if stack[-1][2] == left else None
            else:
                stack.append([now, first, left])


def earlier(group: list[tuple[tuple, bytes]]) -> list[tuple[tuple, int, int]]:
    """Ranges of snippets, given in order as (owner, bytes), that also start in an earlier one or earlier in the same.

    A snippet equal to an earlier one is a range as a whole and leaves the array. Windows of different anchors never
    are equal, so snippets of many anchors are sorted together.
    """
    out, seen, kept = [], set(), []
    for owner, text in group:
        if text in seen:
            out.append((owner, 0, len(text)))
        else:
            seen.add(text)
            kept.append((owner, text))
    width = max((len(t) for _, t in kept), default=0)
    windows = np.array([len(t) - LENGTH + 1 for _, t in kept], np.int64)
    if windows.sum() < 2:
        return out
    data = np.frombuffer(b"".join(t for _, t in kept) + bytes(width), np.uint8)
    sizes = windows + LENGTH - 1
    base = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(kept)), windows)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    start, rest = base[which] + inside, sizes[which] - inside
    # only windows whose first LENGTH bytes come again can share an interval; the others leave no gap in one
    hashes = rolling(data, LENGTH)[start]
    order = np.argsort(hashes)
    again = hashes[order[1:]] == hashes[order[:-1]]
    repeated = np.zeros(len(start), bool)
    repeated[order[1:][again]] = repeated[order[:-1][again]] = True
    if not repeated.any():
        return out
    which, inside, start, rest = which[repeated], inside[repeated], start[repeated], rest[repeated]
    rows = np.lib.stride_tricks.sliding_window_view(data, width)[start]
    rows[np.arange(width)[None, :] >= rest[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{width}").ravel(), kind="stable")
    a, b = order[:-1], order[1:]
    differs = rows[a] != rows[b]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    lcp = np.minimum(common, np.minimum(rest[a], rest[b]))
    lcp[lcp < LENGTH] = 0
    before = np.where(inside > 0, data[start - 1].astype(np.int64), -1 - which)[order]
    near = np.nonzero(lcp)[0]
    if not len(near):
        return out
    for run in np.split(near, np.nonzero(np.diff(near) > 1)[0] + 1):  # entries without a neighbour alike need no scan
        low = int(run[0])
        for length, first, last in repeat_groups(lcp[run], before[low : low + len(run) + 1], LENGTH):
            found = order[low + first : low + last + 1]
            for k in found[found != found.min()].tolist():
                out.append((kept[which[k]][0], int(inside[k]), int(inside[k]) + length))
    return out


def spans_by_anchor(snippets: DataFrame) -> DataFrame:
    """``doc_id, low, high`` from ``key, doc_id, start, stop, bytes``: groups in a sorted stream, many small ones at once.

    Rows of a key come by document and start. A key with more bytes than ``GROUP_BYTES`` goes on in rounds: what an
    earlier round found new stays as the beginning of the next.
    """

    def run(batches):
        import pyarrow as pa

        def emit(found):
            merged = {}
            for (doc, at), low, high in found:
                merged.setdefault(doc, []).append((at + low, at + high))
            rows = [(doc, a, b) for doc, spans in merged.items() for a, b in merge(spans)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "low", "high"])

        last = None
        held, size, key, begun = [], 0, None, 0  # snippets, their bytes, the last key and where it begins
        for batch in batches:
            known = []
            for k, doc, start, stop, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:  # found before the shuffle
                    known.append(((doc, 0), start, stop))
                    continue
                if (k, doc, start) == last:  # a repeated row
                    continue
                last = (k, doc, start)
                if k != key:
                    if size >= GROUP_BYTES:
                        yield emit(earlier(held))
                        held, size = [], 0
                    key, begun = k, len(held)
                elif size >= GROUP_BYTES and (begun or len(held) - begun > 1):
                    if begun:  # whole keys before this one
                        yield emit(earlier(held[:begun]))
                        held, begun = held[begun:], 0
                        size = sum(len(t) for _, t in held)
                    if size >= GROUP_BYTES:
                        found = earlier(held)
                        yield emit(found)
                        held = novel(held, found)
                        size = min(GROUP_BYTES // 2, sum(len(t) for _, t in held))
                held.append(((doc, start), text))
                size += len(text)
            yield emit(known)
        yield emit(earlier(held))

    n = int(snippets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = snippets.repartition(n, "key").sortWithinPartitions("key", "doc_id", "start")
    return ordered.mapInArrow(tidy(run), "doc_id long, low int, high int")


def novel(held: list, found: list) -> list:
    """Snippets with a window that no earlier one has: those that no single range covers as a whole."""
    whole = {owner for owner, low, high in found if low == 0}
    size = {owner: len(text) for owner, text in held}
    covered = {owner for owner, low, high in found if owner in whole and low == 0 and high == size[owner]}
    return [(owner, text) for owner, text in held if owner not in covered]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Bytes go that a 100-byte string covers which starts earlier too, in a smaller doc_id or earlier in the text; strings
    are judged on the input. Null texts are empty. Rows that repeat a doc_id are ordered by text hash, rows without a
    doc_id come last; rows equal in both are one document and get one result. Of equal texts the first is searched and
    the others go whole, so a group of copies of any size is one row of a sum.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    ids = checkpointed(rows.select("doc_id", "h1", "h2").distinct())
    ranked = ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
    # texts that are searched are numbered in order, as several may share an id or have none
    kept_ids = ranked.select(F.col("first_id").alias("doc_id"), "h1", "h2").orderBy("doc_id", "h1", "h2")
    kept_ids = checkpointed(kept_ids.withColumn("number", F.monotonically_increasing_id()))

    # anchors of texts that share an id come together, and each text takes its own; those without one go by text hash
    owner = F.when(F.col("doc_id") < LAST, F.col("doc_id")).otherwise(F.col("h1"))
    found = anchor_rows(rows.select(owner.alias("doc_id"), "text", F.col("doc_id").alias("order"), "h1", "h2")).withColumnRenamed("doc_id", "owner")
    counts = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    warm = F.col("n") > WARM
    flagged = found.join(counts, "gram").select("owner", "place", F.when(warm, F.col("n")).alias("n"), F.when(warm, F.col("gram")).alias("gram"))
    flagged = flagged.groupBy("owner").agg(F.array_sort(F.collect_set(F.struct("place", "n", "gram"))).alias("anchors"))
    # both joins of the texts are on the same keys, so Spark shuffles the texts once and reads that shuffle twice
    searched = rows.join(flagged.join(kept_ids.withColumn("owner", owner), "owner"), ["doc_id", "h1", "h2"]).select("number", "text", "anchors")

    def cut(batches):
        import pyarrow as pa

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "doc_id", "start", "stop", "bytes"])

        def spans(later):
            merged = {}
            for doc, a, b in later:
                merged.setdefault(doc, []).append((a, b))
            return out([(doc, doc, a, b, None) for doc, found in merged.items() for a, b in merge(found)])

        first, size, later = {}, 0, []  # of equal snippets in this task only the first goes on; the others are repeats as a whole
        for batch in batches:
            for doc, text, anchors in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                if len(data) < LENGTH:
                    continue
                for key, start, part in snippets_of(data, np.array([x["place"] for x in anchors]), np.array([x["n"] or 0 for x in anchors]), [x["gram"] for x in anchors]):
                    own, known = (doc, start), first.get((key, part))
                    if known == own:  # a repeated row
                        continue
                    if known is None:
                        size += len(part) + 100
                    if known is None or own < known:
                        first[key, part] = own
                        own = known
                    if own:
                        later.append((own[0], own[1], own[1] + len(part)))
                if size >= COMBINE_BYTES:
                    yield out([(key, *own, own[1] + len(part), part) for (key, part), own in first.items()])
                    first, size = {}, 0
                if len(later) >= 100_000:
                    yield spans(later)
                    later = []
        yield out([(key, *own, own[1] + len(part), part) for (key, part), own in first.items()])
        yield spans(later)

    spans = spans_by_anchor(searched.mapInArrow(tidy(cut), "key long, doc_id long, start int, stop int, bytes binary"))
    spans = spans.groupBy(F.col("doc_id").alias("number")).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    first = kept_ids.join(spans, "number", "left").drop("number").withColumn("first", F.lit(True))
    marks = ids.join(first, ["doc_id", "h1", "h2"], "left").select("doc_id", "h1", "h2", F.coalesce("first", F.lit(False)).alias("first"), "spans")
    whole = rows.join(marks, ["doc_id", "h1", "h2"]).select(F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "text", "first", "spans")

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, is_first, found_spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                cuts = merge([(s["low"], s["high"]) for s in found_spans or []]) if is_first else [(0, len(data))] if len(data) >= LENGTH else []
                digest, at = hashlib.sha256(), 0
                for low, high in cuts:
                    digest.update(data[at:low])
                    at = high
                digest.update(data[at:])
                out.append((len(data), sum(b - a for a, b in cuts), len(cuts), digest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return whole.mapInArrow(tidy(clean), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
