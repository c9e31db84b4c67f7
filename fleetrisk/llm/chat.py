"""Chat formatting by columnar byte assembly.

A turn becomes ``### role``, a line end, its text, ``</turn>`` and a line end. Inside roles and texts a backslash goes
before every backslash and into every ``###`` and ``</turn>`` (after the first character), so neither string occurs
but as a mark, and taking out each backslash that stands before a character gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_binary, tidy

HEAD, LINE, TAIL = b"### ", b"\n", b"</turn>\n"
PART_BYTES = 8 << 20  # text of the turns that are put together in one buffer; a longer turn has one of its own
SCATTER_BYTES = 1 << 20
SCHEMA = "conv_id long, part int, formatted string, loss_start array<long>, loss_end array<long>"


def escapes(data: np.ndarray, offsets: np.ndarray, lines: bool = False) -> np.ndarray:
    """Sorted places before which a backslash is put; control strings never reach across rows. ``lines``: line ends too."""
    found = [np.nonzero(data == 92)[0]]
    owner_end = lambda at: offsets[np.searchsorted(offsets, at, "right")]
    for mark in (b"###", b"</turn>"):
        at = np.nonzero(data == mark[0])[0]
        at = at[at + len(mark) <= len(data)]
        for i, c in enumerate(mark[1:], 1):
            at = at[data[at + i] == c]
        found.append(at[at + len(mark) <= owner_end(at)] + 1 if len(at) else at)
    if lines:
        found.append(np.nonzero(data == 10)[0])
    return np.sort(np.concatenate(found))


def assemble(role, text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns of Arrow columns ``role`` and ``text``, the turns' offsets, and their texts' starts and ends.

    All lengths are summed first; then every segment is scattered to its place in one preallocated buffer.
    """
    columns = []
    for column, lines in ((role, True), (text, False)):
        data, offsets = arrow_binary(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        put = escapes(data, offsets, lines)
        columns.append((data, offsets, put, np.diff(offsets) + np.diff(np.searchsorted(put, offsets))))
    role_size, text_size = columns[0][3], columns[1][3]
    fixed = len(HEAD) + len(LINE) + len(TAIL)
    ends = np.cumsum(role_size + text_size + fixed)
    starts = ends - (role_size + text_size + fixed)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    role_at = starts + len(HEAD)
    text_at = role_at + role_size + len(LINE)
    for (data, offsets, put, _), at in zip(columns, (role_at, text_at)):
        before = np.searchsorted(put, offsets[:-1])
        for low in range(0, len(data), SCATTER_BYTES):  # places of some bytes at a time, as they take many times their room
            index = np.arange(low, min(low + SCATTER_BYTES, len(data)))
            owner = np.searchsorted(offsets, index, "right") - 1
            place = at[owner] + index - offsets[owner] + np.searchsorted(put, index, "right") - before[owner]
            out[place] = data[low : low + SCATTER_BYTES]
            marks = put[np.searchsorted(put, low) : np.searchsorted(put, low + len(index))]
            out[place[marks - low] - 1] = 92
    for mark, at in ((HEAD, starts), (LINE, role_at + role_size), (TAIL, text_at + text_size)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return out, np.concatenate([[0], ends]), text_at, text_at + text_size


def slices(batches):
    """Batches cut where their texts make up ``PART_BYTES``."""
    for batch in batches:
        bounds, at = arrow_binary(batch.column(2))[1], 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PART_BYTES, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def render(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """``conv_id, part, formatted, loss_start, loss_end``: conversations in the template, in parts.

    Rows are ordered by turn, nulls first, equal turns by role and text; null roles and texts are empty; repeated rows
    stay. A conversation is one part for each ``PART_BYTES`` that it spans, numbered in order, so one of any length passes
    its task as a stream. The loss mask holds the byte ranges of assistant texts in each part. Null ids are one
    conversation of their own.
    """
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        last, part = ("none",), 0
        for batch in slices(batches):
            out, offsets, text_start, text_end = assemble(batch.column(1), batch.column(2))
            ids = batch.column(0).to_pylist()
            cuts = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
            stops, parts = [*cuts[1:], len(ids)], []
            for c in cuts:
                part = part + 1 if last == (ids[c],) else 0
                parts.append(part)
                last = (ids[c],)
            bounds = offsets[[*cuts, len(ids)]].astype(np.int64)
            formatted = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())
            wanted = np.array([r == "assistant" for r in batch.column(1).to_pylist()])
            spans = [(np.nonzero(wanted[a:b])[0] + a, bounds[i]) for i, (a, b) in enumerate(zip(cuts, stops))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[c] for c in cuts], pa.int64()), pa.array(parts, pa.int32()), formatted, pa.array([text_start[k] - at for k, at in spans], pa.list_(pa.int64())), pa.array([text_end[k] - at for k, at in spans], pa.list_(pa.int64()))],
                ["conv_id", "part", "formatted", "loss_start", "loss_end"],
            )

    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(tidy(run), SCHEMA)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of conversations from formatted parts alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    The parts of a conversation pass one task in order and only running digests are kept.
    """

    def run(batches):
        import pyarrow as pa

        def row():
            return (now[0], turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars)

        now = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now != (r["conv_id"],):
                    if now:
                        out.append(row())
                    now, turns, whole, loss, loss_chars, chars = (r["conv_id"],), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                text, at = r["formatted"], 0
                chars += len(text)
                for m in TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {r['conv_id']} is not in the template")
                    at, turns = m.end(), turns + 1
                    whole.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                data = text.encode()
                for a, b in zip(r["loss_start"], r["loss_end"]):
                    said = unescape(data[a:b].decode())
                    loss_chars += len(said)
                    loss.update(said.encode())
            yield batch_of(pa, out)
        if now:
            yield batch_of(pa, [row()])

    def batch_of(pa, rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
