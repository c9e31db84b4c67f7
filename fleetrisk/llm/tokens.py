"""Token ids in fixed-width bit packing, written as shards of blocks that can be read at random.

A shard is a Parquet table of blocks in doc_id order: ``shard, block, first`` (ids of the shard before the block),
``n_ids, bits, packed`` (the ids in the fewest bits that hold the vocabulary, lowest bits first) and, for the documents
that end in the block, ``doc_ids`` and ``doc_ends`` (ids of the shard up to their end). Block offsets make any id
reachable by one unpacking: id ``k`` lies ``(k - first) * bits`` bits into its block.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import chain, compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from fleetrisk.session import ensure_checkpoint_dir

from .common import texts, tidy, worker_cache

BLOCK_IDS = 1 << 16
TEXT_AT_ONCE = 1 << 19  # characters of text whose words are looked up together, at most but for a longer word
CACHE_WORDS = 3 << 19  # words that a Python worker remembers between batches and tasks, some 40 bytes each
RECENT_WORDS = 1 << 16  # of them, those not yet merged with the others
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SCHEMA = "shard int, block int, first long, n_ids int, bits int, packed binary, doc_ids array<long>, doc_ends array<long>"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from the ``start``-th on, without touching those before."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    low = start * bits // 8
    part = np.unpackbits(np.frombuffer(packed, np.uint8, -(-(start + n) * bits // 8) - low, low), bitorder="little")
    part = part[start * bits - 8 * low :][: n * bits].reshape(n, bits)
    return part.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def kinds_of_characters() -> np.ndarray:
    """By code point: 0 letter, 1 number, 2 white space, 3 other, 4 not assigned in this Unicode version."""
    import sys
    import unicodedata

    kind = np.full(sys.maxunicode + 1, 3, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        kind[c] = 0 if k[0] == "L" else 1 if k[0] == "N" else 4 if k in ("Cn", "Cs") else 3
    # fixed values: the code points with the Unicode property White_Space
    kind[[9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 2
    return kind


def word_starts(chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer cuts: ``first`` marks the first character of each text.

    Its words are the contractions 's 't 're 've 'm 'll 'd; letters, numbers or other characters, each with one blank
    before; white space up to the last one before a word. They are found for all texts at once.
    """
    n = len(chars)
    before = np.concatenate([[9], kind[:-1]]).astype(np.uint8)
    before[first] = 9
    final = np.concatenate([first[1:], [True]])
    after = np.concatenate([kind[1:], [9]]).astype(np.uint8)
    after[final] = 9
    blank = np.concatenate([[False], chars[:-1] == 32]) & ~first
    solid = kind != 2
    start = first | (solid & (kind != before) & ~blank)
    start |= (kind == 2) & ((before != 2) | ((after != 2) & (after != 9)))
    apostrophe = np.nonzero(start & (chars == 39))[0]
    if len(apostrophe):
        padded, ends = np.concatenate([chars, [0, 0]]), np.concatenate([final, [True, True]])
        one, two = padded[apostrophe + 1], padded[apostrophe + 2]
        one = np.where(ends[apostrophe], 0, one)
        two = np.where(ends[apostrophe] | ends[apostrophe + 1], 0, two)
        c = lambda x: [ord(i) for i in x]
        short = np.isin(one, c("stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[apostrophe[short | long] + 1] = False
        cut = np.concatenate([apostrophe[short] + 2, apostrophe[long] + 3])
        cut = cut[cut < n]
        start[cut] = True
    return start


#: Where a text can be cut without changing any word: before a blank between a character and an ASCII letter, and
#: between a letter or number and a mark or line end. What follows the cut is a word's first character either way.
CUT = re.compile(r"(?<=\S) (?=[A-Za-z])|(?<=[^\W_])(?=[.,;:!?\n\u3001\u3002])")


def blocks(text: str, size: int):
    """``text`` in parts of ``size`` characters, longer only where nothing but one word follows."""
    low = 0
    while len(text) - low > size:
        cut, at, step = low, low + size, size
        while cut == low and at < len(text):
            back = max(low + 1, at - 4096)
            last = None
            for last in CUT.finditer(text, back, at):
                pass
            found = last or CUT.search(text, at)
            cut, at = (found.start(), at) if found else (low, len(text))
        if cut == low:
            break
        yield text[low:cut]
        low = cut
    yield text[low:] if low else text


class Encoder:
    """Ids of many texts: words are cut for all texts at once, distinct ones are looked up, new ones are encoded and
    remembered, and numpy puts the ids together.

    The library cuts words before it merges, so the ids of a text are those of its words. Texts with code points
    that Unicode versions may class differently go to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.plain_added = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.line = self.library.encode("\n", add_special_tokens=False).ids
        self.kinds = kinds_of_characters()
        rng = np.random.default_rng(5)
        self.values = rng.integers(1, 1 << 63, len(self.kinds), np.uint64)
        self.powers, self.inverse = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.uint64)] * 2
        self.forget()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self) -> None:
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.known, self.recent = nothing, nothing
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def lookup(self, digest: np.ndarray, check: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in ``self.flat``, and how many there are.

        Words are known by two digests of 64 bits; ``digest`` is sorted, and ``word(i)`` cuts out the i-th, which only
        new words need. Known words lie in two sorted tables, of which the small one takes new words in.
        """
        if len(self.known[0]) + len(self.recent[0]) + len(digest) > CACHE_WORDS:
            self.forget()
        base, many, new = np.zeros(len(digest), np.int64), np.zeros(len(digest), np.int32), np.ones(len(digest), bool)
        for keys, checks, bases, sizes in (self.known, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, digest), len(keys) - 1)
                hit = (keys[at] == digest) & (checks[at] == check)
                base[hit], many[hit] = bases[at[hit]], sizes[at[hit]]
                new &= ~hit
        rows = np.nonzero(new)[0]
        if len(rows):
            ids, sizes = self.encoded([word(i) for i in rows.tolist()])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used // 4 + 2 * len(ids), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            base[rows], many[rows] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used += len(ids)
            self.recent = self.merged(self.recent, (digest[rows], check[rows], base[rows], many[rows]))
            if len(self.recent[0]) > RECENT_WORDS:
                self.known, self.recent = self.merged(self.known, self.recent), tuple(c[:0] for c in self.recent)
        return base, many

    @staticmethod
    def merged(left: tuple, right: tuple) -> tuple:
        both = [np.concatenate(c) for c in zip(left, right)]
        order = np.argsort(both[0], kind="stable")
        return tuple(c[order] for c in both)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words``, one after the other, and how many each has.

        Words of letters are encoded as lines of one text: the pre-tokenizer cuts a line end from letters on both sides.
        """
        lines = [w.isalpha() or w[0] == " " and w[1:].isalpha() for w in words]
        own = list(compress(words, lines))
        ids = np.array(self.library.encode_batch_fast(["\n".join(own) + "\n"], add_special_tokens=False)[0].ids, np.uint32) if own else np.zeros(0, np.uint32)
        ends = np.nonzero(ids == self.line[0])[0]
        if len(self.line) != 1 or len(ends) != len(own):
            lines, own, ids, ends = [False] * len(words), [], ids[:0], ends[:0]
        rest = [e.ids for e in self.library.encode_batch_fast([w for w, line in zip(words, lines) if not line], add_special_tokens=False)]
        lines, sizes = np.array(lines, bool), np.empty(len(words), np.int64)
        sizes[lines] = np.diff(ends, prepend=-1) - 1
        sizes[~lines] = [len(e) for e in rest]
        out = np.empty(int(sizes.sum()), np.uint32)
        of_line = np.repeat(lines, sizes)
        out[of_line] = np.delete(ids, ends)
        out[~of_line] = np.fromiter(chain.from_iterable(rest), np.uint32)
        return out, sizes

    @staticmethod
    def _powers(factor: int, size: int) -> np.ndarray:
        out = np.full(size + 1, factor, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def digests(self, chars: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
        """A polynomial hash modulo 2^64 of each word, from running sums over all characters."""
        n, factor = len(chars), MULTIPLIERS[which]
        with np.errstate(over="ignore"):
            if len(self.powers[which]) <= n:
                size = 1 << n.bit_length()
                self.powers[which] = self._powers(factor, size)
                self.inverse[which] = self._powers(pow(factor, -1, 1 << 64), size)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[chars] * self.powers[which][:n])])
            return (sums[np.append(at[1:], n)] - sums[at]) * self.inverse[which][at]

    def parts(self, texts: list[str], at_once: int = TEXT_AT_ONCE):
        """``(text number, is last part, ids)`` for each text in turn; no more than some ``at_once`` characters are
        worked on together, so memory does not follow the length of a text."""
        group, size = [], 0

        def done():
            yield from ((i, last, ids) for (i, last, _), ids in zip(group, self.batch([g[2] for g in group])))

        for i, text in enumerate(texts):
            spans = [text]
            if self.marks and self.marks.search(text):
                if not self.plain_added:
                    yield from done()
                    group, size = [], 0
                    yield i, True, self.ids(text)
                    continue
                spans = self.marks.split(text)
            for k, span in enumerate(spans):
                final = k == len(spans) - 1
                if k % 2:
                    yield from done()
                    group, size = [], 0
                    yield i, final, np.array([self.added[span]], np.uint32)
                    continue
                for block in blocks(span, at_once) if len(span) > at_once else (span,):
                    if size + len(block) > at_once and group:
                        yield from done()
                        group, size = [], 0
                    group.append([i, False, block])
                    size += len(block)
                group[-1][1] = final
        if group:
            yield from done()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.uint32) for _ in texts]
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        kind = self.kinds[chars]
        first = np.zeros(len(chars), bool)
        first[begins[lengths > 0]] = True
        odd = np.zeros(len(texts), bool)
        unknown = np.nonzero(kind == 4)[0]
        odd[np.searchsorted(begins, unknown, "right") - 1] = True
        at = np.nonzero(word_starts(chars, kind, first))[0]
        digest, check = self.digests(chars, at, 0), self.digests(chars, at, 1)
        _, example, which = np.unique(digest, return_index=True, return_inverse=True)
        if not np.array_equal(check[example][which], check):  # two words with one digest: practically never, and then still right
            return [self.ids(t) for t in texts]
        stop = np.append(at[1:], len(chars))
        begin, end = at[example], stop[example]
        base, many = self.lookup(digest[example], check[example], lambda i: whole[begin[i] : end[i]])
        base, each = base[which], many[which]
        ends = np.cumsum(each)
        ids = self.flat[np.repeat(base - (ends - each), each) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.searchsorted(at, np.concatenate([begins, [len(chars)]]))]
        return [self.ids(t) if odd[i] else ids[bounds[i] : bounds[i + 1]] for i, t in enumerate(texts)]


def vocabulary_bits(tokenizer_json: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_str(tokenizer_json).get_vocab_size() - 1).bit_length())


def write(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write shards in ascending doc_id order below ``path``.

    One range shuffle on doc_id orders the texts (ids that are null first; equal ids by the hash of the text, so that very many texts of one id are split as well); every partition is one
    shard. Ids are carried from block to block, so memory is bounded by a batch and a block, for documents of any
    length up to a row's. Repeated rows are written as often as they come; an empty table gives a table without rows.
    """
    bits = vocabulary_bits(tokenizer_json)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        cache, name = worker_cache(), ("encoder", zlib.crc32(tokenizer_json.encode()), len(tokenizer_json))
        encoder, shard = cache.setdefault(name, None) or Encoder(tokenizer_json), TaskContext.get().partitionId()
        cache[name] = encoder
        held, have, block, first, doc_ids, doc_ends = [], 0, 0, 0, [], []
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["shard", "block", "first", "n_ids", "bits", "packed", "doc_ids", "doc_ends"]

        def rows(last: bool):
            nonlocal held, have, block, first, doc_ids, doc_ends
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            at = 0
            while have - at >= block_ids or last and (have > at or doc_ids):
                part = ids[at : at + block_ids]
                n = int(np.searchsorted(doc_ends, first + len(part), "right"))
                values = (shard, block, first, len(part), bits, pack(part, bits), doc_ids[:n], doc_ends[:n])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)
                doc_ids, doc_ends, at, block, first = doc_ids[n:], doc_ends[n:], at + len(part), block + 1, first + len(part)
            held, have = [ids[at:]], have - at

        for batch in batches:
            of = batch.column(0).to_pylist()
            for i, final, ids in encoder.parts(t.as_py() for t in batch.column(1)):
                held.append(ids)
                have += len(ids)
                if final:
                    held.append(np.array([end_id], np.uint32))
                    have += 1
                    doc_ids.append(of[i])
                    doc_ends.append(first + have)
                if have >= block_ids:
                    yield from rows(False)
        yield from rows(True)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = texts(docs).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(tidy(run), SCHEMA).write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every document, from the files alone.

    The starts of shards are sums over one small row for each shard. A document that spans blocks is put together by a
    stream over its shard's blocks in order, which keeps a running checksum and no ids.
    """
    blocks = spark.read.schema(T._parse_datatype_string(SCHEMA)).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def run(batches):
        import pyarrow as pa

        shard, crc, done = None, 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, crc, done = r["shard"], 0, 0
                at = 0
                for doc_id, end in zip(r["doc_ids"], r["doc_ends"]):
                    crc = zlib.crc32(unpack(r["packed"], r["bits"], end - r["first"] - at, at).astype("<u4").tobytes(), crc)
                    out.append((doc_id, done, end - done, crc, shard))
                    at, done, crc = end - r["first"], end, 0
                if at < r["n_ids"]:
                    crc = zlib.crc32(unpack(r["packed"], r["bits"], r["n_ids"] - at, at).astype("<u4").tobytes(), crc)
            kinds = [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["doc_id", "in_shard", "n_tokens", "ids_crc32", "shard"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(n, "shard").sortWithinPartitions("shard", "block").mapInArrow(tidy(run), "doc_id long, in_shard long, n_tokens long, ids_crc32 long, shard int")
    return found.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for results in the shared place the session names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
