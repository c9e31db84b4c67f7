"""Collocations: phrases whose words occur together more often than their parts suggest.

Running sums of a polynomial over the bytes give every word a fingerprint, and running sums over the words give every
phrase one, so no phrase is cut out to be counted. Each length has its own pass over the texts: a phrase can reach the
least count only if both phrases that lack its first or its last word do, so the others are passed over. A shuffle sums
the fingerprints and keeps an occurrence of each; only frequent ones are cut out of the documents they point to.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_binary, tidy
from .tokens import shared_path

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
CONTAINED_PERCENT = 100
SCALE = 1000
BYTES_AT_ONCE = (1 << 20) - 1  # bytes whose words are found together; tables of powers have one entry more
ENTRIES = 2 << 20  # distinct fingerprints that a task holds before it passes them on
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28  # a filter has 16 bits for each entry, 32 MB at most

#: What parts pieces is 2, what parts words 1; A-Z are lower-cased. All are single bytes in UTF-8.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

FACTORS = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
VALUES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def language_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Hasher:
    """Fingerprints of words and phrases by running polynomial sums modulo 2^64; powers grow with the longest slice."""

    def __init__(self):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def powers(self, factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.tables.get(factor)
        if have is None or len(have[0]) < size:
            size = 1 << (size - 1).bit_length()
            have = self.tables[factor] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (factor, pow(factor, -1, 1 << 64)))
        return have

    def ranges(self, values: np.ndarray, factor: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The polynomial of ``values[start:end]`` for each range."""
        power, inverse = self.powers(factor, len(values) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)])])
        return (sums[ends] - sums[starts]) * inverse[starts]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = LOWER[data]
        return tuple(mixed(self.ranges(VALUES[i][low], FACTORS[i][0], starts, ends)) for i in (0, 1))

    def phrases(self, words: tuple[np.ndarray, np.ndarray], key: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and check of the ``n`` words from each start on; ``key`` is the language's, for each start."""
        found = [mixed(self.ranges(w, FACTORS[i][1], starts, starts + n) + key + np.uint64(n)) for i, w in enumerate(words)]
        return found[0], found[1]


def find_words(data: np.ndarray, bounds: np.ndarray):
    """Starts, ends, piece and document of the words of the documents that begin at ``bounds`` (the last is their end)."""
    kind = KIND[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    word = kind == 0
    starts = np.nonzero(word & ~(np.concatenate([[False], word[:-1]]) & ~begins[:-1]))[0]
    ends = np.nonzero(word & ~(np.concatenate([word[1:], [False]]) & ~begins[1:]))[0] + 1
    piece = np.cumsum((kind == 2) | begins[:-1])[starts] if len(data) else starts
    return starts, ends, piece, np.searchsorted(bounds, starts, "right") - 1


def slices(batches, overlap: int):
    """``data, bounds, key, lang key`` of some ``BYTES_AT_ONCE`` bytes of texts at once, from columns key, lang, text.

    A longer text is cut before a blank or a mark that ends pieces; a cut inside a piece takes the last ``overlap``
    words along to the next slice, where they are too few to be counted again.
    """
    known: dict[str, int] = {}
    for batch in batches:
        data, offsets = arrow_binary(batch.column(2))
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        langs = np.fromiter((known.get(x) or known.setdefault(x, language_key(x)) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BYTES_AT_ONCE, "right")) - 1)
            low, high = int(offsets[i]), int(offsets[j])
            if j > i + 1 or high - low <= BYTES_AT_ONCE:
                yield data[low:high], offsets[i : j + 1] - low, keys[i:j], langs[i:j]
                i = j
                continue
            while low < high:
                stop, following = low, high
                while stop < high:
                    stop = min(high, stop + BYTES_AT_ONCE)
                    gaps = np.nonzero(KIND[data[low + 1 : stop]])[0]
                    if stop == high or not len(gaps):
                        continue
                    cut = low + 1 + int(gaps[-1])
                    starts, _, piece, _ = find_words(data[low:cut], np.array([0, cut - low]))
                    if not overlap or not len(starts) or (KIND[data[low + starts[-1] : cut]] == 2).any():
                        stop = following = cut
                        break
                    carried = int(starts[piece == piece[-1]][-overlap:][0])
                    if carried:
                        stop, following = cut, low + carried
                        break
                yield data[low:stop], np.array([0, stop - low]), keys[i : i + 1], langs[i : i + 1]
                low = following
            i = j


def within_pieces(piece: np.ndarray, n: int) -> np.ndarray:
    """Where ``n`` words of one piece begin."""
    return np.nonzero(piece[: max(0, len(piece) - n + 1)] == piece[n - 1 :])[0] if len(piece) >= n else np.zeros(0, np.int64)


def in_filter(bits: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    at = fingerprint & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def build_filter(rows: DataFrame, column: str, count: int):
    """A broadcast bit for every value of ``column``, 2^MOST_BITS bits at most whatever the rows, so the driver passes on
    32 MB at most. Fewer bits than values only let more through, which is counted in full and falls by its count."""
    size = 1 << max(LEAST_BITS, min(MOST_BITS, (BITS_EACH * max(count, 1) - 1).bit_length()))
    piece = min(size, 1 << 20)

    def run(batches):
        import pyarrow as pa

        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(at // piece).tolist():
                own = pieces.setdefault(c, np.zeros(piece, np.uint8))
                own[at[at // piece == c] % piece] = 1
        for c, own in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    at = rows.select(F.expr(f"`{column}` & {size - 1}").alias("at"))
    dealt = at.repartition(max(1, size // piece), F.expr(f"at div {piece}"))
    bits = np.zeros(size // 8, np.uint8)
    for r in dealt.mapInArrow(tidy(run), "piece long, bits binary").collect():
        bits[r.piece * piece // 8 : (r.piece + 1) * piece // 8] |= np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits.tobytes())


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, lang, text``: null text is empty, null language ``und``; ``doc`` points to a document by 40 bits of a hash of
    its id and text. Where documents share them, all are asked for the phrase."""
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("lang"), F.lit("und"))
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), lang, text).bitwiseAND((1 << 40) - 1).alias("doc"), lang.alias("lang"), text.alias("text"))


def count_phrases(docs: DataFrame, n: int, shorter=None) -> DataFrame:
    """``words, fingerprint, check, n, doc`` of every phrase of ``n`` words that can be frequent: its occurrences and the
    smallest key of a document that has it. ``shorter`` is the filter of frequent phrases of ``n - 1`` words. The pass
    over single words also gives the words of each language, as rows of 0 words under the language's key.

    Each task sums up equal fingerprints before the shuffle, so a very frequent phrase has a row for each task.
    """

    def run(batches):
        import pyarrow as pa

        hasher, held, size, totals = Hasher(), [], 0, {}
        bits = np.frombuffer(shorter.value, np.uint8) if shorter else None

        def combined(parts):
            fingerprint, check, times, doc = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(fingerprint)
            fingerprint, check = fingerprint[order], check[order]
            starts = np.nonzero(np.concatenate([[True], (fingerprint[1:] != fingerprint[:-1]) | (check[1:] != check[:-1])]))[0]
            return fingerprint[starts], check[starts], np.add.reduceat(times[order], starts), np.minimum.reduceat(doc[order], starts)

        def batch(words, *columns):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), words, np.int32)), *map(pa.array, columns)], ["words", "fingerprint", "check", "n", "doc"])

        def rows(parts):
            fingerprint, check, times, doc = combined(parts)
            for i in range(0, len(doc), 1 << 16):
                yield batch(n, *(c[i : i + (1 << 16)] for c in (fingerprint.view(np.int64), check.view(np.int32), times, doc)))

        for data, bounds, docs_of, langs in slices(batches, n - 1):
            starts, ends, piece, owner = find_words(data, bounds)
            at = within_pieces(piece, n)
            if not len(at):
                continue
            words, key = hasher.words(data, starts, ends), langs[owner]
            if n == 1:
                for k, many in zip(*np.unique(key, return_counts=True)):
                    totals[int(k)] = totals.get(int(k), 0) + int(many)
            else:
                part = np.arange(len(starts) - n + 2)
                may = in_filter(bits, hasher.phrases(words, key[part], n - 1, part)[0])
                at = at[may[at] & may[at + 1]]
                if not len(at):
                    continue
            fingerprint, check = hasher.phrases(words, key[at], n, at)
            held.append(combined([(fingerprint, check.astype(np.uint32), np.ones(len(at), np.int64), docs_of[owner[at]])]))
            size += len(held[-1][0])
            if size > ENTRIES:
                held = [combined(held)]
                size = len(held[0][0])
                if size > ENTRIES // 2:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)
        if totals:
            nothing = np.zeros(len(totals), np.int64)
            yield batch(0, np.array(list(totals), np.uint64).view(np.int64), nothing.astype(np.int32), np.array(list(totals.values()), np.int64), nothing)

    found = docs.mapInArrow(tidy(run), "words int, fingerprint long, check int, n long, doc long")
    return found.groupBy("words", "fingerprint", "check").agg(F.sum("n").alias("n"), F.min("doc").alias("doc"))


def frequent_phrases(docs: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """``words, fingerprint, check, n, doc`` of all phrases that occur ``min_count`` times and of all languages (0 words),
    written to the shared folder length by length."""
    spark, shorter, frequent = docs.sparkSession, None, None
    for n in range(1, max_words + 1):
        path = shared_path(spark, f"phrases-{n}")
        count_phrases(docs, n, shorter).where((F.col("words") == 0) | (F.col("n") >= min_count)).write.parquet(path)
        found = spark.read.parquet(path)
        if n < max_words:
            shorter = build_filter(found, "fingerprint", found.count())
        frequent = found if frequent is None else frequent.union(found)
    return frequent


def cut_out(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``lang, phrase, words, fingerprint, check, n, parts``: the text of every frequent phrase of two words or more,
    from the document it points to, checked against both its hashes; ``parts`` has the hashes of both sides of each cut.

    As every phrase points to the smallest key among its documents, few documents are asked; a filter over their keys
    keeps all others out of the shuffle.
    """
    asked = frequent.where("words > 1").groupBy("doc").agg(F.collect_list(F.struct("words", "fingerprint", "check", "n")).alias("asked"))
    path = shared_path(docs.sparkSession, "phrase-documents")
    asked.write.parquet(path)
    asked = docs.sparkSession.read.parquet(path)
    keys = build_filter(asked, "doc", asked.count())

    def near(batches):
        bits = np.frombuffer(keys.value, np.uint8)
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_filter(bits, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    own = docs.mapInArrow(tidy(near), "doc long, lang string, text string").withColumn("other", F.hash("text")).dropDuplicates(["doc", "other"])

    def run(batches):
        import pyarrow as pa

        hasher = Hasher()
        cut = pa.struct([("k", pa.int32()), ("l_f", pa.int64()), ("l_c", pa.int32()), ("r_f", pa.int64()), ("r_c", pa.int32())])
        kinds = {"lang": pa.string(), "lang_key": pa.int64(), "phrase": pa.string(), "words": pa.int32(), "fingerprint": pa.int64(), "check": pa.int32(), "n": pa.int64(), "parts": pa.list_(cut)}

        def of_text(row, lang, words_of, wanted, check_of, n_of):
            for n in np.unique(words_of).tolist():
                rows = np.nonzero(words_of == n)[0]
                rows = rows[np.lexsort((check_of[rows], wanted[rows]))]
                sought = {(int(wanted[r]), int(check_of[r])): int(n_of[r]) for r in rows}
                for data, bounds, _, langs in slices([row], n - 1):
                    starts, ends, piece, owner = find_words(data, bounds)
                    at = within_pieces(piece, n)
                    if not len(at):
                        continue
                    words, key = hasher.words(data, starts, ends), langs[owner]
                    every = {}
                    for m in range(1, n + 1):
                        f, c = hasher.phrases(words, key[: len(starts) - m + 1], m, np.arange(len(starts) - m + 1))
                        every[m] = f.view(np.int64), c.astype(np.uint32).view(np.int32)
                    at = at[np.isin(every[n][0][at], wanted[rows])]
                    side = lambda m, p: (int(every[m][0][p]), int(every[m][1][p]))
                    for p in at.tolist():
                        many = sought.pop(side(n, p), None)  # also the check must agree
                        if many is None:
                            continue
                        text = b" ".join(LOWER[data[a:b]].tobytes() for a, b in zip(starts[p : p + n], ends[p : p + n])).decode()
                        parts = [dict(zip(("k", "l_f", "l_c", "r_f", "r_c"), (k, *side(k, p), *side(n - k, p + k)))) for k in range(1, n)]
                        yield lang, int(langs[:1].view(np.int64)[0]), text, n, *side(n, p), many, parts
                    if not sought:
                        break

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                want = row.column(3)[0].values
                made = list(of_text(row, row.column(1)[0].as_py(), *(want.field(k).to_numpy(zero_copy_only=False) for k in range(4))))
                yield pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds.values())], list(kinds))

    schema = "lang string, lang_key long, phrase string, words int, fingerprint long, check int, n long, parts array<struct<k: int, l_f: long, l_c: int, r_f: long, r_c: int>>"
    return own.join(asked, "doc").select("doc", "lang", "text", "asked").mapInArrow(tidy(run), schema).dropDuplicates(["fingerprint", "check"])


def quotient() -> Column:
    """``floor(1000 * a * total / (l * r))``; the products have up to 38 digits."""
    whole = lambda c, digits: f"cast({c} as decimal({digits},0))"
    return F.expr(f"({whole('a', 16)} * {whole(SCALE, 4)} * {whole('total', 17)}) div ({whole('l', 18)} * {whole('r', 18)})")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``max_words`` words.

    ``a`` counts the phrase within pieces, overlaps included; ``l`` and ``r`` the two sides of its weakest cut, whose
    ``floor(1000 * a * n / (l * r))`` is the score (the smallest cut of equal ones). A phrase with ``min_count``
    occurrences inside a longer one that has ``contained_percent`` of them goes. Null text is empty, a null language
    ``und``; rows count as often as they come; an empty table gives no rows. Columns beside ``doc_id``, ``text`` and
    ``lang`` are not read. A word longer than a slice is hashed in one go. Two phrases are told apart by 96 bits.
    """
    spark, docs = docs.sparkSession, keyed(docs)
    frequent = frequent_phrases(docs, max_words, min_count)
    path = shared_path(spark, "phrases")
    cut_out(docs, frequent).write.parquet(path)
    phrases = spark.read.parquet(path)
    counts = frequent.where("words > 0").select("fingerprint", "check", "n")
    totals = frequent.where("words = 0").select(F.col("fingerprint").alias("lang_key"), F.col("n").alias("total"))
    cuts = phrases.select("fingerprint", "check", "lang_key", F.col("n").alias("a"), F.explode("parts").alias("p")).select("fingerprint", "check", "lang_key", "a", "p.*")
    for side in "lr":
        cuts = cuts.join(counts.select(F.col("fingerprint").alias(f"{side}_f"), F.col("check").alias(f"{side}_c"), F.col("n").alias(side)), [f"{side}_f", f"{side}_c"])
    cuts = cuts.join(totals, "lang_key").withColumn("score", quotient())
    weakest = cuts.groupBy("fingerprint", "check").agg(F.min(F.struct("score", "k", "l", "r", "total")).alias("w"))
    longer = phrases.select(F.col("n").alias("of"), "words", F.explode("parts").alias("p"))
    inner = longer.where("words > 2 and p.k = words - 1").select(F.col("p.l_f").alias("fingerprint"), F.col("p.l_c").alias("check"), "of").union(longer.where("words > 2 and p.k = 1").select("p.r_f", "p.r_c", "of"))
    most = inner.groupBy("fingerprint", "check").agg(F.max("of").alias("of"))
    kept = phrases.join(most, ["fingerprint", "check"], "left").where(F.col("of").isNull() | (100 * F.col("of") < contained_percent * F.col("n")))
    scored = kept.join(weakest, ["fingerprint", "check"]).select("lang", "phrase", F.col("n").alias("a"), "w.l", "w.r", F.col("w.total").alias("n"), "w.score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
