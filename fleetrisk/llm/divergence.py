"""How far the sources of a language diverge in their terms, by hash-consed segment trees over term ids.

The kept terms of a language lie in blocks. In a block every source has a segment tree over the term ids, whose leaves
are counts; equal subtrees, of one source or several, are one node. Two trees are walked together from their roots: a
pair of nodes that comes up more than once is kept once with its multiplicity, so equal pairs are priced once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_binary, tidy
from .tokens import shared_path

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
CELLS = 1 << 19  # sources times terms of a block, about
ENTRIES = 700_000  # (group, term) entries that a task holds before it passes them on
TEXT_AT_ONCE = 4 << 20
#: ASCII letters in lower case and all bytes of other characters make terms; everything else parts them.
TERM_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def pieces(data: np.ndarray, low: int, high: int):
    """Terms of one text, in lists of bounded size; a list ends between terms."""
    while low < high:
        stop = min(high, low + TEXT_AT_ONCE)
        text = data[low:stop].tobytes().translate(TERM_BYTES)
        while stop < high and text[-1] != 32:
            cut = text.rfind(b" ")
            if cut >= 0:
                text, stop = text[: cut + 1], low + cut + 1
            else:  # one term longer than a list
                stop = min(high, stop + TEXT_AT_ONCE)
                text = data[low:stop].tobytes().translate(TERM_BYTES)
        yield text.split()
        low = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of a term in a group and documents that hold it, summed in each task
    before any shuffle. A row without term stands for each group, also one without terms."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counts, held = {}, 0

        def rows():
            for (lang, source), (n, in_docs) in counts.items():
                terms = list(n)
                size = len(terms) + 1
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([None, *terms], pa.binary()).cast(pa.string())]
                columns += [pa.array(np.fromiter((0, *n.values()), np.int64, size)), pa.array(np.fromiter((0, *map(in_docs.__getitem__, terms)), np.int64, size))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            data, offsets = arrow_binary(batch.column(2))
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (lang, source) in enumerate(zip(langs, sources)):
                n, in_docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in pieces(data, offsets[i], offsets[i + 1]):
                    n.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                held += len(n) - before
                if held > ENTRIES:
                    yield from rows()
                    counts, held = {}, 0
        yield from rows()

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    found = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``term_counts`` whose term lies in ``min_docs`` documents of its language, written to the shared
    folder; ``first`` marks one row of each term."""
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("in_lang", F.sum("docs").over(term)).withColumn("first", (F.row_number().over(term.orderBy("source")) == 1).cast("long"))
    path = shared_path(docs.sparkSession, "term-counts")
    counts.where(F.col("term").isNull() | (F.col("in_lang") >= min_docs)).select("lang", "source", "term", "n", F.when(F.col("term").isNotNull(), F.col("first")).otherwise(0).alias("first")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * count / total)`` without a product beyond 64 bits: long division by three digits a step."""
    rest, out = count % total, count // total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Values of the distinct leaves, the children of the distinct nodes level by level upwards, and each row's root."""
    values, ids = np.unique(leaves, return_inverse=True)
    ids, many, levels = ids.reshape(leaves.shape), len(values), []
    while ids.shape[1] > 1:
        nodes, place = np.unique(ids[:, 0::2].astype(np.int64) * many + ids[:, 1::2], return_inverse=True)
        levels.append((nodes // many, nodes % many))
        ids, many = place.reshape(len(leaves), -1), len(nodes)
    return values, levels, ids[:, 0]


def price_pairs(values, levels, root, a, b, totals) -> np.ndarray:
    """The summed divergence of each pair of trees ``a[i], b[i]``; padding leaves are negative and cost nothing."""
    pair, x, y, times = np.arange(len(a)), root[a], root[b], np.ones(len(a), np.int64)
    for below, (left, right) in zip([len(values), *(len(n[0]) for n in levels)][: len(levels)][::-1], levels[::-1]):
        key = (np.concatenate([pair, pair]) * below + np.concatenate([left[x], right[x]])) * below + np.concatenate([left[y], right[y]])
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        times = np.add.reduceat(np.concatenate([times, times])[order], starts)
        key = key[starts]
        pair, x, y = key // below // below, key // below % below, key % below
    at, other = values[x], values[y]
    cost = np.where(at < 0, 0, divergence(scaled(np.maximum(at, 0) + 2, totals[a][pair]), scaled(np.maximum(other, 0) + 2, totals[b][pair])) * times)
    return np.add.reduceat(cost, np.searchsorted(pair, np.arange(len(a))))


def audit_block(key, table):
    """Divergence sums of all pairs of sources over one block of terms, and each source's strongest terms in it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lang, block = (k.as_py() for k in key)
    is_group = pc.is_null(table["n"])
    groups, counts = table.filter(is_group), table.filter(pc.invert(is_group))
    names = [s.encode() for s in groups["source"].to_pylist()]
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    names = [names[i] for i in order]
    n_terms, size = groups["n_terms"][0].as_py(), groups["size"].to_numpy()[order]
    encoded = [pc.dictionary_encode(counts[c].combine_chunks().cast(pa.large_binary())) for c in ("source", "term")]
    terms = encoded[1].dictionary.to_pylist()
    rank = np.zeros(len(terms), np.int64)
    rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    terms = sorted(terms)
    place = {s: i for i, s in enumerate(names)}
    row = np.array([place[s] for s in encoded[0].dictionary.to_pylist()], np.int64)
    width = 1 << max(len(terms) - 1, 0).bit_length()
    leaves = np.full((len(names), width), -1, np.int64)
    leaves[:, : len(terms)] = 0
    leaves[row[encoded[0].indices.to_numpy()], rank[encoded[1].indices.to_numpy()]] = counts["n"].to_numpy()

    def batch(part, sources, items, value):
        made = [pa.array([lang] * len(sources), pa.string()), pa.array([part] * len(sources), pa.string()), *(pa.array(c, pa.binary()).cast(pa.string()) for c in (sources, items)), pa.array(value, pa.int64())]
        return pa.table(made, names=["lang", "part", "source", "item", "value"])

    out, totals = [batch("pair", [], [], [])], np.maximum(size + 2 * n_terms, 1)
    if terms or block == 0:
        values, levels, root = consed(leaves)
        most = max(len(values), *(len(n[0]) for n in levels), 1)
        at_once = max(1, min((1 << 22) // width, (1 << 62) // most**2))
        a, b = np.triu_indices(len(names), 1)
        for i in range(0, len(a), at_once):
            x, y = a[i : i + at_once], b[i : i + at_once]
            value = price_pairs(values, levels, root, x, y, totals)
            for s, t in ((x, y), (y, x)):
                out.append(batch("pair", [names[j] for j in s], [names[j] for j in t], value))
    if terms:
        real = leaves[:, : len(terms)]
        q = scaled(real.sum(axis=0) + 2, np.int64(size.sum() + 2 * n_terms))
        for i, name in enumerate(names):
            p = scaled(real[i] + 2, totals[i])
            at = np.nonzero((real[i] > 0) & (p > q))[0]
            f = divergence(p[at], q[at])
            best = np.lexsort((at, -f))[:TOP_TERMS]
            out.append(batch("term", [name] * len(best), [terms[j] for j in at[best]], f[best]))
    return pa.concat_tables(out)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of each source from every other of its language (``pair``)
    and its ten strongest terms against the language (``term``).

    Null text, language and source are empty; rows count as often as they come; an empty table gives no rows. A source
    without kept terms has pairs, and a source alone in its language has none. Blocks hold some ``CELLS`` counts,
    whatever the number of sources and terms, so no task holds a language; two numbers reach the driver.
    """
    kept = kept_counts(docs, min_docs)
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first").alias("terms"))
    lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", "size", F.sum("terms").over(lang).alias("n_terms"), F.count("*").over(lang).alias("n_sources"))
    most = groups.agg(F.max("n_terms"), F.max("n_sources")).first()
    width = 1 << max(4, min(11, (CELLS // max(most[1] or 1, 1)).bit_length() - 1))
    blocks = max(1, -(-10 * (most[0] or 0) // (9 * width)))
    each = groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "size", "n_terms")
    counted = kept.where("term is not null").select("lang", "source", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "term", "n", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("n_terms"))
    priced = each.union(counted).groupBy("lang", "block").applyInArrow(audit_block, "lang string, part string, source string, item string, value long")
    sums = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS)).select("lang", "source", "part", "item", "value", "rank")
