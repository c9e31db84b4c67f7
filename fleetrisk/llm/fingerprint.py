"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests, in DataFrame expressions alone.

A text is a set of digests of its paragraphs. A sketch puts each digest into one cell of each of three sub-tables; a cell
holds a count, the xor of its digests and the xor of their checks. Sketches of two versions subtract cell by cell, shared
digests vanish, and peeling cells with one digest left recovers what differs. The fingerprint of a document is its
smallest sketch. Where the difference of two of those does not peel, the digests are dealt into groups and each group is
sketched anew in more and more cells, with new hashes, until it does.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

PARAGRAPH = r"(?s)[^\n.!?]{1,160}[\n.!?]*|[\n.!?]+"  # up to a line or sentence end, long ones in pieces; all of the text
FIRST = 4  # cells of a sub-table of the fingerprint
GROUP = 8  # digests of one version in a group, about
RETRIES = (12, 24, 96)  # cells of a sub-table; the last retry takes twice as many as there are digests
ROUNDS = 16
BUCKET = 4096  # neighbouring ids that are ordered together
EDGES = 256  # ranges of ids that the driver knows


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), c.alias("c"))


def _placed(keys: Column, size: Column, seed: int) -> Column:
    """Digests with their check and their three places."""
    at = lambda k, t: (F.pmod(F.xxhash64(k, F.lit(seed * 3 + t)), size) + t * size).cast("int")
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k, F.lit(seed)).alias("c"), at(k, 0).alias("p0"), at(k, 1).alias("p1"), at(k, 2).alias("p2")))


def _hits(x: Column, cell: Column) -> Column:
    return (x["p0"] == cell) | (x["p1"] == cell) | (x["p2"] == cell)


def sketch(keys: Column, size: Column, seed: int) -> Column:
    """Array of ``3 * size`` cells ``n, k, c``."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda s, x: _cell(s["n"] + 1, s["k"].bitwiseXOR(x["k"]), s["c"].bitwiseXOR(x["c"]))
    cells = F.sequence(F.lit(0), (3 * size - 1).cast("int"))
    return let(_placed(keys, size, seed), lambda ks: F.transform(cells, lambda i: F.aggregate(F.filter(ks, lambda x: _hits(x, i)), empty, add)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peel(cells: Column, size: Column, seed: int) -> Column:
    """``ok, left, right``: whether all cells emptied, and the digests recovered that only one side has."""
    pure = lambda x: (F.abs(x["n"]) == 1) & (x["c"] == F.xxhash64(x["k"], F.lit(seed)))
    none = F.expr("cast(array() as array<bigint>)")
    start = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"), F.lit(True).alias("more"))

    def go(s: Column, signed: Column) -> Column:
        keys = lambda sign: F.transform(F.filter(signed, lambda x: x["n"] == sign), lambda x: x["k"])
        marked = F.transform(signed, lambda x: F.struct(x["n"].alias("n"), _placed(F.array(x["k"]), size, seed)[0].alias("x")))
        take = lambda c, y: _cell(c["n"] - y["n"], c["k"].bitwiseXOR(y["x"]["k"]), c["c"].bitwiseXOR(y["x"]["c"]))
        cells = let(marked, lambda ys: F.transform(s["cells"], lambda c, i: F.aggregate(F.filter(ys, lambda y: _hits(y["x"], i)), c, take)))
        return F.struct(cells.alias("cells"), F.concat(s["left"], keys(1)).alias("left"), F.concat(s["right"], keys(-1)).alias("right"), (F.size(signed) > 0).alias("more"))

    def turn(s: Column, _: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(s["cells"], pure), lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"))))
        return F.when(s["more"], let(found, lambda f: go(s, f))).otherwise(s)

    clean = lambda s: ~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.struct(clean(s).alias("ok"), s["left"].alias("left"), s["right"].alias("right")))


def _groups(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``: both arrays of digests dealt into groups of about ``GROUP``, where ``name`` did not peel at once.

    Two levels of square-root width, so that dealing n digests takes about n * sqrt(n / GROUP) steps.
    """
    part = lambda keys, n, g, salt: F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(salt)), n) == g)
    wide = F.col("wide")
    rows = rows.withColumn("wide", F.greatest(F.lit(1), F.ceil(F.sqrt(F.greatest(F.size(a), F.size(b)) / GROUP))).cast("int"))
    upto = F.sequence(F.lit(0), wide - 1)
    outer = F.transform(upto, lambda g: F.struct(part(F.col(a), wide, g, 101).alias("x"), part(F.col(b), wide, g, 101).alias("y")))
    rows = rows.withColumn("outer", F.when(F.col(f"{name}.ok"), F.slice(outer, 1, 0)).otherwise(outer))
    inner = F.flatten(F.transform("outer", lambda p: F.transform(upto, lambda g: F.struct(part(p["x"], wide, g, 102).alias("x"), part(p["y"], wide, g, 102).alias("y")))))
    return rows.withColumn("groups", inner).drop("outer", "wide")


def with_difference(rows: DataFrame, a: str, b: str, own: str, other: str, name: str) -> DataFrame:
    """Adds ``name``, a struct ``ok, left, right``: the digests that only ``a`` and only ``b`` has.

    Sketches ``own`` and ``other`` are subtracted and peeled; what does not peel is sketched again by groups, and each
    group that still does not is retried in the larger sizes, the last with room for any difference. Where even that does
    not peel, ``ok`` is false and the difference is that of the digests themselves.
    """
    rows = rows.withColumn(name, peel(subtract(F.col(own), F.col(other)), F.lit(FIRST), 1))
    rows = _groups(rows, a, b, name)
    for turn, cells in enumerate((*RETRIES, None)):
        size = lambda p: F.lit(cells) if cells else F.size(p["x"]) + F.size(p["y"]) + 64  # noqa: B023, E731
        met = lambda p: peel(subtract(sketch(p["x"], size(p), 2 + turn), sketch(p["y"], size(p), 2 + turn)), size(p), 2 + turn)  # noqa: B023, E731
        if turn == 0:
            tried = F.transform("groups", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), met(p).alias("d")))  # noqa: B023
        else:
            tried = F.transform("groups", lambda p: F.when(p["d"]["ok"], p).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y"), met(p).alias("d"))))  # noqa: B023
        rows = rows.withColumn("groups", tried)
    peeled = F.forall("groups", lambda p: p["d"]["ok"])
    side = lambda key: F.flatten(F.transform("groups", lambda p: p["d"][key]))
    found = F.struct(F.lit(True).alias("ok"), side("left").alias("left"), side("right").alias("right"))
    exact = F.struct(F.lit(False).alias("ok"), F.array_except(a, b).alias("left"), F.array_except(b, a).alias("right"))
    return rows.withColumn(name, F.when(F.col(f"{name}.ok"), F.col(name)).when(peeled, found).otherwise(exact)).drop("groups")


def likeness(keys: Column, difference: Column) -> Column:
    """Shared digests among all digests of two versions; 1 if both are empty."""
    union = F.size(keys) + F.size(difference["right"])
    return F.when(union == 0, F.lit(1.0)).otherwise((F.size(keys) - F.size(difference["left"])) / union)


def written(cells: Column) -> Column:
    """A sketch as text: count and the two xors in hexadecimal, cell by cell."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"]))), "|")


def id_buckets(own: DataFrame) -> Column:
    """A bucket of some ``BUCKET`` neighbouring rows for each row, buckets ascending with doc_id, for any 64-bit ids.

    Up to ``EDGES`` quantiles of the ids reach the driver. Between two of them buckets have the width of the mean gap
    there, so an id far off makes no other range wide. Rows without doc_id come below all others, by text hash.
    """
    n, ids = own.agg(F.count("*"), F.count("doc_id")).first()
    nulls = max(1, (n - ids) // BUCKET)
    without = -1 - F.pmod(F.xxhash64("text"), F.lit(nulls))
    if not ids:
        return without
    parts = max(1, min(EDGES, ids // BUCKET))
    at = [i / parts for i in range(parts + 1)]
    edges = sorted(set(own.agg(F.percentile_approx("doc_id", at, 4 * parts + 100)).first()[0]))
    each = max(1, ids // (max(1, len(edges) - 1) * BUCKET))  # buckets of a range
    widths = [max(1, -(-(b - a) // each)) for a, b in zip(edges, edges[1:])] + [1 << 62]
    wide = lambda values: F.array(*[F.lit(Decimal(v)).cast("decimal(20,0)") for v in values])
    place = F.greatest(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("doc_id"))), F.lit(1))
    far = F.col("doc_id").cast("decimal(20,0)") - F.get(wide(edges), place - 1)
    inside = F.least(F.floor(far / F.get(wide(widths), place - 1)).cast("long"), F.lit(each))
    return F.when(F.col("doc_id").isNull(), without).otherwise(place.cast("long") * (each + 2) + F.greatest(inside, F.lit(-1)))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each row with the text of the next by descending doc_id, the last with the first.

    Equal ids follow by text; rows without an id come last, in the order of buckets of text hashes. Rows are ordered in
    buckets of neighbouring ids, each one group; rows that repeat one id are in one bucket. A small table of buckets in
    order gives what comes after the last row of each.
    """
    own = texts(docs)
    bucket = id_buckets(own)
    rows = own.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.desc("bucket"))
    first = F.first(F.struct("bucket", "head")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select(F.col("bucket").alias("of"), F.coalesce(F.lead(F.struct("bucket", "head")).over(order), first).alias("next"))
    entering = rows.join(after.select("of", F.col("next.bucket").alias("b"), F.col("next.head").alias("h")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("h")))
    entering = entering.groupBy("of").agg(F.min("text").alias("entering"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    led = rows.withColumn("next_text", F.lead("text").over(inside))
    return led.join(entering, F.col("bucket") == F.col("of"), "left").select("doc_id", "text", F.coalesce("next_text", "entering").alias("next_text"))


def compare_versions(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, peeled`` for every row.

    The edited text has its last third replaced by as many characters (or all) of the next document's start. A null or
    empty text has no paragraphs: a sketch of empty cells, alike only to another without paragraphs. Repeated
    paragraphs of a text count once. A single document is its own next.
    """
    rows = with_next(docs)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), digests(F.col("text")).alias("own"), digests(F.col("next_text")).alias("next"), F.struct(F.sha2(edited.cast("binary"), 256).alias("sha"), digests(edited).alias("keys")).alias("e"))
    made = lambda keys: sketch(keys, F.lit(FIRST), 1)
    rows = rows.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), "own", "next", F.col("e.keys").alias("edited"), made(F.col("own")).alias("s"), made(F.col("next")).alias("sn"), made(F.col("e.keys")).alias("se"))
    rows = with_difference(rows, "own", "edited", "s", "se", "to_edited").drop("edited")
    rows = with_difference(rows, "own", "next", "s", "sn", "to_next").drop("next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("s")).alias("fingerprint"), written(F.col("se")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("to_edited")).alias("near_edited"), likeness(F.col("own"), F.col("to_next")).alias("near_next"), (F.col("to_edited.ok") & F.col("to_next.ok")).alias("peeled"),
    )
