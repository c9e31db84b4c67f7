"""JSON documents from rows: nodes first, then one text per artifact.

Every list of a document is a table of nodes ``(artifact_id, section, ord, tie, json)``. A document is one text,
so its nodes meet in one row; without a ``limit`` every document is whole. A caller with artifacts too large for a
row states one: the nodes of larger documents are then written as they are, range-partitioned by artifact, section
and position, beside a head that is flagged and lacks those lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = ["artifact_id", "section", "ord", "tie", "json"]


def leaf(**fields: Column) -> Column:
    """JSON object from native columns; NULL members are left out. ``__`` in a name stands for ``-``."""
    return F.to_json(record(**fields))


def record(**fields: Column) -> Column:
    """Struct with the given members, for use inside other leaves."""
    return F.struct(*[value.alias(name.replace("__", "-")) for name, value in fields.items()])


def present(*values: Column) -> Column:
    """Array of the values that are not NULL; NULL instead of an empty one, so that its member is left out."""
    return _once(F.array_compact(F.array(*values)), lambda kept: F.when(F.size(kept) > 0, kept))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with a value that is made once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def members(json_object: Column) -> Column:
    """The members of a JSON object without its braces, or NULL when it has none."""
    inside = lambda j: F.substr(j, F.lit(2), F.length(j) - 2)
    return _once(json_object, lambda j: F.when(F.length(j) > 2, inside(j)))


def member(name: str, json_value: Column) -> Column:
    """One member with a value that already is JSON; NULL without a value."""
    return F.concat(F.lit(f'"{name}":'), json_value)


def splice(*parts: Column) -> Column:
    """JSON object from groups of members; NULL groups are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def non_empty(json: Column) -> Column:
    """NULL instead of an empty object or array, so that its member is left out."""
    return _once(json, lambda j: F.when(~j.isin("{}", "[]"), j))


def joined(json_array: Column) -> Column:
    """JSON array from an array column of JSON values; NULL when it is empty or missing."""
    return _once(json_array, lambda a: F.when(F.size(a) > 0, F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))))


def quoted(value: Column) -> Column:
    """A text as a JSON string."""
    return _once(F.to_json(F.array(value)), lambda j: F.substr(j, F.lit(2), F.length(j) - 2))


def nodes(rows: DataFrame, section: str, order: Column, tie: Column, json: Column) -> DataFrame:
    return rows.select(
        "artifact_id",
        F.lit(section).alias("section"),
        order.cast("bigint").alias("ord"),
        tie.cast("string").alias("tie"),
        json.alias("json"),
    )


def several(rows: DataFrame, order: Column, tie: Column, **json: Column) -> DataFrame:
    """Nodes of several sections, named by the keywords, from each row: the rows are made once for all of them."""
    made = rows.select("artifact_id", order.cast("bigint").alias("ord"), tie.cast("string").alias("tie"), *[j.alias(f"_{s}") for s, j in json.items()])
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"_{s}").alias("json")) for s in json])
    return made.select("artifact_id", "ord", "tie", F.inline(each)).select(*NODE_COLUMNS)


def large_artifacts(parts: DataFrame, limit: int) -> DataFrame:
    """Artifacts with more nodes than one text should hold. Counts keys only; no JSON is built for it."""
    return parts.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("artifact_id")


def gather(parts: DataFrame, sections: list[str]) -> DataFrame:
    """One row per artifact with an ordered array of JSON values per section. Only for bounded documents."""
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section")).cast("int").alias("place")
    item = F.struct(place, "ord", "tie", "json")
    # one list for all sections: a list of each would be carried and sorted by itself
    collected = parts.groupBy("artifact_id").agg(F.sort_array(F.collect_list(item)).alias("_nodes"))

    def of(number: int) -> Column:
        return F.transform(F.filter("_nodes", lambda n: n["place"] == number), lambda n: n["json"])

    return collected.select("artifact_id", *[of(i).alias(s) for i, s in enumerate(sections, 1)])


def assembled(heads: DataFrame, parts: DataFrame, sections: list[str], document: Column, limit: int | None = None) -> DataFrame:
    """``(artifact_id, document, large)``: the text of every document.

    ``document`` is built from the head columns and one array column per section. A document above a
    ``limit`` of the caller has a text without its lists; ``large_nodes`` gives those.
    """
    if limit is None:
        rows = heads.join(gather(parts, sections), "artifact_id", "left")
        return rows.select("artifact_id", document.alias("document"), F.lit(False).alias("large"))
    large = large_artifacts(parts, limit)
    small = parts.join(large, "artifact_id", "left_anti")
    flagged = large.withColumn("large", F.lit(True))
    rows = heads.join(gather(small, sections), "artifact_id", "left").join(flagged, "artifact_id", "left")
    return rows.select("artifact_id", document.alias("document"), F.coalesce("large", F.lit(False)).alias("large"))


def large_nodes(parts: DataFrame, limit: int) -> DataFrame:
    """Nodes of documents above the limit, in document order across partitions."""
    large = parts.join(large_artifacts(parts, limit), "artifact_id", "left_semi")
    return large.orderBy("artifact_id", "section", "ord", "tie")


def write_documents(documents: DataFrame, parts: DataFrame, path: str, limit: int | None = None) -> None:
    """Documents as JSON lines under ``path/documents``; with a ``limit``, nodes of larger ones under ``path/nodes``."""
    documents.write.mode("overwrite").json(f"{path}/documents")
    if limit is not None:
        large_nodes(parts, limit).write.mode("overwrite").json(f"{path}/nodes")
