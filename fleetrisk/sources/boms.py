"""Bills of materials to claims and documented files. Input ``(doc_id, artifact_id, body)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.lookups import nullif_empty
from ..session import cut_lineage, tolerate_repeated_keys
from .json_events import puller

PREFIX = "fleetrisk:"
PROPS = "array<struct<name:string,value:string>>"
HASHES = "array<struct<alg:string,content:string>>"
CARD = f"struct<modelParameters:struct<modelArchitecture:string>,properties:{PROPS}>"
COMPONENT = f"struct<type:string,name:string,version:string,hashes:{HASHES},properties:{PROPS},modelCard:{CARD}>"
CYCLONEDX = f"specVersion string, metadata struct<component:{COMPONENT}>, components array<{COMPONENT}>"
SPDX_HASHES = "array<struct<algorithm:string,hashValue:string>>"
SPDX_NODE = (
    f"struct<type:string,name:string,software_packageVersion:string,verifiedUsing:{SPDX_HASHES},"
    "ai_hyperparameter:array<struct<key:string,value:string>>,ai_typeOfModel:array<string>>"
)
SPDX = f"`@graph` array<{SPDX_NODE}>"
PROPERTY_NAMES = {
    PREFIX + "quantization": "quantization",
    PREFIX + "dtype": "dtype",
    PREFIX + "measuredParameters": "measuredParameters",
    PREFIX + "architecture": "architecture",
}
EMPTY_MAP = "map<string,string>"
EMPTY_PROPS = "array<struct<key:string,value:string>>"


def bom_detect(documents: DataFrame, max_bytes: int = V.MAX_DOCUMENT_BYTES) -> DataFrame:
    """Kind by content: cyclonedx, spdx, or an error. Larger texts are refused as documents."""
    tolerate_repeated_keys(documents.sparkSession)
    keys = F.map_keys(F.try_parse_json("body").cast("map<string,variant>"))
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json("body")), F.lit("OBJECT"))
    usable = F.coalesce(is_object, F.lit(False)) & (F.octet_length("body") <= max_bytes)
    names = F.when(usable, keys)
    kind = F.when(F.array_contains(names, "bomFormat") | F.array_contains(names, "specVersion"), "cyclonedx").when(
        F.array_contains(names, "@graph"), "spdx"
    )
    error = (
        F.when(F.octet_length("body") > max_bytes, "too large")
        .when(~F.coalesce(is_object, F.lit(False)), "not JSON")
        .when(kind.isNull(), "not a bill of materials")
    )
    return documents.select("doc_id", "artifact_id", "body", kind.alias("kind"), error.alias("error"))


def _last(rows: Column, field: str, key: str, value: str, upper: bool) -> Column:
    """Value of the last entry with this key; an algorithm named twice counts as its last mention."""
    fold = F.upper if upper else F.lower
    matching = F.filter(rows, lambda r: fold(r[field]) == key)
    return nullif_empty(F.try_element_at(matching, F.lit(-1))[value])


def _property_map(props: Column) -> Column:
    """The properties this engine measures, by their short names."""
    pairs = F.transform(
        F.filter(F.coalesce(props, F.array().cast(PROPS)), lambda p: p["name"].isin(list(PROPERTY_NAMES))),
        lambda p: F.struct(F.regexp_replace(p["name"], "^" + PREFIX, "").alias("key"), p["value"].alias("value")),
    )
    return pairs


def _merge(*pairs: Column) -> Column:
    """Map from arrays of pairs; a later mention replaces an earlier one."""
    together = F.concat(*pairs)
    return F.aggregate(
        together,
        F.create_map().cast(EMPTY_MAP),
        lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])),
    )


NO_FILES = "array<struct<path:string,sha256:string,sha384:string,size:bigint>>"


def _cyclonedx_claims(rows: DataFrame) -> DataFrame:
    """Claims from the model component ``p`` and ``spec``, the version of the format."""
    c = F.col
    architecture = nullif_empty(c("p.modelCard.modelParameters.modelArchitecture"))
    stated = F.when(
        architecture.isNotNull(),
        F.array(F.struct(F.lit("architecture").alias("key"), architecture.alias("value"))),
    ).otherwise(F.array().cast(EMPTY_PROPS))
    return rows.select(
        "doc_id",
        "artifact_id",
        F.concat(F.lit("CycloneDX "), c("spec")).alias("format"),
        nullif_empty(c("p.name")).alias("model_name"),
        nullif_empty(c("p.version")).alias("version"),
        _merge(_property_map(c("p.properties")), stated, _property_map(c("p.modelCard.properties"))).alias("properties"),
    )


def _cyclonedx_file(path: Column, component: Column) -> Column:
    size = F.try_element_at(F.filter(component["properties"], lambda q: q["name"] == PREFIX + "size"), F.lit(-1))
    return F.struct(
        path.alias("path"),
        _last(component["hashes"], "alg", "SHA-256", "content", True).alias("sha256"),
        _last(component["hashes"], "alg", "SHA-384", "content", True).alias("sha384"),
        size["value"].try_cast("bigint").alias("size"),
    )


def _cyclonedx_primary(component: Column) -> Column:
    named = F.filter(component["properties"], lambda q: q["name"] == PREFIX + "primaryFile")
    return _cyclonedx_file(F.try_element_at(named, F.lit(1))["value"], component)


def _listed(rows: DataFrame, files: Column) -> DataFrame:
    return rows.select("doc_id", F.explode(files).alias("f")).select("doc_id", "f.*").filter(F.coalesce("path", F.lit("")) != "")


def bom_read_cyclonedx(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, files): one claims row per document, one files row per documented file."""
    rows = documents.withColumn("j", F.from_json("body", CYCLONEDX))
    rows = rows.withColumns({"p": F.col("j.metadata.component"), "spec": F.col("j.specVersion")})
    listed = F.filter("j.components", lambda k: k["type"] == "file")
    others = F.coalesce(F.transform(listed, lambda k: _cyclonedx_file(k["name"], k)), F.array().cast(NO_FILES))
    return _cyclonedx_claims(rows), _listed(rows, F.concat(F.array(_cyclonedx_primary(F.col("p"))), others))


def _spdx_claims(rows: DataFrame) -> DataFrame:
    """Claims from the model's node ``m``."""
    c = F.col
    kept = F.filter(
        F.coalesce("m.ai_hyperparameter", F.array().cast("array<struct<key:string,value:string>>")),
        lambda h: h["key"].isin("quantization", "measuredParameters"),
    )
    kind = F.try_element_at("m.ai_typeOfModel", F.lit(1))
    architecture = F.when(
        kind.isNotNull(), F.array(F.struct(F.lit("architecture").alias("key"), kind.alias("value")))
    ).otherwise(F.array().cast(EMPTY_PROPS))
    return rows.select(
        "doc_id",
        "artifact_id",
        F.lit("SPDX 3.0.1").alias("format"),
        c("m.name").alias("model_name"),
        nullif_empty(c("m.software_packageVersion")).alias("version"),
        _merge(kept, architecture).alias("properties"),
    )


def _spdx_file(path: Column, node: Column) -> Column:
    return F.struct(
        path.alias("path"),
        _last(node["verifiedUsing"], "algorithm", "sha256", "hashValue", False).alias("sha256"),
        _last(node["verifiedUsing"], "algorithm", "sha384", "hashValue", False).alias("sha384"),
        F.lit(None).cast("bigint").alias("size"),
    )


def _spdx_primary(node: Column) -> Column:
    """The model as a file of its own, where it has digests."""
    named = F.filter(node["ai_hyperparameter"], lambda h: h["key"] == "primaryFile")
    model = _spdx_file(F.coalesce(F.try_element_at(named, F.lit(-1))["value"], F.lit("")), node)
    hashed = model["sha256"].isNotNull() | model["sha384"].isNotNull()
    return F.when(hashed, F.array(model)).otherwise(F.array().cast(NO_FILES))


def bom_read_spdx(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, files). The first named AI package is the model; file nodes are its files."""
    rows = documents.withColumn("g", F.from_json("body", SPDX)["@graph"])
    packages = F.filter("g", lambda n: (n["type"] == "ai_AIPackage") & (F.coalesce(n["name"], F.lit("")) != ""))
    rows = rows.withColumn("m", F.try_element_at(packages, F.lit(1)))
    nodes = F.filter("g", lambda n: (n["type"] == "software_File") & (F.coalesce(n["name"], F.lit("")) != ""))
    files = F.concat(_spdx_primary(F.col("m")), F.transform(nodes, lambda n: _spdx_file(n["name"], n)))
    return _spdx_claims(rows), rows.select("doc_id", F.explode(files).alias("f")).select("doc_id", "f.*")


# --- documents of any size ---------------------------------------------------------------------------------
NODES = "doc_id string, artifact_id string, section string, ord bigint, json string, error string"


def bom_nodes(ranges: DataFrame) -> DataFrame:
    """The model and file nodes of documents that come as byte ranges ``(doc_id, artifact_id, offset, content)``.

    A row ``document`` for each document tells its format, or why it cannot be read. A document passes one task part by
    part through a pull parser, which holds one component at a time; documents are dealt over tasks.
    """
    make = puller()

    def run(batches):
        import codecs
        import json
        from itertools import groupby

        import pyarrow as pa

        _, items = make
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "artifact_id", "section", "ord", "json", "error"]
        sections = {("metadata", "component"): "model", ("components", "*"): "component", ("@graph", "*"): "node"}

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py() or b""

        def nodes(key, contents):
            seen = {"first": "", "top": set(), "spec": None}

            def parts():
                decoder = codecs.getincrementaldecoder("utf-8")("replace")
                for _, content in contents:
                    text = decoder.decode(content)
                    seen["first"] = seen["first"] or text.lstrip(" \t\n\r")[:1]
                    yield text
                yield decoder.decode(b"", True)

            def wanted(path):
                if len(path) == 1:
                    seen["top"].add(path[0])
                return path in sections or path == ("specVersion",)

            error = None
            try:
                for ord_, (path, value) in enumerate(items(parts(), wanted)):
                    if path == ("specVersion",):
                        seen["spec"] = value if isinstance(value, str) else json.dumps(value)
                    elif isinstance(value, dict):
                        section = sections[path]
                        if section == "model" or value.get("type") in ("file", "ai_AIPackage", "software_File"):
                            yield (*key, section, ord_, json.dumps(value), None)
            except ValueError:
                error = "not JSON"
            if seen["first"] != "{":
                error = "not JSON"
            kind = "cyclonedx" if seen["top"] & {"bomFormat", "specVersion"} else "spdx" if "@graph" in seen["top"] else None
            if error is None and kind is None:
                error = "not a bill of materials"
            yield (*key, "document", -1, json.dumps({"kind": None if error else kind, "spec": seen["spec"]}), error)

        def flush(held):
            return pa.RecordBatch.from_arrays([pa.array([h[j] for h in held], kind) for j, kind in enumerate(kinds)], names)

        held, size = [], 0
        for key, group in groupby(rows(), lambda r: r[0]):
            for node in nodes(key, group):
                held.append(node)
                size += len(node[4]) + 100
                if size > 1 << 20:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    keys = ["doc_id", "artifact_id"]
    ordered = ranges.select(*keys, "offset", "content").repartition(*keys).sortWithinPartitions(*keys, "offset")
    return ordered.select(*keys, "content").mapInArrow(run, NODES)


def read_ranges(ranges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kinds, claims, files) of documents of any size and either format, as ``bom_detect`` and the readers of whole
    texts give them. Input as for ``bom_nodes``; what it finds is kept once for all three results.

    A document that breaks off has an error and neither claims nor files.
    """
    nodes = cut_lineage(bom_nodes(ranges))
    about = F.from_json("json", "kind string, spec string")
    documents = nodes.filter("section = 'document'").select("doc_id", "artifact_id", about.alias("a"), "error").select("doc_id", "artifact_id", "a.*", "error")
    readable = documents.filter("error IS NULL")
    inside = nodes.join(readable.select("doc_id", "kind"), "doc_id")

    models = inside.filter("section = 'model' AND kind = 'cyclonedx'").select("doc_id", F.from_json("json", COMPONENT).alias("p"))
    claimed = _cyclonedx_claims(readable.filter("kind = 'cyclonedx'").join(models, "doc_id", "left"))
    components = inside.filter("section = 'component' AND kind = 'cyclonedx'").select("doc_id", F.from_json("json", COMPONENT).alias("p")).filter("p.type = 'file'")
    files = _listed(models, F.array(_cyclonedx_primary(F.col("p")))).unionByName(_listed(components, F.array(_cyclonedx_file(F.col("p.name"), F.col("p")))))

    graph = inside.filter("section = 'node' AND kind = 'spdx'").select("doc_id", "ord", F.from_json("json", SPDX_NODE).alias("m"))
    named = graph.filter("m.name <> ''")
    packages = named.filter("m.type = 'ai_AIPackage'").groupBy("doc_id").agg(F.min_by("m", "ord").alias("m"))
    claimed = claimed.unionByName(_spdx_claims(readable.filter("kind = 'spdx'").join(packages, "doc_id", "left")))
    own = packages.select("doc_id", F.explode(_spdx_primary(F.col("m"))).alias("f")).select("doc_id", "f.*")
    nodes_files = named.filter("m.type = 'software_File'").select("doc_id", _spdx_file(F.col("m.name"), F.col("m")).alias("f")).select("doc_id", "f.*")
    return documents.select("doc_id", "artifact_id", "kind", "error"), claimed, files.unionByName(own).unionByName(nodes_files)
