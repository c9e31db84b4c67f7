"""SPDX 3.0.1 documents: one graph per artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.lookups import nullif_empty
from . import parts as J
from . import streams as ST

SECTIONS = [
    "hyperparameters", "files", "datasets", "basemodels", "rel_files", "dataset_ids", "basemodel_ids", "limitations",
]
NAMESPACE = "https://spdx.org/spdxdocs/fleetrisk/"


def namespace() -> Column:
    seed = F.concat(F.coalesce("primary_sha256", F.lit("")), F.coalesce("name", F.lit("")))
    return F.concat(F.lit(NAMESPACE), S.serial_uuid(seed))


def _node(kind: str, spdx_id: Column, **fields: Column) -> Column:
    return J.leaf(type=F.lit(kind), spdxId=spdx_id, creationInfo=F.lit("_:creationinfo"), **fields)


def _hashes(prefix: str = "") -> Column:
    def one(bits: int) -> Column:
        value = nullif_empty(F.col(f"{prefix}sha{bits}"))
        entry = J.record(type=F.lit("Hash"), algorithm=F.lit(f"sha{bits}"), hashValue=value)
        return F.when(value.isNotNull(), entry)

    return J.present(one(256), one(384), one(512))


def _entry(key: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), J.record(type=F.lit("DictionaryEntry"), key=key, value=value))


def _relation(local: Column, kind: str, targets_json: Column) -> Column:
    """Relationship from the model to targets that already are a JSON array."""
    ns = F.col("_ns")
    head = J.leaf(
        type=F.lit("Relationship"),
        spdxId=F.concat(ns, F.lit("#"), local),
        creationInfo=F.lit("_:creationinfo"),
        **{"from": F.concat(ns, F.lit("#model"))},
        relationshipType=F.lit(kind),
    )
    return F.when(targets_json.isNotNull(), J.splice(J.members(head), J.member("to", targets_json)))


def spdx_nodes(
    profiles: DataFrame,
    files: DataFrame,
    datasets: DataFrame,
    findings: DataFrame,
    hyperparameters: DataFrame | None = None,
    references: DataFrame | None = None,
) -> DataFrame:
    """List members of the graphs as nodes. ``references`` are base models only.

    The profile is read for several lists, so pass a written or checkpointed one.
    """
    c = F.col
    facts = profiles.select("artifact_id", namespace().alias("_ns"))
    others = (
        files.filter(c("role") != "primary")
        .join(facts, "artifact_id")
        .withColumn("_local", S.short_id(nullif_empty(c("sha256")), c("path")))
        .withColumn("_id", F.concat("_ns", F.lit("#file-"), "_local"))
    )
    file_node = _node("software_File", c("_id"), name=c("path"), verifiedUsing=_hashes())
    contains = _relation(F.concat(F.lit("rel-file-"), "_local"), "contains", F.to_json(F.array("_id")))
    result = J.several(others, F.lit(0), c("path"), files=file_node, rel_files=contains)

    def named(rows: DataFrame, section: str, ids: str, label: str, node: Column) -> DataFrame:
        node_id = F.concat("_ns", F.lit(f"#{label}-"), S.slug(c("name")), F.lit("-"), c("ord").cast("string"))
        joined = rows.join(facts, "artifact_id").withColumn("_id", node_id)
        return J.several(joined, c("ord"), c("name"), **{section: node, ids: J.quoted(c("_id"))})

    nowhere = F.lit("NOASSERTION")
    dataset = _node(
        "dataset_DatasetPackage",
        c("_id"),
        name=c("name"),
        dataset_datasetType=F.array(F.lit("other")),
        software_downloadLocation=nowhere,
    )
    result = result.unionByName(named(datasets, "datasets", "dataset_ids", "dataset", dataset))
    if references is not None:
        where = F.coalesce(nullif_empty(c("url")), nowhere)
        base = _node("ai_AIPackage", c("_id"), name=c("name"), software_downloadLocation=where)
        result = result.unionByName(named(references, "basemodels", "basemodel_ids", "basemodel", base))
    if hyperparameters is not None:
        entry = F.to_json(_entry(c("name"), c("value")))
        result = result.unionByName(J.nodes(hyperparameters, "hyperparameters", F.lit(0), c("name"), entry))
    # limitation lines are plain text here; the document joins them into one string
    line = F.concat(F.lit("["), "severity", F.lit("] "), "id", F.lit(": "), F.coalesce("title", F.lit("")))
    rank = S.severity_rank(c("severity")).cast("bigint")
    return result.unionByName(J.nodes(findings, "limitations", rank * 1_000_000_000_000 + c("ord"), c("id"), line))


def _document(generated_at: str, tool_version: str) -> Column:
    c = F.col
    name = F.coalesce("name", F.lit(""))

    def local(text: str) -> Column:
        return F.concat("_ns", F.lit("#" + text))

    profiles = ["core", "software", "ai", "dataset", "simpleLicensing"]
    document = _node(
        "SpdxDocument",
        local("document"),
        name=F.concat(name, F.lit(" bill of materials")),
        profileConformance=F.array(*map(F.lit, profiles)),
        rootElement=F.array(local("model")),
    )
    creation = J.leaf(
        type=F.lit("CreationInfo"),
        **{"@id": F.lit("_:creationinfo")},
        specVersion=F.lit("3.0.1"),
        created=F.lit(generated_at),
        createdBy=F.array(local("tool")),
        createdUsing=F.array(local("tool")),
    )
    tool = _node("Tool", local("tool"), name=F.lit(f"fleetrisk {tool_version}"))
    maker = F.coalesce("organization", "author")
    supplier = F.when(maker.isNotNull(), _node("Organization", local("supplier"), name=maker))
    measured = F.when(c("measured_parameters") > 0, c("measured_parameters").cast("string"))
    none = F.array().cast("array<string>")

    def entries(*values: Column) -> Column:
        return F.transform(F.array_compact(F.array(*values)), lambda e: F.to_json(e))

    stated = F.concat(
        entries(
            _entry(F.lit("quantization"), c("quantization")),
            _entry(F.lit("parameterCount"), c("parameter_count")),
            _entry(F.lit("measuredParameters"), measured),
            _entry(F.lit("inputOutputSignature"), S.io_signature(c("inputs"), c("outputs"))),
        ),
        F.coalesce("hyperparameters_nodes", none),
        entries(_entry(F.lit("primaryFile"), nullif_empty(c("primary_path")))),
    )
    limits = F.when(F.size("limitations_nodes") > 0, F.array_join("limitations_nodes", "\n"))
    before = _node(
        "ai_AIPackage",
        local("model"),
        name=name,
        software_primaryPurpose=F.lit("other"),
        software_downloadLocation=F.coalesce("url", "repo_url", F.lit("NOASSERTION")),
        software_packageVersion=c("version"),
        suppliedBy=F.when(maker.isNotNull(), local("supplier")),
        description=c("description"),
        ai_typeOfModel=F.when(c("architecture").isNotNull(), F.array("architecture")),
    )
    has_hash = F.coalesce("primary_sha256", F.lit("")) != ""
    after = J.leaf(verifiedUsing=F.when(has_hash, _hashes("primary_")), ai_limitation=limits)
    model = J.splice(J.members(before), J.member("ai_hyperparameter", J.joined(stated)), J.members(after))
    licensed = c("license").isNotNull()
    license_node = _node(
        "simplelicensing_LicenseExpression", local("license"), simplelicensing_licenseExpression=c("license")
    )
    graph = F.concat(
        F.array_compact(F.array(document, creation, tool, supplier, model)),
        F.coalesce("files_nodes", none),
        F.coalesce("datasets_nodes", none),
        F.coalesce("basemodels_nodes", none),
        F.array_compact(F.array(F.when(licensed, license_node))),
        F.coalesce("rel_files_nodes", none),
        F.array_compact(
            F.array(
                _relation(F.lit("rel-trainedon"), "trainedOn", J.joined(c("dataset_ids_nodes"))),
                _relation(F.lit("rel-ancestry"), "descendantOf", J.joined(c("basemodel_ids_nodes"))),
                _relation(
                    F.lit("rel-license"),
                    "hasDeclaredLicense",
                    F.when(licensed, F.to_json(F.array(local("license")))),
                ),
            )
        ),
    )
    context = J.leaf(**{"@context": F.lit("https://spdx.org/rdf/3.0.1/spdx-context.jsonld")})
    return J.splice(J.members(context), J.member("@graph", J.joined(graph)))


def _heads(profiles: DataFrame) -> DataFrame:
    heads = profiles.withColumn("_ns", namespace())
    return heads if "parameter_count" in heads.columns else heads.withColumn("parameter_count", F.lit(None).cast("string"))


def emit_spdx(
    profiles: DataFrame, node_rows: DataFrame, generated_at: str, tool_version: str = "1.0", limit: int | None = None
) -> DataFrame:
    """``(artifact_id, document, large)``. ``node_rows`` comes from ``spdx_nodes``."""
    heads = _heads(profiles)
    renamed = node_rows.withColumn("section", F.concat("section", F.lit("_nodes")))
    return J.assembled(heads, renamed, [f"{s}_nodes" for s in SECTIONS], _document(generated_at, tool_version), limit)


def spdx_pieces(profiles: DataFrame, node_rows: DataFrame, generated_at: str, tool_version: str = "1.0") -> DataFrame:
    """The documents of ``emit_spdx`` as pieces for ``streams.write``."""
    order = ["hyperparameters", "limitations", "files", "datasets", "basemodels", "rel_files", "dataset_ids", "basemodel_ids"]
    sections = [ST.Section(s, in_string=s == "limitations") for s in order]
    return ST.pieces(_heads(profiles), node_rows, sections, _document(generated_at, tool_version), "_nodes")
