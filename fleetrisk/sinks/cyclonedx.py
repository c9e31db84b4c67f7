"""CycloneDX documents: one per artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.lookups import nullif_empty
from ..functions.paths import purl
from ..operators.coverage import executable_property, file_executable_property, file_structured_property
from . import parts as J
from . import streams as ST

VERSIONS = ["1.6", "1.7"]
SECTIONS = [
    "licenses", "datasets", "hyperparameters", "ancestors", "components", "vulnerabilities",
]
PREFIX = "fleetrisk:"
NO_TEXTS = "array<string>"


def _prop(name: str | Column, value: Column) -> Column:
    label = name if isinstance(name, Column) else F.lit(name)
    return F.when(value.isNotNull(), J.record(name=label, value=value))


def hashes(prefix: str = "") -> Column:
    def one(bits: int) -> Column:
        value = nullif_empty(F.col(f"{prefix}sha{bits}"))
        return F.when(value.isNotNull(), J.record(alg=F.lit(f"SHA-{bits}"), content=value))

    return J.present(one(256), one(384), one(512))


def _file_properties(executable: Column, structured: Column, path: Column) -> list[Column]:
    return [
        _prop("bsi:component:executable", executable),
        _prop("bsi:component:archive", F.lit("no archive")),
        _prop("bsi:component:structured", structured),
        _prop("bsi:component:filename", nullif_empty(path)),
    ]


def _external(kind: str, url: Column) -> Column:
    return F.when(url.isNotNull(), J.record(type=F.lit(kind), url=url))


def _doi(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), F.regexp_replace(doi, "^doi:", ""))


def model_reference() -> Column:
    name = F.coalesce("name", F.lit(""))
    return F.concat(F.lit("urn:fleetrisk:model:"), S.short_id(F.col("primary_sha256"), name))


def cyclonedx_nodes(
    profiles: DataFrame,
    files: DataFrame,
    licenses: DataFrame,
    datasets: DataFrame,
    domains: DataFrame,
    findings: DataFrame,
    hyperparameters: DataFrame | None = None,
    references: DataFrame | None = None,
) -> DataFrame:
    """All list members of the documents as nodes.

    ``references(artifact_id, ord, name, url, doi)`` are base models and sources, base models first. The
    profile is read for several lists, so pass a written or checkpointed one.
    """
    c = F.col
    kind = profiles.select("artifact_id", "format", "chat_template", "domains_count")
    component = J.leaf(
        type=F.lit("file"),
        bom__ref=F.concat(F.lit("urn:fleetrisk:file:"), S.short_id(nullif_empty(c("sha256")), c("path"))),
        name=c("path"),
        hashes=hashes(),
        properties=J.present(
            _prop(PREFIX + "role", c("role")),
            _prop(PREFIX + "size", c("size").cast("string")),
            *_file_properties(file_executable_property(), file_structured_property(), c("path")),
        ),
    )
    others = files.filter(c("role") != "primary").join(kind, "artifact_id")
    library = J.leaf(
        type=F.lit("library"),
        bom__ref=F.concat(F.lit("urn:fleetrisk:op-domain:"), S.slug(c("domain"))),
        name=c("domain"),
        properties=J.present(_prop(PREFIX + "role", F.lit("custom-operator-domain"))),
    )
    vulnerability = J.leaf(
        id=c("id"),
        source=J.record(name=F.lit("fleetrisk")),
        ratings=F.array(J.record(severity=F.lower("severity"), method=F.lit("other"))),
        description=F.concat(F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("description", F.lit(""))),
        affects=F.array(J.record(ref=c("_ref"))),
    )
    reported = findings.join(profiles.select("artifact_id", model_reference().alias("_ref")), "artifact_id")
    spdx, own = nullif_empty(c("spdx_id")), nullif_empty(c("raw"))
    url = nullif_empty(c("url")) if "url" in licenses.columns else F.lit(None).cast("string")
    listed = F.startswith(spdx, F.lit("LicenseRef-"))
    choice = J.leaf(
        license=J.record(
            id=F.when(~listed, spdx), name=F.when(spdx.isNull(), own).when(listed, spdx), url=url
        )
    )
    result = (
        J.nodes(others, "components", F.lit(0), c("path"), component)
        .unionByName(J.nodes(domains, "components", F.lit(1), c("domain"), library))
        .unionByName(J.nodes(reported, "vulnerabilities", c("ord"), c("id"), vulnerability))
        .unionByName(
            J.nodes(licenses.filter(spdx.isNotNull() | own.isNotNull()), "licenses", c("ord"), c("raw"), choice)
        )
        .unionByName(
            J.nodes(datasets, "datasets", c("ord"), c("name"), J.leaf(type=F.lit("dataset"), name=c("name")))
        )
    )
    if hyperparameters is not None:
        entry = F.to_json(_prop(F.concat(F.lit("hyperparameter:"), c("name")), c("value")))
        result = result.unionByName(J.nodes(hyperparameters, "hyperparameters", F.lit(0), c("name"), entry))
    if references is not None:
        links = J.present(_external("vcs", nullif_empty(c("url"))), _external("other", _doi(nullif_empty(c("doi")))))
        ancestor = J.leaf(
            type=F.lit("machine-learning-model"), name=F.coalesce("name", F.lit("")), externalReferences=links
        )
        result = result.unionByName(J.nodes(references, "ancestors", c("ord"), c("name"), ancestor))
    return result


def _document(profiles: DataFrame, version: str, generated_at: str, tool_version: str) -> Column:
    c = F.col
    name = F.coalesce("name", F.lit(""))
    serial = S.serial_uuid(F.concat(F.coalesce("primary_sha256", F.lit("")), name))

    def shapes(side: str) -> Column:
        described = F.transform(side, lambda s: J.record(format=S.io_format(s["dtype"], s["shape"], F.lit(None).cast("string"))))
        return F.to_json(F.when(F.size(side) > 0, described))

    parameters = J.non_empty(
        J.splice(
            J.members(
                J.leaf(task=c("task"), architectureFamily=c("architecture"), modelArchitecture=c("architecture"))
            ),
            J.member("datasets", J.joined(c("datasets_nodes"))),
            J.member("inputs", shapes("inputs")),
            J.member("outputs", shapes("outputs")),
        )
    )
    none = F.array().cast(NO_TEXTS)

    def as_json(properties: Column) -> Column:
        return F.coalesce(F.transform(properties, lambda p: F.to_json(p)), none)

    card_properties = F.concat(
        as_json(
            J.present(
                _prop(PREFIX + "quantization", c("quantization")),
                _prop(PREFIX + "dtype", c("dtype")),
                _prop(PREFIX + "parameterCount", c("parameter_count")),
            )
        ),
        F.coalesce("hyperparameters_nodes", none),
    )
    card = J.non_empty(
        J.splice(J.member("modelParameters", parameters), J.member("properties", J.joined(card_properties)))
    )
    properties = as_json(
        J.present(
            _prop(PREFIX + "format", c("format")),
            _prop(PREFIX + "framework", c("framework")),
            _prop(PREFIX + "uuid", c("uuid")),
            _prop(PREFIX + "irVersion", c("ir_version")),
            _prop(PREFIX + "producer", c("producer")),
            _prop(PREFIX + "tensorCount", F.when(c("tensor_count") > 0, c("tensor_count").cast("string"))),
            *_file_properties(executable_property(), F.lit("structured"), c("primary_path")),
            _prop(PREFIX + "primaryFile", nullif_empty(c("primary_path"))),
            _prop(PREFIX + "size", c("primary_size").cast("string")),
            _prop(
                PREFIX + "measuredParameters",
                F.when(c("measured_parameters") > 0, c("measured_parameters").cast("string")),
            ),
        )
    )
    if "opset_imports" in profiles.columns:
        label = lambda o: F.concat(F.lit("onnx:opset:"), F.coalesce(nullif_empty(o["domain"]), F.lit("ai.onnx")))
        opsets = F.transform("opset_imports", lambda o: F.to_json(_prop(label(o), o["version"].cast("string"))))
        properties = F.concat(properties, F.coalesce(opsets, none))
    vcs = F.when(F.coalesce(c("repo_url") != c("url"), F.lit(True)), c("repo_url"))
    maker = F.coalesce("organization", "author")
    head = J.leaf(
        type=F.lit("machine-learning-model"),
        bom__ref=model_reference(),
        name=name,
        version=c("version"),
        purl=purl(F.coalesce("repo_url", "url"), c("commit")),
        description=c("description"),
        publisher=c("author"),
        supplier=F.when(maker.isNotNull(), J.record(name=maker)),
    )
    sources = J.leaf(
        hashes=hashes("primary_"),
        externalReferences=J.present(
            _external("website", c("url")), _external("vcs", vcs), _external("other", _doi(c("doi")))
        ),
    )
    ancestors = F.concat(F.lit('{"ancestors":'), J.joined(c("ancestors_nodes")), F.lit("}"))
    component = J.splice(
        J.members(head),
        J.member("licenses", J.joined(c("licenses_nodes"))),
        J.members(sources),
        J.member("modelCard", card),
        J.member("pedigree", ancestors),
        J.member("properties", J.joined(properties)),
    )
    before = J.leaf(
        bomFormat=F.lit("CycloneDX"),
        specVersion=F.lit(version),
        serialNumber=F.concat(F.lit("urn:uuid:"), serial),
        version=F.lit(1),
    )
    tool = J.record(type=F.lit("application"), name=F.lit("fleetrisk"), version=F.lit(tool_version))
    metadata = J.splice(
        J.members(J.leaf(timestamp=F.lit(generated_at), tools=J.record(components=F.array(tool)))),
        J.member("component", component),
        J.members(J.leaf(lifecycles=F.array(J.record(phase=F.lit("post-build"))))),
    )
    return J.splice(
        J.members(before),
        J.member("metadata", metadata),
        J.member("components", J.joined(c("components_nodes"))),
        J.member("vulnerabilities", J.joined(c("vulnerabilities_nodes"))),
    )


HEAD_COLUMNS = {
    "task": "string", "dtype": "string", "parameter_count": "string", "commit": "string", "ir_version": "string",
    "tensor_count": "int",
}


def _heads(profiles: DataFrame, version: str) -> DataFrame:
    if version not in VERSIONS:
        raise ValueError(f"unsupported CycloneDX version {version!r}: use {', '.join(VERSIONS)}")
    missing = {n: F.lit(None).cast(t) for n, t in HEAD_COLUMNS.items() if n not in profiles.columns}
    return profiles.withColumns(missing) if missing else profiles


def emit_cyclonedx(
    profiles: DataFrame,
    node_rows: DataFrame,
    generated_at: str,
    version: str = "1.6",
    tool_version: str = "1.0",
    limit: int | None = None,
) -> DataFrame:
    """``(artifact_id, document, large)``. ``node_rows`` comes from ``cyclonedx_nodes``."""
    heads = _heads(profiles, version)
    # section names double as head columns, so the gathered arrays get a suffix
    renamed = node_rows.withColumn("section", F.concat("section", F.lit("_nodes")))
    sections = [f"{s}_nodes" for s in SECTIONS]
    return J.assembled(heads, renamed, sections, _document(heads, version, generated_at, tool_version), limit)


def cyclonedx_pieces(profiles: DataFrame, node_rows: DataFrame, generated_at: str, version: str = "1.6", tool_version: str = "1.0") -> DataFrame:
    """The documents of ``emit_cyclonedx`` as pieces for ``streams.write``."""
    heads = _heads(profiles, version)
    return ST.pieces(heads, node_rows, [ST.Section(s) for s in SECTIONS], _document(heads, version, generated_at, tool_version), "_nodes")
