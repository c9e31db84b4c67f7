"""Facts measured from tensors, metadata and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..functions.lookups import lookup, nullif_empty
from .skew import first_n_per_key, first_row_per_key

INT64_MAX = S.INT64_MAX


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def _clamped(total: Column) -> Column:
    return F.least(total, F.lit(INT64_MAX).cast("decimal(38,0)")).cast("bigint")


def measured_parameters(tensors: DataFrame) -> DataFrame:
    """Parameters of each artifact, over all its tensors; saturates instead of overflowing."""
    count = S.element_count(F.col("shape")).cast("decimal(20,0)")
    return tensors.groupBy("artifact_id").agg(
        _clamped(F.sum(count)).alias("measured_parameters"),
        F.count(F.lit(1)).cast("int").alias("tensor_count"),
    )


def dominant_dtype(tensors: DataFrame) -> DataFrame:
    """The type that holds most parameters; a tie goes to the smaller name."""
    weight = F.sum(S.positive_element_count(F.col("shape")).cast("decimal(20,0)"))
    per_type = tensors.groupBy("artifact_id", "dtype").agg(weight.alias("weight"))
    return per_type.groupBy("artifact_id").agg(
        F.min_by("dtype", F.struct((-F.col("weight")).alias("w"), F.col("dtype"))).alias("dtype")
    )


def tensor_inventory(tensors: DataFrame, keep: int = V.TENSOR_DETAIL_CAP) -> DataFrame:
    """The first ``keep`` tensors of each artifact with the true number of tensors."""
    order = [F.col("ord"), F.col("name")]
    totals = tensors.groupBy("artifact_id").agg(F.count(F.lit(1)).cast("int").alias("tensor_count"))
    return first_n_per_key(tensors, ["artifact_id"], order, keep, "position").join(totals, "artifact_id")


# --- metadata ------------------------------------------------------------------------------------
IDENTITY_KEYS = {
    "gguf": {
        "name": ["general.name"],
        "version": ["general.version"],
        "author": ["general.author"],
        "organization": ["general.organization"],
        "description": ["general.description"],
        "uuid": ["general.uuid"],
        "url": ["general.url", "general.repo_url"],
        "repo_url": ["general.repo_url"],
        "doi": ["general.doi"],
        "license": ["general.license", "general.license.name"],
        "license_url": ["general.license.link"],
        "architecture": ["general.architecture"],
        "parameter_count": ["general.size_label"],
        "file_type": ["general.file_type"],
        "producer": ["general.quantized_by"],
        "commit": ["general.source.commit"],
    },
    "safetensors": {
        "name": ["__metadata__.name", "__metadata__.model_name", "__metadata__.general.name"],
        "license": ["__metadata__.license", "__metadata__.general.license"],
        "base_model": ["__metadata__.base_model", "__metadata__.general.base_model"],
        "architecture": ["__metadata__.architecture", "__metadata__.model_type"],
        "framework": ["__metadata__.format"],
    },
    "onnx": {
        "name": ["metadata_props.model_name", "metadata_props.name"],
        "author": ["metadata_props.author", "metadata_props.organization"],
        "license": ["metadata_props.license", "metadata_props.licenses"],
        "description": ["metadata_props.description"],
    },
}
LIFTED = [
    "name", "version", "author", "organization", "description", "uuid", "url", "repo_url", "doi", "license",
    "license_url", "architecture", "parameter_count", "file_type", "producer", "commit", "base_model", "framework",
]


def metadata_lift(raw_kv: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Identity, license and parameters of each artifact from its metadata keys, with fall-back order.

    ``artifacts(artifact_id, format, primary_path)``. Only the listed keys are shuffled, and each is a
    conditional aggregate, so the largest artifact costs no more per task than the others.
    """
    keys = sorted({k for spec in IDENTITY_KEYS.values() for names in spec.values() for k in names})
    column = {k: f"k{i}" for i, k in enumerate(keys)}
    wanted = raw_kv.filter(F.col("key").isin(keys) & (F.col("value") != ""))
    wide = wanted.groupBy("artifact_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(column[k]) for k in keys]
    )
    joined = artifacts.select("artifact_id", "format", "primary_path").join(wide, "artifact_id", "left")

    def lifted(field: str) -> Column:
        result = F.lit(None).cast("string")
        for fmt, spec in IDENTITY_KEYS.items():
            if field in spec:
                value = F.coalesce(*[F.col(column[k]) for k in spec[field]])
                result = F.when(F.col("format") == fmt, value).otherwise(result)
        return result

    rows = joined.select("artifact_id", "format", "primary_path", *[lifted(f).alias(f) for f in LIFTED])
    framework = (
        F.when(F.col("format") == "gguf", "gguf/ggml")
        .when(F.col("framework").isNotNull(), F.concat(F.lit("safetensors ("), F.col("framework"), F.lit(")")))
        .otherwise(F.col("format"))
    )
    stem = F.regexp_replace(S.base_name(F.col("primary_path")), r"\.[^.]*$", "")
    return rows.withColumns(
        {
            "name": F.coalesce("name", nullif_empty(stem)),
            "framework": framework,
            "quantization": S.quantization_name(F.col("file_type")),
            "license_id": S.license_resolve(F.col("license"))["spdx_id"],
        }
    ).drop("primary_path", "file_type")


def hyperparameters(raw_kv: DataFrame) -> DataFrame:
    """Long form of the keys under the architecture's own prefix, without its vocabulary."""
    architecture = (
        raw_kv.filter((F.col("key") == "general.architecture") & (F.col("value") != ""))
        .groupBy("artifact_id")
        .agg(F.max("value").alias("arch"))
    )
    keyed = raw_kv.join(architecture, "artifact_id")
    own = F.startswith("key", F.concat("arch", F.lit("."))) & ~F.startswith("key", F.concat("arch", F.lit(".vocab")))
    quantization = F.col("key") == "general.quantization_version"
    return keyed.filter(own | (quantization & (F.col("value") != ""))).select(
        "artifact_id",
        F.when(quantization, "quantization_version")
        .otherwise(F.substr("key", F.length("arch") + 2))
        .alias("name"),
        "value",
    )


def lineage_collect(raw_kv: DataFrame, group: str = "general.base_model") -> DataFrame:
    """``group.N.field`` keys to one reference per N, in numeric order of N."""
    prefix = group + "."
    rest = F.substr("key", F.lit(len(prefix) + 1))
    parts = raw_kv.filter(F.startswith("key", F.lit(prefix)) & F.contains(rest, F.lit("."))).select(
        "artifact_id",
        F.regexp_extract(rest, r"^([^.]*)\.", 1).alias("idx"),
        F.regexp_extract(rest, r"^[^.]*\.(.*)$", 1).alias("field"),
        nullif_empty(F.col("value")).alias("value"),
    )

    def field(*names: str) -> Column:
        return F.max(F.when(F.col("field").isin(*names), F.col("value")))

    refs = parts.groupBy("artifact_id", "idx").agg(
        F.coalesce(field("name"), field("organization")).alias("name"),
        F.coalesce(field("url"), field("repo_url")).alias("url"),
        field("doi").alias("doi"),
    )
    return refs.filter(F.coalesce("name", "url", "doi").isNotNull()).withColumn("ord", F.col("idx").try_cast("int"))


def custom_domains(opsets: DataFrame) -> DataFrame:
    """Long form of the operator domains outside the standard ones, each once per artifact."""
    outside = ~F.coalesce(F.col("domain"), F.lit("")).isin(V.STANDARD_ONNX_DOMAINS)
    return opsets.filter(outside).select("artifact_id", "domain").distinct()


def filter_initializers(inputs: DataFrame, initializers: DataFrame) -> DataFrame:
    """Graph inputs that are not weights."""
    return inputs.join(initializers.select("artifact_id", "name").distinct(), ["artifact_id", "name"], "left_anti")


# --- files of an artifact --------------------------------------------------------------------------
def format_set(files: DataFrame) -> DataFrame:
    """Distinct model formats present, one row each."""
    return (
        files.select("artifact_id", S.format_by_ext(F.col("path")).alias("format")).filter("format IS NOT NULL").distinct()
    )


PRIMARY_ORDER = {".gguf": 0, ".ggml": 0, ".safetensors": 1, ".onnx": 2}


def primary_file(files: DataFrame) -> DataFrame:
    """The file an artifact is described by: first by name of the best top-level format present."""
    priority = lookup(PRIMARY_ORDER, S.extension(F.col("path")))
    candidates = files.filter(~F.contains("path", F.lit("/"))).withColumn("_p", priority).filter("_p IS NOT NULL")
    return candidates.groupBy("artifact_id").agg(F.min_by("path", F.struct("_p", "path")).alias("primary_path"))


def peer_weights(files: DataFrame, primary: DataFrame) -> DataFrame:
    """Long form of files beside the primary one, in its folder, in formats that execute on load.

    An artifact without a primary file is taken to be described at the top of its tree.
    """
    weights = files.select("artifact_id", "path").filter(S.extension(F.col("path")).isin(V.PEER_WEIGHT_EXTS))
    described = F.coalesce("primary_path", F.lit(""))
    return (
        weights.join(primary.select("artifact_id", "primary_path"), "artifact_id", "left")
        .filter((F.col("path") != described) & (_folder(F.col("path")) == _folder(described)))
        .select("artifact_id", "path")
    )


SPLIT_NAME = r"-[0-9]{5}-of-[0-9]{5}\.gguf$"


def component_set(
    files: DataFrame,
    primary: DataFrame,
    shard_refs: DataFrame,
    external_refs: DataFrame,
    max_files: int | None = None,
) -> DataFrame:
    """Files that make up each model with their role: primary, shard or external-data.

    References that leave the directory are never followed; a file named twice keeps its first role;
    only a caller's ``max_files`` cuts the set, in role and name order, and ``detect_component`` flags the cut.
    """
    return _resolved(component_references(files, primary, shard_refs, external_refs), files, max_files)


def component_references(
    files: DataFrame, primary: DataFrame, shard_refs: DataFrame, external_refs: DataFrame
) -> DataFrame:
    """Every (artifact, path, role) a model names, before asking whether the file exists."""
    main = primary.select("artifact_id", F.col("primary_path").alias("path"), F.lit("primary").alias("role"))
    split_primary = primary.filter(F.rlike("primary_path", F.lit(SPLIT_NAME))).select(
        "artifact_id", F.regexp_replace("primary_path", SPLIT_NAME, "").alias("_base")
    )
    split = (
        files.filter(F.rlike("path", F.lit(SPLIT_NAME)))
        .join(split_primary, "artifact_id")
        .filter(F.startswith("path", F.col("_base")))
        .select("artifact_id", "path", F.lit("shard").alias("role"))
    )
    shards = shard_refs.select("artifact_id", "path", F.lit("shard").alias("role"))
    external = external_refs.select("artifact_id", "path", F.lit("external-data").alias("role"))
    everything = main.unionByName(split).unionByName(shards).unionByName(external)
    order = lookup({"primary": 0, "shard": 1, "external-data": 2}, F.col("role"))
    return first_row_per_key(everything, ["artifact_id", "path"], [order])


def _resolved(references: DataFrame, files: DataFrame, max_files: int | None) -> DataFrame:
    from ..functions.paths import path_traversal

    order = [lookup({"primary": 0, "shard": 1, "external-data": 2}, F.col("role")), F.col("path")]
    followed = references.filter(~path_traversal(F.col("path")))
    present = followed.join(files, ["artifact_id", "path"])
    return present if max_files is None else first_n_per_key(present, ["artifact_id"], order, max_files)
