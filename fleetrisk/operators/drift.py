"""Declared facts against measured ones. One row per artifact in, one row per disagreement out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.lookups import nullif_empty, rows_where

# columns a drift input row may have; missing ones are taken as not disclosed
INPUTS = {
    "format": "string",
    "primary_path": "string",
    "declared_source": "string",
    "declared_architecture": "string",
    "declared_dtype": "string",
    "declared_quantization": "string",
    "declared_parameter_count": "string",
    "declared_shards": "int",
    "size_label": "string",
    "architecture": "string",
    "dtype": "string",
    "quantization": "string",
    "measured_parameters": "bigint",
    "present_shards": "int",
    "peer_count": "int",
    "first_peer": "string",
}
BAND = (0.80, 1.25)
INDEX_NAME = "model.safetensors.index.json"


def _prepared(rows: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in INPUTS.items() if n not in rows.columns}
    rows = rows.withColumns(missing) if missing else rows
    texts = {n: nullif_empty(F.col(n)) for n, t in INPUTS.items() if t == "string"}
    # counts are columns of their own, so that each label is parsed once however often it is used
    counts = {
        "_first_count": S.parse_count(F.col("declared_parameter_count")),
        "_second_count": S.parse_count(F.col("size_label")),
    }
    first_known = F.coalesce(F.col("_first_count") > 0, F.lit(False))
    chosen = {
        "_declared_count": F.when(first_known, F.col("_first_count")).otherwise(F.col("_second_count")),
        "_declared_label": F.when(first_known, F.col("declared_parameter_count")).otherwise(F.col("size_label")),
    }
    measured, declared = F.col("measured_parameters"), F.col("_declared_count")
    ratio = F.when((measured > 0) & (declared > 0), measured.cast("double") / declared.cast("double"))
    return rows.withColumns(texts).withColumns(counts).withColumns(chosen).withColumn("_ratio", ratio)


def _finding(number: int, severity: str, title: str, location: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(f"AR-DRIFT-{number:03d}").alias("id"),
        F.lit(title).alias("title"),
        F.lit(severity).alias("severity"),
        F.lit("drift").alias("category"),
        F.coalesce(location, F.lit("")).alias("location"),
        detail.alias("description"),
    )


def _said(declared: str, measured: str) -> Column:
    return F.concat(F.lit("declared "), F.col(declared), F.lit(", measured "), F.col(measured))


def architecture_cases() -> list[tuple[Column, Column]]:
    declared, measured = F.col("declared_architecture"), F.col("architecture")
    source = F.col("declared_source")
    disagree = declared.isNotNull() & measured.isNotNull() & ~S.arch_agrees(declared, measured)
    unchecked = declared.isNotNull() & measured.isNull() & (F.col("format") == "gguf")
    return [
        (
            unchecked,
            _finding(
                5,
                "Low",
                "Declared architecture cannot be checked",
                source,
                F.concat(F.lit("declared "), declared, F.lit(", and the file records no architecture")),
            ),
        ),
        (
            disagree,
            _finding(
                1,
                "High",
                "Declared architecture differs from the file",
                source,
                _said("declared_architecture", "architecture"),
            ),
        ),
    ]


def dtype_cases() -> list[tuple[Column, Column]]:
    declared, measured = F.col("declared_dtype"), F.col("dtype")
    disagree = declared.isNotNull() & measured.isNotNull() & ~S.dtype_agrees(declared, measured)
    title = "Declared precision differs from the tensors"
    return [(disagree, _finding(2, "High", title, F.col("declared_source"), _said("declared_dtype", "dtype")))]


def quantization_cases() -> list[tuple[Column, Column]]:
    declared, measured = F.col("declared_quantization"), F.col("quantization")
    disagree = declared.isNotNull() & measured.isNotNull() & ~S.same_text(S.strip(declared), S.strip(measured))
    title = "Declared quantization differs from the file"
    return [
        (
            disagree,
            _finding(3, "Medium", title, F.col("declared_source"), _said("declared_quantization", "quantization")),
        )
    ]


def shard_cases() -> list[tuple[Column, Column]]:
    """The index's distinct shards against those present in any role."""
    declared, present = F.col("declared_shards"), F.coalesce("present_shards", F.lit(0))
    detail = F.concat(F.lit("the index names "), declared, F.lit(" shard(s), present: "), present)
    disagree = (declared > 0) & (present != declared)
    return [(disagree, _finding(4, "High", "Shard set differs from the index", F.lit(INDEX_NAME), detail))]


def mixed_format_cases() -> list[tuple[Column, Column]]:
    peers = (F.coalesce("peer_count", F.lit(0)) > 0) & F.col("format").isin("safetensors", "gguf")
    detail = F.concat(F.lit("files that execute on load beside a safe model: "), F.col("peer_count"))
    title = "Executable weights beside a safe format"
    return [(peers, _finding(6, "Medium", title, F.col("first_peer"), detail))]


def parameter_cases() -> list[tuple[Column, Column]]:
    ratio = F.col("_ratio")
    outside = ratio.isNotNull() & ~((ratio > BAND[0]) & (ratio < BAND[1]))
    detail = F.concat(
        F.lit("declared "),
        F.col("_declared_label"),
        F.lit(" ("),
        S.human_count(F.col("_declared_count")),
        F.lit("), measured "),
        S.human_count(F.col("measured_parameters")),
        F.lit(", factor "),
        F.format_string("%.1f", S.max_ratio(ratio)),
    )
    location = F.coalesce("declared_source", "primary_path")
    title = "Declared parameter count differs from the tensors"
    return [(outside, _finding(7, "High", title, location, detail))]


CHECKS = {
    "drift_architecture": architecture_cases,
    "drift_dtype": dtype_cases,
    "drift_quantization": quantization_cases,
    "drift_shards": shard_cases,
    "drift_mixed_formats": mixed_format_cases,
    "drift_param_count": parameter_cases,
}


def drift(rows: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """Findings of the chosen checks (all six by default), in check order, in one pass over the rows."""
    cases = [case for name in (checks or CHECKS) for case in CHECKS[name]()]
    return (
        _prepared(rows)
        .select("artifact_id", F.posexplode(rows_where(*cases)).alias("ord", "f"))
        .select("artifact_id", "ord", "f.*")
    )


def shard_counts(index: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct shards an index names and how many of them exist. ``index(artifact_id, path)``."""
    keys = ["artifact_id", "path"]
    known = F.col("artifact_id").isNotNull() & F.col("path").isNotNull()  # an unknown name is no file's
    named = index.select(*keys, F.lit(True).alias("_named"), F.lit(False).alias("_found"))
    found = files.filter(known).select(*keys, F.lit(False).alias("_named"), F.lit(True).alias("_found"))
    # one table of names in memory, instead of one of each side and their join
    both = named.unionByName(found).groupBy(*keys).agg(F.bool_or("_named").alias("_named"), F.bool_or("_found").alias("_found"))
    return (
        both.filter("_named")
        .groupBy("artifact_id")
        .agg(
            F.count(F.lit(1)).cast("int").alias("declared_shards"),
            F.count_if("_found").cast("int").alias("present_shards"),
        )
    )
