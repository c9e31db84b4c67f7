"""Scan of a fleet: contents, listings, metadata and declarations to findings, scanner results and verdicts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, drift, findings, gate, measure
from ..session import cut_lineage
from ..sources import files as file_source


@dataclass
class Fleet:
    """Input tables of a scan. Everything but ``artifacts`` and ``files`` may be missing."""

    artifacts: DataFrame  # artifact_id, format, primary_path, policy_id
    files: DataFrame  # artifact_id, path, size, content
    listing: DataFrame | None = None  # artifact_id, path, is_exec, link_target
    raw_kv: DataFrame | None = None  # artifact_id, key, value
    tensors: DataFrame | None = None  # artifact_id, ord, name, dtype, shape
    licenses: DataFrame | None = None  # artifact_id, ord, raw, spdx_id
    declared: DataFrame | None = None  # columns of drift.INPUTS
    domains: DataFrame | None = None  # artifact_id, domain
    archive_entries: DataFrame | None = None
    failures: DataFrame | None = None  # artifact_id, path, error


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _numbered(rows: DataFrame, scanner: str) -> DataFrame:
    """A stable position that needs no global order: findings of one place and rule keep together.

    It stays below the step between two severities in documents, so it never outweighs one.
    """
    position = F.pmod(F.xxhash64("id", "location", "title", "description"), F.lit(10**12))
    return rows.withColumns({"scanner": F.lit(scanner), "ord": position})


def measured(fleet: Fleet) -> DataFrame:
    """Declared facts beside measured ones, one row per artifact."""
    rows = fleet.artifacts
    if fleet.declared is not None:
        rows = rows.join(fleet.declared.drop("format", "primary_path"), "artifact_id", "left")
    if fleet.tensors is not None:
        rows = rows.join(measure.measured_parameters(fleet.tensors), "artifact_id", "left")
        if "dtype" not in rows.columns:
            rows = rows.join(measure.dominant_dtype(fleet.tensors), "artifact_id", "left")
    return rows


def parsed_findings(fleet: Fleet) -> DataFrame:
    """What the formats disclose about themselves."""
    spark = fleet.artifacts.sparkSession
    kv = fleet.raw_kv if fleet.raw_kv is not None else spark.createDataFrame([], "artifact_id string, key string, value string")
    licenses = fleet.licenses if fleet.licenses is not None else spark.createDataFrame([], "artifact_id string, spdx_id string")
    found = [
        detect.detect_metadata(fleet.artifacts, kv, licenses, fleet.domains),
        file_source.header_findings(fleet.files, strict=True),
        drift.drift(measured(fleet)).drop("ord"),
    ]
    return _numbered(_union(found), "aibom")


def walked_findings(fleet: Fleet) -> DataFrame:
    """What a walk over the files finds. All of them are examined, so none is reported as left out."""
    found = [detect.inspect_contents(fleet.files), file_source.header_findings(fleet.files)]
    if fleet.listing is not None:
        found.append(detect.detect_file_meta(fleet.listing))
    if fleet.archive_entries is not None:
        found.append(detect.detect_archive(fleet.archive_entries))
    if fleet.failures is not None:
        found.append(detect.detect_unreadable(fleet.failures))
    return _numbered(_union(found), "model-inspector")


def scan(
    fleet: Fleet,
    rules: DataFrame | None = None,
    exceptions: DataFrame | None = None,
    now: datetime | None = None,
) -> dict[str, DataFrame]:
    """``findings`` (merged), ``results`` (one row per scanner) and ``verdicts`` (one row per artifact)."""
    # findings are used three times and contents are large: read the contents once
    parsed, walked = cut_lineage(parsed_findings(fleet)), cut_lineage(walked_findings(fleet))
    merged = findings.merge_findings(parsed, walked)
    ran = fleet.artifacts.select(
        "artifact_id",
        F.explode(F.array(F.struct(F.lit("aibom").alias("scanner"), F.lit(True).alias("produced")),
                          F.struct(F.lit("model-inspector").alias("scanner"), F.lit(None).cast("boolean").alias("produced")))).alias("s"),
    ).select("artifact_id", "s.*")
    results = findings.scanner_results(parsed.unionByName(walked), ran)
    verdicts = gate.evaluate(results, fleet.artifacts, rules, exceptions, now)
    return {"findings": merged, "results": results, "verdicts": verdicts}
