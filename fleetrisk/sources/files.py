"""File scans: inventories, format detection, and headers of files too large for one row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..functions.lookups import nullif_empty
from ..operators.detect import EMPTY, _begins, emit, finding, little_endian
from ..operators.skew import first_n_per_key
from ..session import tolerate_repeated_keys


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<artifact_id>/``. Column pruning drops ``content`` when nobody asks for it.

    Spark's own listing passes over names that start with a dot or an underscore; where those matter, bring
    a listing table and read their contents by URI.
    """
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    below = F.regexp_extract("path", r"^.*?" + java_literal(base) + r"(.*)$", 1)
    return rows.select(
        F.split_part(below, F.lit("/"), F.lit(1)).alias("artifact_id"),
        F.regexp_replace(below, r"^[^/]*/", "").alias("path"),
        F.col("length").alias("size"),
        "modificationTime",
        "content",
        F.col("path").alias("uri"),
    )


def java_literal(text: str) -> str:
    """A literal text as a Java pattern."""
    return r"\Q" + text + r"\E"


def file_inventory(listing: DataFrame, max_files: int | None = None, hide_dotfiles: bool = False) -> DataFrame:
    """All files; or, in walk order, the first ``max_files`` of an artifact, with a flag when it has more."""
    rows = listing
    if hide_dotfiles:
        rows = rows.filter(~F.rlike("path", F.lit(r"(^|/)\.")))
    facts = {"extension": nullif_empty(S.extension(F.col("path"))), "format": S.format_by_ext(F.col("path"))}
    if max_files is None:
        return rows.withColumns({**facts, "truncated": F.lit(False)})
    # a walk visits directories in name order, which is the order of the path's segments
    order = [F.split("path", "/")]
    sizes = rows.groupBy("artifact_id").agg((F.count(F.lit(1)) > max_files).alias("truncated"))
    return first_n_per_key(rows, ["artifact_id"], order, max_files).withColumns(facts).join(sizes, "artifact_id")


def format_detect(files: DataFrame) -> DataFrame:
    """Format by content first, then by extension; files of no known format give no row."""
    content, ext = F.col("content"), S.extension(F.col("path"))
    length = little_endian(content, 1, 8)
    plausible = (length > 0) & (length < V.MAX_SAFETENSORS_HEADER)
    detected = (
        F.when(_begins(content, V.MAGIC_GGUF), "gguf")
        .when(plausible & (ext == ".safetensors"), "safetensors")
        .when(ext == ".onnx", "onnx")
        .when(ext == ".safetensors", "safetensors")
        .when(ext.isin(".gguf", ".ggml"), "gguf")
    )
    return files.select("artifact_id", "path", detected.alias("format")).filter("format IS NOT NULL")


def read_headers(listing: DataFrame, limit: int = V.MAX_SAFETENSORS_HEADER) -> DataFrame:
    """Only the safetensors header of each file, read where the row lives. Input (artifact_id, path, uri).

    For files too large for a row; tensor data is never read. Output fits ``header_safetensors``.
    """

    def heads(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for batch in batches:
            contents, sizes = [], []
            for uri in batch["uri"]:
                system, name = fs.FileSystem.from_uri(uri)
                with system.open_input_file(name) as handle:
                    prefix = handle.read(8)
                    want = int.from_bytes(prefix, "little") if len(prefix) == 8 else 0
                    contents.append(prefix + (handle.read(want) if want <= limit else b""))
                    sizes.append(handle.size())
            yield batch[["artifact_id", "path"]].assign(size=sizes, content=contents)

    rows = listing.select("artifact_id", "path", "uri").repartition("uri")
    return rows.mapInPandas(heads, "artifact_id string, path string, size bigint, content binary")


# --- safetensors headers ------------------------------------------------------------------------------------
TENSOR = "dtype string, shape array<bigint>"


def _headers(files: DataFrame, strict: bool) -> DataFrame:
    """Adds ``declared`` (header length), ``problem`` (finding or NULL) and ``entries`` (header map)."""
    tolerate_repeated_keys(files.sparkSession)
    content, path = F.col("content"), F.col("path")
    declared = little_endian(content, 1, 8)
    size = F.col("size").cast("decimal(20,0)")
    too_long = (
        (declared == 0) | (declared > V.MAX_SAFETENSORS_HEADER) | (declared + 8 > size)
        if strict
        else (declared > V.MAX_SAFETENSORS_HEADER) | (declared > size)
    )
    fits = declared + 8 <= F.length(content)
    header = F.when(~too_long & fits, S.utf8_text(F.substr(content, F.lit(9), declared.cast("int"))))
    rows = files.withColumns({"declared": declared, "_long": too_long, "_header": header})
    parsed = F.when(
        F.startswith(F.schema_of_variant(F.try_parse_json("_header")), F.lit("OBJECT")),
        F.from_json("_header", "map<string,string>"),
    )
    rows = rows.withColumn("entries", parsed)
    problem = (
        F.when(
            F.col("declared").isNull(),
            finding("AR-ST-001", "Truncated tensor header", "Medium", path, "no room for the length prefix"),
        )
        .when(
            F.col("_long"),
            finding("AR-ST-002", "Invalid tensor header length", "High", path, F.col("declared").cast("string")),
        )
        .when(
            F.col("_header").isNull(),
            finding("AR-ST-001", "Truncated tensor header", "Medium", path, "shorter than declared"),
        )
        .when(
            F.col("entries").isNull(),
            finding("AR-ST-003", "Unreadable tensor header", "Medium", path, "not a JSON object"),
        )
    )
    return rows.withColumn("problem", problem)


def header_safetensors(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tensors, metadata and findings of safetensors files. Input (artifact_id, path, size, content)."""
    rows = _headers(files, strict=True)
    named = F.filter(F.sort_array(F.map_entries("entries")), lambda e: e["key"] != "__metadata__")
    tensors = rows.select("artifact_id", "path", F.posexplode(named).alias("ord", "e")).select(
        "artifact_id", "path", "ord", F.col("e.key").alias("name"), F.from_json("e.value", TENSOR).alias("t")
    ).select("artifact_id", "path", "ord", "name", "t.dtype", "t.shape")
    metadata = rows.select(
        "artifact_id", "path",
        F.explode(F.from_json(F.try_element_at("entries", F.lit("__metadata__")), "map<string,string>")).alias("key", "value"),
    )
    lifted = metadata.select("artifact_id", F.concat(F.lit("__metadata__."), "key").alias("key"), "value").filter("value <> ''")
    findings = emit(rows, F.array_compact(F.array("problem")))
    return tensors, lifted, findings


def header_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """The walk's own header check, which is a little more lenient than the parser's."""
    rows = _headers(files.filter(S.extension(F.col("path")) == ".safetensors"), strict)
    return emit(rows, F.coalesce(F.array_compact(F.array("problem")), F.array().cast(EMPTY)))

