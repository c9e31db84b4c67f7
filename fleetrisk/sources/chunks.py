"""Files of any size as rows of byte ranges.

A row ``(artifact_id, path, size, offset, before, content)`` is one range of a file: ``content`` from ``offset`` on, and
``before``, the bytes just ahead of it, so that whatever crosses the edge of two ranges lies whole in the later one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 32 << 20
OVERLAP = 1 << 16  # bytes; whatever is longer than this is not seen where it crosses an edge
SCHEMA = "artifact_id string, path string, size bigint, offset bigint, before binary, content binary"


def chunked(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """The ranges of files that fit a row, ``(artifact_id, path, content)``; an empty file is one empty range."""
    size = F.length("content").cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(size - 1, F.lit(0).cast("bigint")), F.lit(chunk_bytes).cast("bigint"))

    def cut(offset):
        ahead = F.least(offset, F.lit(overlap)).cast("int")
        at = (offset + 1).cast("int")
        return F.struct(
            offset.alias("offset"),
            F.substr("content", at - ahead, ahead).alias("before"),
            F.substr("content", at, F.lit(chunk_bytes)).alias("content"),
        )

    # cut before they are rows, so that no range carries the whole content
    rows = files.select("artifact_id", "path", size.alias("size"), F.explode(F.transform(starts, cut)).alias("r"))
    return rows.select("artifact_id", "path", "size", "r.*")


def _source():
    """The data source ``byte_ranges``; made in a function, so that it travels by value to workers without this package."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Ranges(InputPartition):
        def __init__(self, value):
            super().__init__(value)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.root = options["path"].rstrip("/")
            self.chunk = int(options.get("chunkbytes", 32 << 20))
            self.overlap = int(options.get("overlap", 1 << 16))

        def partitions(self):
            """Ranges in batches of a chunk's size, so that small files share a task and a large file is many tasks."""
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(self.root)
            batches, held = [[]], 0
            infos = system.get_file_info(fs.FileSelector(base, recursive=True))
            for info in sorted((i for i in infos if i.type == fs.FileType.File), key=lambda i: i.path):
                below = info.path[len(base) :].lstrip("/")
                artifact, _, path = below.partition("/")
                for offset in range(0, max(info.size, 1), self.chunk):
                    take = min(self.chunk, info.size - offset)
                    if batches[-1] and held + take > self.chunk:
                        batches.append([])
                        held = 0
                    batches[-1].append((artifact, path, info.path, info.size, offset, take))
                    held += take
            return [Ranges(b) for b in batches if b]

        def read(self, partition):
            import pyarrow as pa
            from pyarrow import fs

            system, _ = fs.FileSystem.from_uri(self.root)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["artifact_id", "path", "size", "offset", "before", "content"]
            for artifact, path, name, size, offset, take in partition.value:
                ahead = min(offset, self.overlap)
                with system.open_input_file(name) as handle:
                    handle.seek(offset - ahead)
                    data = handle.read(ahead + take)
                row = (artifact, path, size, offset, data[:ahead], data[ahead:])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    class ByteRanges(DataSource):
        @classmethod
        def name(cls):
            return "byte_ranges"

        def schema(self):
            return "artifact_id string, path string, size bigint, offset bigint, before binary, content binary"

        def reader(self, schema):
            return Reader(self.options)

    return ByteRanges


def read_ranges(spark: SparkSession, root: str, chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """Files below ``root/<artifact_id>/``, also hidden ones, as byte ranges; ``root`` is a URI that pyarrow can open.

    Only names and sizes are listed on the driver. A range is read where its task runs.
    """
    spark.dataSource.register(_source())
    uri = root if "://" in root else f"file://{root}"
    return spark.read.format("byte_ranges").option("chunkBytes", chunk_bytes).option("overlap", overlap).load(uri)
