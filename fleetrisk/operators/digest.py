"""File and tree digests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 8 << 20


def digest_columns(content: Column) -> list[Column]:
    """The three digests of one content, computed in one projection."""
    return [F.sha2(content, bits).alias(f"sha{bits}") for bits in (256, 384, 512)]


def file_digests(files: DataFrame, skip_hashing: bool = False) -> DataFrame:
    """Size and digests of each file; the size is kept when hashing is skipped."""
    size = F.length("content").cast("bigint").alias("size")
    if skip_hashing:
        none = [F.lit(None).cast("string").alias(f"sha{bits}") for bits in (256, 384, 512)]
        return files.select("artifact_id", "path", size, *none)
    return files.select("artifact_id", "path", size, *digest_columns(F.col("content")))


def stream_digests(listing: DataFrame) -> DataFrame:
    """Digests of files too large for one row, read in chunks where the row lives. Input (artifact_id, path, uri).

    Rows are spread by URI, so the files of one large artifact are hashed by many tasks.
    """

    def hash_batches(batches: Iterator) -> Iterator:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            sizes, sums = [], {"sha256": [], "sha384": [], "sha512": []}
            for uri in batch["uri"]:
                system, name = fs.FileSystem.from_uri(uri)
                hashes = {k: hashlib.new(k) for k in sums}
                size = 0
                with system.open_input_stream(name) as stream:
                    while chunk := stream.read(CHUNK):
                        size += len(chunk)
                        for h in hashes.values():
                            h.update(chunk)
                sizes.append(size)
                for k, h in hashes.items():
                    sums[k].append(h.hexdigest())
            yield batch[["artifact_id", "path"]].assign(size=sizes, **sums)

    spread = listing.select("artifact_id", "path", "uri").repartition("uri")
    return spread.mapInPandas(
        hash_batches, "artifact_id string, path string, size bigint, sha256 string, sha384 string, sha512 string"
    )


def tree_digest(files: DataFrame) -> DataFrame:
    """SHA-256 over the path-sorted ``"<sha256> <path>\\n"`` lines of each artifact, links left out.

    Input ``(artifact_id, path, size, sha256)``, optionally ``link_target``. An empty path means that the
    artifact is a single file, whose own digest is the answer.

    The digest is defined as one running hash, so the lines of one artifact meet in one task. Only these
    short lines do: contents were hashed elsewhere, lines are sorted by Spark (spilling to disk) and then
    streamed batch by batch, so a task holds one Arrow batch however many files an artifact has.
    """
    regular = files.filter("link_target IS NULL") if "link_target" in files.columns else files
    lines = regular.select("artifact_id", "path", "sha256", F.col("size").cast("bigint").alias("size"))

    def running_hash(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        nobody = object()
        current, state, total, single = nobody, None, 0, None

        def row():
            digest = single or state.hexdigest()
            return {"artifact_id": current, "tree_digest": "sha256:" + digest, "total_size": total}

        for batch in batches:
            done = []
            for artifact, group in batch.groupby("artifact_id", sort=False, dropna=False):
                artifact = None if pd.isna(artifact) else artifact
                if artifact != current:
                    if current is not nobody:
                        done.append(row())
                    current, state, total, single = artifact, hashlib.sha256(), 0, None
                state.update("".join(group["sha256"] + " " + group["path"] + "\n").encode())
                total += int(group["size"].sum())
                if group["path"].iloc[0] == "":
                    single = group["sha256"].iloc[0]
            yield pd.DataFrame(done, columns=["artifact_id", "tree_digest", "total_size"])
        if current is not nobody:
            yield pd.DataFrame([row()])

    ordered = lines.repartition("artifact_id").sortWithinPartitions("artifact_id", "path")
    return ordered.mapInPandas(running_hash, "artifact_id string, tree_digest string, total_size bigint")
