"""Documents of any size: pieces of text in document order, written as chunk files that tasks fill in a stream.

``pieces`` cuts the text of a document where its lists go and puts the nodes of the lists, each a row, in between. No
list is gathered into a cell. ``write`` sorts the pieces over all tasks; each task appends its own to one chunk file and
indexes the documents that begin and end in it. The driver only stitches those that reach across tasks, two a task at
most, when it commits; an aborted write leaves nothing. A chunk file is text in Zstandard frames of equal length one after
the other, which every zstd tool reads; the index says in which frame a document begins, so none is read from the start.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept, shuffles_end
from . import parts as J

PIECES = "artifact_id string, slot int, separator string, text string"
# start and bytes count text; the part lies skip bytes of text behind the frame that begins at byte frame of the file
INDEX = "artifact_id string, pieces array<struct<file: string, frame: bigint, skip: bigint, start: bigint, bytes: bigint, before: string>>"
FRAME = 1 << 20


@dataclass(frozen=True)
class Section:
    """A list of a document, named in document order. Nodes are JSON values, or lines inside a JSON string."""

    name: str
    in_string: bool = False


def pieces(heads: DataFrame, nodes: DataFrame, sections: list[Section], document: Column, suffix: str = "") -> DataFrame:
    """``artifact_id, slot, ord, tie, separator, text``: the document of every head, in pieces.

    ``document`` is the expression of the whole text over one array column for each section, as ``parts.assembled``
    takes it. Here each array that has nodes holds one mark, unique to this call, and the text is cut at the marks. The
    text between has even slots, the nodes of the i-th section slot 2 i + 1. Of the nodes only the sections
    that occur meet in a row. Nodes without a head stand alone, without a slot 0; ``write`` leaves them out, as the sort
    shows them and a join would shuffle all nodes once more.
    """
    mark = uuid.uuid4().hex
    # read for the names, the borders of the sort and the text; made once
    nodes = kept(nodes.select(*J.NODE_COLUMNS).filter("artifact_id IS NOT NULL"), "nodes")
    names = [s.name for s in sections]
    found = [F.bool_or(F.coalesce(F.col("section") == n, F.lit(False))).alias(n) for n in names]
    present = nodes.groupBy("artifact_id").agg(F.struct(*found).alias("_present"))
    rows = heads.join(present, "artifact_id", "left")
    marked = {
        s.name + suffix: F.when(F.col("_present")[s.name], F.array(F.lit(f"{mark}:{i};")))
        .when(F.col("_present").isNotNull(), F.array().cast("array<string>"))
        for i, s in enumerate(sections)
    }
    text = rows.withColumns(marked).select("artifact_id", document.alias("_text"))
    cut = text.select("artifact_id", F.posexplode(F.split("_text", mark + ":")).alias("_i", "_part"))
    number, rest = F.substring_index("_part", ";", 1), F.substr("_part", F.locate(";", F.col("_part")) + 1)
    between = cut.select(
        "artifact_id",
        F.when(F.col("_i") == 0, 0).otherwise(2 * number.try_cast("int") + 2).cast("int").alias("slot"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit("").alias("tie"),
        F.lit("").alias("separator"),
        F.when(F.col("_i") == 0, F.col("_part")).otherwise(rest).alias("text"),
    )
    place = F.array_position(F.array(*map(F.lit, names)), F.col("section")).cast("int")
    in_string = F.col("section").isin([s.name for s in sections if s.in_string])
    quoted = J.quoted(F.col("json"))
    inside = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    listed = nodes.filter(F.col("section").isin(names) & F.col("json").isNotNull()).select(
        "artifact_id",
        (2 * place - 1).alias("slot"),
        "ord",
        "tie",
        F.when(in_string, F.lit("\\n")).otherwise(F.lit(",")).alias("separator"),
        F.when(in_string, inside).otherwise(F.col("json")).alias("text"),
    )
    # the text of a head costs more than all its nodes, so it is made once, too
    return kept(between, "heads").unionByName(listed)


def _sink():
    """The data source ``document_chunks``, made in a function so that it travels by value."""
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    class Written(WriterCommitMessage):
        def __init__(self, partition, files, edges):
            self.partition, self.files, self.edges = partition, files, edges

    def where(uri):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    class Writer(DataSourceArrowWriter):
        def __init__(self, options):
            self.path, self.frame = options["path"].rstrip("/"), int(options["frame"])

        def write(self, iterator):
            import json
            import uuid

            import pyarrow as pa
            import pyarrow.compute as pc
            from pyspark import TaskContext

            system, base = where(self.path)
            partition = TaskContext.get().partitionId()
            name = f"part-{partition:06d}-{uuid.uuid4().hex}"
            codec, waiting, frames, size = pa.Codec("zstd"), bytearray(), [0], 0
            chunk, index, edges, begun, document, row = None, None, [], 0, None, None

            def compress(last=False):
                """Write the full frames of the text that waits; at last the rest."""
                full = len(waiting) if last else len(waiting) - len(waiting) % self.frame
                for at in range(0, full, self.frame):
                    chunk.write(packed := codec.compress(bytes(waiting[at : min(at + self.frame, full)]), asbytes=True))
                    frames.append(frames[-1] + len(packed))
                del waiting[:full]

            def piece(d):
                place = {"frame": frames[d["start"] // self.frame], "skip": d["start"] % self.frame} if d["bytes"] else {"frame": 0, "skip": 0}
                return {"file": name, **place, "start": d["start"], "bytes": d["bytes"], "before": ""}

            def shifted(column, first):
                return pa.concat_arrays([pa.array([first], column.type), column[:-1]])

            for batch in iterator:
                if not batch.num_rows:
                    continue
                artifact, slot, separator, text = batch.columns
                # an artifact goes on where the row before has the same, a list where that row has the same slot too
                was, slot_was = (shifted(artifact, row[0]), shifted(slot, row[1])) if row else (shifted(artifact, None), shifted(slot, None))
                same = pc.or_(pc.fill_null(pc.equal(artifact, was), False), pc.and_(artifact.is_null(), was.is_null()))
                if row is None:
                    same = pa.concat_arrays([pa.array([False]), same[1:]])
                    chunk = system.open_output_stream(f"{base}/chunks/{name}")
                listed = pc.and_(same, pc.fill_null(pc.equal(slot, slot_was), False))
                joined = pc.binary_join_element_wise(pc.if_else(listed, separator, ""), pc.fill_null(text, ""), "")
                ends = pc.cumulative_sum(pc.cast(pc.binary_length(joined), pa.int64()))
                starts = pc.indices_nonzero(pc.invert(same)).to_pylist()
                goes_on = starts[:1] != [0]
                at = pa.array([0] * goes_on + starts, pa.int64())
                until = pa.array(at[1:].to_pylist() + [batch.num_rows], pa.int64())
                lasts = pc.subtract(until, 1)
                data, byte = memoryview(joined.buffers()[2] or b""), 0
                complete = []
                for n, (a, first, mark, last, end) in enumerate(zip(*(c.to_pylist() for c in (artifact.take(at), slot.take(at), separator.take(at), slot.take(lasts), ends.take(lasts))))):
                    if n or not goes_on:
                        if document is not None:
                            (edges if begun == 1 else complete).append(document)  # the first may have begun in the task before
                        begun += 1
                        # without a head, unless that is in the task before: not a document
                        document = {"artifact_id": a, "first": first, "separator": mark, "start": size, "bytes": 0} if first == 0 or begun == 1 else None
                    if document is not None:
                        document["last"] = last
                        document["bytes"] += end - byte
                        size += end - byte
                        waiting += data[byte:end]
                    byte = end
                row = artifact[-1].as_py(), slot[-1].as_py()
                compress()
                if complete:
                    if index is None:
                        index = system.open_output_stream(f"{base}/index/{name}.json")
                    index.write("".join(json.dumps({"artifact_id": d["artifact_id"], "pieces": [piece(d)]}) + "\n" for d in complete).encode())
            if document is not None:
                edges.append(document)
            if chunk is not None:
                compress(last=True)
            for stream in (chunk, index):
                if stream is not None:
                    stream.close()
            return Written(partition, [name] if chunk is not None else [], [{**e, **piece(e)} for e in edges])

        def commit(self, messages):
            import json

            from pyarrow import fs

            system, base = where(self.path)
            done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
            lines, last = [], None
            for edge in (e for m in done for e in m.edges):
                piece = {k: edge[k] for k in ("file", "frame", "skip", "start", "bytes", "before")}
                if last is not None and last["artifact_id"] == edge["artifact_id"]:
                    piece["before"] = edge["separator"] if last["last"] == edge["first"] else ""
                    lines[-1]["pieces"].append(piece)
                elif edge["first"] != 0:
                    continue  # nodes without a head
                else:
                    lines.append({"artifact_id": edge["artifact_id"], "pieces": [piece]})
                last = edge
            kept = {f for m in done for f in m.files}
            for folder in ("chunks", "index"):  # attempts that lost
                for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}")):
                    if info.base_name.removesuffix(".json") not in kept:
                        system.delete_file(info.path)
            with system.open_output_stream(f"{base}/index/edges.json") as out:
                out.write("".join(json.dumps(line) + "\n" for line in lines).encode())

        def abort(self, messages):
            system, base = where(self.path)
            for folder in ("chunks", "index"):
                system.delete_dir_contents(f"{base}/{folder}", missing_dir_ok=True)

    class DocumentChunks(DataSource):
        @classmethod
        def name(cls):
            return "document_chunks"

        def schema(self):
            return "artifact_id string, slot int, separator string, text string"

        def writer(self, schema, overwrite):
            writer = Writer(self.options)
            system, base = where(writer.path)
            for folder in ("chunks", "index"):
                system.create_dir(f"{base}/{folder}", recursive=True)
            return writer

    return DocumentChunks


def _uri(path: str) -> str:
    """A URI that pyarrow and Spark both open."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[len("file:") :]
    return path if "://" in path else f"file://{path}"


def write(rows: DataFrame, path: str, frame: int = FRAME) -> None:
    """Write ``pieces`` below ``path``, a new folder that driver and executors share: ``chunks`` and ``index``."""
    spark = rows.sparkSession
    spark.dataSource.register(_sink())
    ordered = rows.orderBy("artifact_id", "slot", "ord", "tie").select("artifact_id", "slot", "separator", "text")
    with shuffles_end(spark):
        ordered.write.format("document_chunks").option("frame", frame).mode("append").save(_uri(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``artifact_id, pieces``: where the parts of each document lie, in order."""
    return spark.read.schema(INDEX).json(f"{_uri(path)}/index")


def _reader():
    """A class, made in a function so that it travels by value."""

    class Reader:
        """Texts of parts, from one open file as long as they follow each other in it."""

        def __init__(self, system, base):
            self.system, self.base, self.name, self.text, self.place = system, base, None, None, 0

        def begin(self, part):
            """Stand where ``part`` begins."""
            import pyarrow as pa

            if not part["bytes"]:
                return
            if part["file"] != self.name or not 0 <= part["start"] - self.place <= part["skip"]:
                self.close()
                handle = self.system.open_input_file(f"{self.base}/chunks/{part['file']}")
                handle.seek(part["frame"])
                self.name, self.text, self.place = part["file"], pa.CompressedInputStream(handle, "zstd"), part["start"] - part["skip"]
            self.read(part["start"] - self.place)

        def read(self, n):
            data = self.text.read(n) if n else b""
            self.place += len(data)
            return data

        def close(self):
            if self.text is not None:
                self.text.close()

    return Reader


def read_documents(spark: SparkSession, path: str, at_once: int = 1 << 20) -> DataFrame:
    """``artifact_id, document`` of documents that fit a row; rows leave a task together up to ``at_once`` bytes."""
    uri, opened = _uri(path), _reader()

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        reader = opened(*fs.FileSystem.from_uri(uri))

        def out(artifacts, texts):
            return pa.RecordBatch.from_arrays([pa.array(artifacts, pa.string()), pa.array(texts, pa.string())], ["artifact_id", "document"])

        for batch in batches:
            artifacts, texts, size = [], [], 0
            for artifact, parts in zip(*(c.to_pylist() for c in batch.columns)):
                text = []
                for part in parts:
                    reader.begin(part)
                    text += [part["before"].encode(), reader.read(part["bytes"])]
                text = b"".join(text)
                artifacts.append(artifact)
                texts.append(text.decode())
                size += len(text)
                if size > at_once:
                    yield out(artifacts, texts)
                    artifacts, texts, size = [], [], 0
            if artifacts:
                yield out(artifacts, texts)
        reader.close()

    return read_index(spark, path).mapInArrow(run, "artifact_id string, document string")


def copy_document(path: str, parts: list, target, at_once: int = 8 << 20) -> None:
    """Write one document, given its ``pieces``, to the open binary file ``target``, ``at_once`` bytes at a time."""
    from pyarrow import fs

    reader = _reader()(*fs.FileSystem.from_uri(_uri(path)))
    for part in parts:
        target.write(part["before"].encode())
        reader.begin(part)
        left = part["bytes"]
        while left and (data := reader.read(min(left, at_once))):
            target.write(data)
            left -= len(data)
    reader.close()
