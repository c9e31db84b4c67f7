"""Digests and findings of files that come as byte ranges (``sources.chunks``), as of the whole files.

One pass over the ranges leaves a row of small facts each: which patterns occur, where rules match, how many lines there
are, and the head of the file. Facts of a file are put together by one aggregate; contents take part in no shuffle but
for digests, which are one running hash, and for the few files whose reader needs their text in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions import values as V
from ..sources.files import header_findings
from . import detect, patterns
from .detect import EMPTY, emit, finding

FILE = ["artifact_id", "path"]
HEAD_BYTES = 4096
FACT_ROWS = 1024  # rows of facts that leave a task together
WHOLE_BYTES = 512 << 20  # a JSON document beyond this is reported, not parsed
FACTS = (
    "artifact_id string, path string, size bigint, offset bigint, length bigint, lines bigint, hits array<int>, opcodes array<int>, "
    "head binary, rules array<struct<rule: int, at: bigint, line: bigint>>, anchor bigint, modules array<struct<name: string, at: bigint>>"
)


def digests(ranges: DataFrame) -> DataFrame:
    """``artifact_id, path, size, sha256, sha384, sha512`` and ``complete``: whether the ranges make up the whole file.

    A digest is one running hash, so the ranges of a file pass one task in a stream of one Arrow batch at a time; files
    are dealt over tasks.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        names = ("sha256", "sha384", "sha512")
        key, hashes, size, have, whole = None, [], 0, 0, True

        def row():
            values = (*key, size, *(h.hexdigest() for h in hashes), whole and have == size)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [*FILE, "size", *names, "complete"])

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if own != key:
                    if key is not None:
                        yield row()
                    key, hashes, size, have, whole = own, [hashlib.new(n) for n in names], batch.column(2)[i].as_py(), 0, True
                offset, content = batch.column(3)[i].as_py(), batch.column(4)[i]
                data = content.as_buffer() if content.is_valid else b""
                if offset < have:  # a range that came twice
                    continue
                whole = whole and offset == have
                have += len(data)
                for h in hashes:
                    h.update(data)
        if key is not None:
            yield row()

    rows = ranges.select(*FILE, "size", "offset", "content").repartition(*FILE).sortWithinPartitions(*FILE, "offset")
    return rows.mapInArrow(run, "artifact_id string, path string, size bigint, sha256 string, sha384 string, sha512 string, complete boolean")


def facts(ranges: DataFrame) -> DataFrame:
    """One row of facts for each range. Places are those of the whole file; a match belongs to every range that holds it
    whole, so nothing is lost at an edge, and the least place of a file is that of the whole file."""
    build = patterns.searcher(patterns.PATTERNS)
    opcodes = sorted({*V.PICKLE_OPCODES.values(), V.PICKLE_STACK_GLOBAL})
    rules = [((V.WORD_START if bounded else "") + pattern, [patterns.NUMBER[n.encode()] for n in needles]) for _, _, _, pattern, bounded, needles in V.PYTHON_RULES]
    module, class_name = detect.KERAS_MODULE, patterns.CLASS_NAME
    array_head, head_bytes, hdf5 = V.MAX_NPY_HEADER + 16, HEAD_BYTES, V.HDF5_EXTS
    fact_rows = FACT_ROWS

    def run(batches):
        import re

        import pyarrow as pa

        search = build()
        tested = [(re.compile(p.encode(), re.ASCII), set(needles)) for p, needles in rules]
        modules_of = re.compile(module.encode(), re.ASCII)
        place = pa.struct([("rule", pa.int32()), ("at", pa.int64()), ("line", pa.int64())])
        named = pa.struct([("name", pa.string()), ("at", pa.int64())])
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(place), pa.int64(), pa.list_(named)]
        names = [*FILE, "size", "offset", "length", "lines", "hits", "opcodes", "head", "rules", "anchor", "modules"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows = []
            for i, (artifact, path, size, offset) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                before, content = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                before, content = before or b"", content or b""
                data, low = before + content, offset - len(before)
                ext = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
                found = search(data)
                at_rules, modules, anchor = [], {}, None
                if ext == ".py":
                    for rule, (pattern, needles) in enumerate(tested):
                        match = pattern.search(data) if needles.intersection(found) else None
                        if match:  # lines are counted from the range's start, below zero in what lies before it
                            at = match.start()
                            line = data.count(b"\n", len(before), at) if at >= len(before) else -data.count(b"\n", at, len(before))
                            at_rules.append({"rule": rule, "at": low + at, "line": line})
                if ext in hdf5 or path.endswith(".keras!config.json") or class_name in data:
                    start = data.find(class_name)
                    anchor = low + start if start >= 0 else None
                    for match in modules_of.finditer(data):
                        modules[match[1].decode()] = low + match.start()
                limit = array_head if ext == ".npy" else head_bytes
                head = content[: limit - offset] if offset < limit else None
                rows.append((artifact, path, size, offset, len(content), content.count(b"\n"), found, [c for c in opcodes if bytes([c]) in content], head, at_rules, anchor, [{"name": n, "at": a} for n, a in modules.items()]))
                if len(rows) == fact_rows:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return ranges.select(*FILE, "size", "offset", "before", "content").mapInArrow(run, FACTS)


def whole_facts(found: DataFrame) -> DataFrame:
    """The facts of each file: unions of patterns, first places of rules with their lines, modules after the anchor.

    Lists are as long as a file has ranges at most, or as there are patterns; names of modules are distinct by file.
    """
    places = F.flatten(F.collect_list(F.transform("rules", lambda r: F.struct(r["rule"].alias("rule"), r["at"].alias("at"), F.col("offset").alias("offset"), r["line"].alias("line")))))
    return found.groupBy(*FILE).agg(
        F.max("size").alias("size"),
        F.sum("length").alias("length"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("_hits"),
        F.array_distinct(F.flatten(F.collect_set("opcodes"))).alias("opcodes"),
        F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("offset", "head")))).alias("heads"),
        places.alias("rules"),
        F.min("anchor").alias("anchor"),
        F.flatten(F.collect_list("modules")).alias("named"),
        F.collect_list(F.struct("offset", "lines")).alias("counts"),
    )


def _first_match(rule: int) -> Column:
    of_rule = F.filter("rules", lambda r: r["rule"] == rule)
    return F.array_min(F.transform(of_rule, lambda r: F.struct(r["at"], r["offset"], r["line"])))


def _rule_line(rule: int) -> Column:
    """The line of a rule's first match in the whole file, NULL without one."""
    first = _first_match(rule)
    ahead = F.aggregate(F.filter("counts", lambda c: c["offset"] < first["offset"]), F.lit(0).cast("bigint"), lambda total, c: total + c["lines"])
    return ahead + first["line"] + 1


def _in_one_piece(ranges: DataFrame) -> DataFrame:
    """The given ranges of each file put together again: ``artifact_id, path, size, content``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "content"))), lambda r: r["content"])
    joined = ranges.groupBy(*FILE).agg(F.max("size").alias("size"), parts.alias("parts"))
    return joined.select(*FILE, "size", F.aggregate("parts", F.lit(b""), lambda all_, part: F.concat(all_, part)).alias("content"))


def inspect_ranges(ranges: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Findings of all content detectors over files given as byte ranges, as ``detect.inspect_contents`` and the header
    check give them of whole files.

    Ranges are as ``sources.chunks`` makes them: of equal length but for the last, each with the bytes before it. Where a
    text match or a module name with its blanks is longer than those bytes, it is not seen across an edge; patterns are
    far shorter. JSON documents and tensor headers are put together from their ranges, JSON up to ``whole_bytes``, beyond
    which a finding says that it was not examined. A file that lacks ranges has a finding as well.
    """
    path, ext, head = F.col("path"), S.extension(F.col("path")), F.col("head")
    first_bytes = F.aggregate("heads", F.lit(b""), lambda all_, part: F.concat(all_, part["head"]))
    files = whole_facts(facts(ranges)).withColumn("head", first_bytes).withColumns({f"_line{i}": _rule_line(i) for i in range(len(V.PYTHON_RULES))})
    declared = ext.isin(V.DECLARED_PICKLE_EXTS)
    pickle = detect._is_pickle_file(path, head)
    files = files.withColumns({
        "imports": F.when(pickle, patterns.imports_of(F.col("_hits"), F.array_contains("opcodes", V.PICKLE_STACK_GLOBAL))).otherwise(F.array().cast("array<string>")),
        "_member": F.endswith(path, F.lit(".keras!config.json")),
        "_named": ext.isin(V.HDF5_EXTS),
    })
    hdf5 = F.col("_member") | F.col("_named") | (detect._sniffed(path, head) & detect._begins(head, V.MAGIC_HDF5))
    anchor = F.when(F.col("_member"), F.lit(0)).otherwise(F.col("anchor"))
    modules = F.array_distinct(F.transform(F.filter("named", lambda m: m["at"] >= anchor), lambda m: m["name"]))
    misnamed = F.col("_named") & ~F.col("_member") & ~detect._begins(head, V.MAGIC_HDF5) & F.col("anchor").isNull()
    keras = F.when(hdf5 & anchor.isNotNull(), detect.keras_config_findings(F.col("_hits"), modules, path)).when(hdf5 & misnamed, F.array(detect.not_hdf5(path)))
    lines = [F.col(f"_line{i}") for i in range(len(V.PYTHON_RULES))]
    python = F.when(ext == ".py", detect.located_python_findings(lines, path, F.col("_hits")))
    shorter = finding("AR-IO-003", "File only partly read", "High", path, F.concat(F.col("length").cast("string"), F.lit(" of "), F.col("size").cast("string"), F.lit(" bytes")))
    opcodes = F.filter("opcodes", lambda c: c.isin(list(V.PICKLE_OPCODES.values())))
    files = detect.with_array_header(files.withColumn("content", head))
    parts = [
        detect.dangerous_imports(path),
        F.when(pickle, detect.pickle_fallback_of(head, F.col("size"), opcodes, path, declared)),
        detect.container_findings(path, head),
        python,
        keras,
        detect.graph_findings(path, F.col("_hits")),
        detect.magic_findings(path, head),
        detect.array_findings(path, head),
        detect.rows_where((F.col("length") < F.col("size"), shorter)),
    ]
    empty = F.array().cast(EMPTY)
    found = emit(files, F.concat(*[F.coalesce(part, empty) for part in parts]))

    json = ranges.filter(ext == ".json")
    documents = _in_one_piece(json.filter(F.col("size") <= whole_bytes))
    texts = documents.withColumn("_doc", detect._config_document(detect._config_text())).filter("_doc IS NOT NULL")
    flags = emit(texts, detect.config_flag_findings(F.col("_doc"), path))
    unread = finding("AR-IO-002", "Configuration not examined", "Low", path, F.concat(F.lit("larger than "), F.lit(whole_bytes).cast("string"), F.lit(" bytes")))
    large = emit(json.filter((F.col("size") > whole_bytes) & (F.col("offset") == 0)), F.array(unread))

    tensors = ranges.filter(ext == ".safetensors")
    ends = tensors.filter("offset = 0").select(*FILE, (detect.little_endian(F.col("content"), 1, 8) + 8).alias("_end"))
    near = tensors.join(ends, FILE).filter((F.col("offset") == 0) | ((F.col("offset") < F.col("_end")) & (F.col("_end") <= V.MAX_SAFETENSORS_HEADER + 8)))
    headers = header_findings(_in_one_piece(near))
    return found.unionByName(flags).unionByName(detect.detect_instantiation(documents)).unionByName(large).unionByName(headers)
