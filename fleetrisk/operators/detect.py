"""Detectors: file contents and listings to findings.

A detector is an array expression over the columns ``path`` and ``content`` of one file, so any number
of them run in one scan of the contents and need no shuffle. Whole contents are examined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import text as S
from ..functions import values as V
from ..functions.lookups import any_of, rows_where
from ..session import tolerate_repeated_keys
from ..sources.json_events import puller
from . import patterns

FINDING = "struct<id:string,title:string,severity:string,category:string,location:string,description:string>"
EMPTY = f"array<{FINDING}>"


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(rule, title, severity, location, description, category="model") -> Column:
    return F.struct(
        _text(rule).alias("id"),
        _text(title).alias("title"),
        _text(severity).alias("severity"),
        _text(category).alias("category"),
        F.coalesce(_text(location), F.lit("")).alias("location"),
        _text(description).alias("description"),
    )


def _has(content: Column, needle: bytes) -> Column:
    return F.contains(content, F.lit(bytearray(needle)))


def _begins(content: Column, magic: bytes) -> Column:
    return F.startswith(content, F.lit(bytearray(magic)))


def _byte(content: Column, position: int) -> Column:
    """Byte at a 1-based position as a number, NULL past the end."""
    return F.conv(F.hex(F.substring(content, position, 1)), 16, 10).try_cast("int")


def little_endian(content: Column, position: int, width: int) -> Column:
    """Unsigned little-endian number as decimal(20,0); NULL when the content is too short."""
    raw = F.substring(content, position, width)
    digits = F.hex(raw)
    swapped = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(width, 0, -1)])
    return F.when(F.length(raw) == width, F.conv(swapped, 16, 10).cast("decimal(20,0)"))


def emit(files: DataFrame, findings: Column) -> DataFrame:
    """Long form of an array of findings per file."""
    return files.select("artifact_id", F.explode(findings).alias("f")).select("artifact_id", "f.*")


# --- pickles ------------------------------------------------------------------------------------------
def with_imports(files: DataFrame, column: str = "content", found: str = "_hits") -> DataFrame:
    """Adds ``imports``: the dangerous callables a stream names, in either encoding. ``found``: its pattern numbers."""
    combines = F.coalesce(_has(F.col(column), bytes([V.PICKLE_STACK_GLOBAL])), F.lit(False))
    return files.withColumn("imports", patterns.imports_of(F.col(found), combines))


def is_pickle_magic(content: Column) -> Column:
    return F.coalesce((_byte(content, 1) == 0x80) & (_byte(content, 2) <= 5), F.lit(False))


def dangerous_imports(location: Column) -> Column:
    return F.transform(
        "imports",
        lambda name: finding(
            "AR-PICKLE-001",
            "Serialized stream imports a dangerous callable",
            "Critical",
            location,
            F.concat(F.lit("runs on load: "), name),
        ),
    )


def pickle_fallback_of(content: Column, length: Column, opcodes: Column, location: Column, declared: Column) -> Column:
    """Low for a pickle with some of the usual ``opcodes`` (numbers), Medium for one without, when nothing dangerous was
    named. Of ``content`` only the first bytes count."""
    names = F.array_compact(F.array(*[F.when(F.array_contains(opcodes, code), F.lit(name)) for name, code in V.PICKLE_OPCODES.items()]))
    plain = (length > 0) & (is_pickle_magic(content) | declared) & (F.size("imports") == 0)
    usual = finding(
        "AR-PICKLE-003",
        "Pickle-based weights can run code on load",
        "Low",
        location,
        F.concat(F.lit("opcodes: "), F.array_join(names, ", ")),
    )
    bare = finding(
        "AR-PICKLE-004", "Unsafe serialization format", "Medium", location, "pickle-based weights can run code on load"
    )
    return F.when(plain, F.array(F.when(F.size(names) > 0, usual).otherwise(bare))).otherwise(F.array().cast(EMPTY))


def pickle_fallback(content: Column, location: Column, declared: Column) -> Column:
    opcodes = F.array_compact(F.array(*[F.when(_has(content, bytes([c])), F.lit(c)) for c in V.PICKLE_OPCODES.values()]))
    return pickle_fallback_of(content, F.length(content), opcodes, location, declared)


def _sniffed(path: Column, content: Column) -> Column:
    """No reader of its own: an unknown extension, or an ``.npy`` that is not an array."""
    ext = S.extension(path)
    not_array = (ext == ".npy") & ~_begins(content, V.MAGIC_NUMPY) & (F.length(content) >= 8)
    return (~ext.isin(V.KNOWN_EXTS) | not_array) & (F.length(content) >= 4)


def _is_pickle_file(path: Column, content: Column) -> Column:
    """Named a pickle or a torch file and not a zip container, or an unknown file with the magic bytes."""
    ext = S.extension(path)
    named = ext.isin(V.DECLARED_PICKLE_EXTS) | ext.isin(V.TORCH_EXTS)
    return (named & ~_begins(content, V.MAGIC_ZIP)) | (_sniffed(path, content) & is_pickle_magic(content))


def _pickle_candidates(files: DataFrame) -> DataFrame:
    """Files the pickle rules apply to, with ``declared`` (named a pickle) and the imports they name."""
    rows = files.filter(_is_pickle_file(F.col("path"), F.col("content"))).withColumn("_hits", patterns.hits(F.col("content")))
    return with_imports(rows.withColumn("declared", S.extension(F.col("path")).isin(V.DECLARED_PICKLE_EXTS)))


def detect_dangerous_import(files: DataFrame) -> DataFrame:
    return emit(_pickle_candidates(files), dangerous_imports(F.col("path")))


def container_findings(path: Column, content: Column) -> Column:
    ext = S.extension(path)
    container = (ext.isin(V.TORCH_EXTS) | ext.isin(V.DECLARED_PICKLE_EXTS)) & _begins(content, V.MAGIC_ZIP)
    note = finding("AR-PICKLE-002", "Torch zip container", "Medium", path, "loading it unpickles its members by default")
    return rows_where((container, note))


def detect_pickle_fallback(files: DataFrame) -> DataFrame:
    """Pickles without a dangerous import, and torch containers."""
    path, content = F.col("path"), F.col("content")
    fallback = emit(_pickle_candidates(files), pickle_fallback(content, path, F.col("declared")))
    return fallback.unionByName(emit(files, container_findings(path, content)))


# --- source text -----------------------------------------------------------------------------------------
def line_of(text: Column, position: Column) -> Column:
    before = F.substr(text, F.lit(1), position - 1)
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def with_rule_positions(rows: DataFrame, text: str, found: str = "_hits") -> DataFrame:
    """Adds the position of the first match of each rule, 0 for none.

    The texts that every match contains are among the patterns of ``found``, which rules most texts out.
    """
    positions = {}
    for i, (_, _, _, pattern, bounded, needles) in enumerate(V.PYTHON_RULES):
        expression = F.lit((V.WORD_START if bounded else "") + pattern)
        likely = F.col(text).isNotNull() & patterns.occurs(F.col(found), *(n.encode() for n in needles))
        positions[f"_at{i}"] = F.when(likely, F.regexp_instr(text, expression)).otherwise(0)
    return rows.withColumns(positions)


def located_python_findings(lines: list[Column], path: Column, found: Column) -> Column:
    """A finding for each rule that has a line, and custom native extensions by pattern number."""
    cases = []
    for line, (rule, title, severity, *_) in zip(lines, V.PYTHON_RULES):
        cases.append((line.isNotNull(), finding(rule, title, severity, F.concat(path, F.lit(":"), line.cast("string")), title)))
    native = finding("AR-PY-006", "Custom native extension", "High", path, "compiles native code when imported")
    cases.append((patterns.occurs(found, *(m.encode() for m in V.NATIVE_EXTENSION_MARKERS)), native))
    return rows_where(*cases)


def python_findings(text: Column, path: Column, found: Column) -> Column:
    """First match of each rule, located by line, and custom native extensions."""
    places = [F.col(f"_at{i}") for i in range(len(V.PYTHON_RULES))]
    lines = [F.when(at > 0, line_of(text, at)) for at in places]
    return F.when(text.isNotNull(), located_python_findings(lines, path, found))


def detect_python_rules(files: DataFrame) -> DataFrame:
    source = F.col("content")
    rows = files.filter(S.extension(F.col("path")) == ".py").withColumns({"_text": S.utf8_text(source), "_hits": patterns.hits(source)})
    return emit(with_rule_positions(rows, "_text"), python_findings(F.col("_text"), F.col("path"), F.col("_hits")))


# --- JSON configuration --------------------------------------------------------------------------------------
def _config_text() -> Column:
    """Text of a JSON file, else NULL."""
    return F.when(S.extension(F.col("path")) == ".json", S.utf8_text(F.col("content")))


def _config_document(text: Column) -> Column:
    """The document as a variant when it is a JSON object, else NULL."""
    document = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(document), F.lit("OBJECT")), document)


def config_flag_findings(document: Column, path: Column) -> Column:
    flag = F.try_variant_get(document, "$.trust_remote_code", "variant")
    enabled = (F.schema_of_variant(flag) == "BOOLEAN") & F.try_variant_get(document, "$.trust_remote_code", "boolean")
    mapped = F.array_contains(F.map_keys(document.cast("map<string,variant>")), "auto_map")
    return rows_where(
        (enabled, finding("AR-HF-001", "trust_remote_code is enabled", "Critical", path, "loading runs shipped code")),
        (mapped, finding("AR-HF-002", "auto_map names custom classes", "High", path, "loading imports shipped code")),
    )


def detect_config_flags(files: DataFrame) -> DataFrame:
    """Settings that hand execution to code shipped with the weights, in JSON files of any size."""
    tolerate_repeated_keys(files.sparkSession)
    rows = files.withColumn("_doc", _config_document(_config_text())).filter("_doc IS NOT NULL")
    return emit(rows, config_flag_findings(F.col("_doc"), F.col("path")))


HITS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("where", "key", "target")]))


def _named_callables(keys: list[str]):
    """Small helper over one Arrow batch: keys of each JSON text that name a callable, at any depth.

    Measured against unrolled levels of VARIANT explodes this is an order of magnitude faster, and it has no
    level at which it must stop: what nests too deep for the library's parser goes through the pull parser. It is a
    closure, so executors need not have this package.
    """
    make = puller()

    def deep(text):
        events, _ = make
        found, names, open_ = [], [], []  # open_: kind of each open container, and its current key or position
        for kind, value in events([text]):
            if kind == "key":
                open_[-1][1] = value
                continue
            if kind in "{[":
                if not open_ and kind == "[":
                    return []
                if open_:
                    names.append(str(open_[-1][1]))
                open_.append([kind, 0])
                continue
            if kind in "}]":
                open_.pop()
                if not open_:
                    return found
                names.pop()
            elif not open_:
                return []
            elif open_[-1][0] == "{" and open_[-1][1] in keys and isinstance(value, str) and value:
                found.append({"where": ".".join(names), "key": open_[-1][1], "target": value})
            if open_[-1][0] == "[":
                open_[-1][1] += 1
        return found

    def hits(text):
        import json

        try:
            document = json.loads(text)
        except RecursionError:
            try:
                return deep(text)
            except ValueError:
                return []
        except ValueError:
            return []
        found, stack = [], [("", document)] if isinstance(document, dict) else []
        while stack:
            where, node = stack.pop()
            children = enumerate(node)
            if isinstance(node, dict):
                for key in keys:
                    if isinstance(node.get(key), str) and node[key]:
                        found.append({"where": where, "key": key, "target": node[key]})
                children = node.items()
            stack.extend(
                (f"{where}.{k}" if where else str(k), child) for k, child in children if isinstance(child, (dict, list))
            )
        return found

    def walk(texts):
        import pandas as pd

        return pd.Series([hits(text) for text in texts])

    return walk


def instantiation_targets(configs: DataFrame) -> DataFrame:
    """Every key that names a callable to import. Input ``(artifact_id, path, text)``.

    Only texts that can hold such a key reach Python: it must occur literally unless the text escapes
    characters with a backslash.
    """
    walk = F.pandas_udf(_named_callables(V.INSTANTIATION_KEYS), HITS)
    possible = S.has_any(F.col("text"), V.INSTANTIATION_KEYS) | F.contains("text", F.lit("\\"))
    rows = configs.filter(possible).select("artifact_id", "path", walk("text").alias("hits"))
    return rows.select("artifact_id", "path", F.explode("hits").alias("h")).select("artifact_id", "path", "h.*")


def target_severity(target: Column) -> Column:
    lower = F.lower(target)
    dangerous = any_of(
        F.startswith(lower, F.lit(d)) | F.contains(lower, F.lit("." + d)) for d in V.DANGEROUS_TARGETS
    )
    return F.when(dangerous, "Critical").otherwise("Low")


def detect_instantiation(files: DataFrame) -> DataFrame:
    """Callables that JSON files of any size name."""
    configs = files.filter(S.extension(F.col("path")) == ".json")
    hits = instantiation_targets(configs.select("artifact_id", "path", S.utf8_text(F.col("content")).alias("text")))
    where = F.when(F.col("where") == "", F.col("path")).otherwise(F.concat("path", F.lit(" at "), "where"))
    named = finding(
        "AR-CONFIG-001",
        "Configuration names a callable to import on load",
        target_severity(F.col("target")),
        where,
        F.concat("key", F.lit(" names "), "target"),
    )
    return hits.select("artifact_id", named.alias("f")).select("artifact_id", "f.*")


# --- Keras, graphs, arrays, magic bytes ----------------------------------------------------------------------
KERAS_MODULE = r'"module"\s*:\s*"([A-Za-z_][A-Za-z0-9_.]*)"'


def keras_modules(text: Column) -> Column:
    """Distinct modules that a configuration names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(KERAS_MODULE), F.lit(1)))


def keras_config_findings(found: Column, modules: Column, location: Column) -> Column:
    """Load-time execution paths in a serialized Keras configuration, from its pattern numbers and modules."""

    def layer(name: str) -> Column:
        return patterns.occurs(found, *patterns.layer_forms(name))

    home = lambda m: any_of((m == h) | F.startswith(m, F.lit(h + ".")) for h in V.KERAS_HOME_MODULES)
    foreign = F.filter(F.coalesce(modules, F.array().cast("array<string>")), lambda m: ~home(m))
    layers = rows_where(
        (
            layer("Lambda"),
            finding("AR-KERAS-001", "Lambda layer runs serialized code", "Critical", location, "runs on load"),
        ),
        (
            layer("TFSMLayer"),
            finding("AR-KERAS-002", "Layer loads an external model", "Critical", location, "loads a path it names"),
        ),
    )
    imports = F.transform(
        foreign,
        lambda m: finding(
            "AR-KERAS-003", "Configuration imports a foreign module", "High", location, F.concat(F.lit("module "), m)
        ),
    )
    return F.concat(layers, imports)


def with_keras_columns(files: DataFrame) -> DataFrame:
    """Adds the text of HDF5 files and Keras archive members, and where a configuration starts in it."""
    path, content = F.col("path"), F.col("content")
    member = F.endswith(path, F.lit(".keras!config.json"))
    named = S.extension(path).isin(V.HDF5_EXTS)
    hdf5 = named | (_sniffed(path, content) & _begins(content, V.MAGIC_HDF5))
    rows = files.withColumns(
        {
            "_keras": F.when(member | hdf5, F.decode(content, "ISO-8859-1")),
            "_misnamed": named & ~member & ~_begins(content, V.MAGIC_HDF5),
            "_member": member,
        }
    )
    rows = rows.withColumn("_start", F.locate('"class_name"', F.col("_keras")))
    anchored = F.when(F.col("_member"), F.col("_keras")).when(F.col("_start") > 0, F.substr("_keras", F.col("_start")))
    return rows.withColumn("_anchored", anchored)


def not_hdf5(path: Column) -> Column:
    return finding("AR-KERAS-004", "File named as a Keras model is not HDF5", "Medium", path, "the header is not HDF5")


def keras_findings(path: Column, hits: Column) -> Column:
    """Over the columns of ``with_keras_columns``."""
    renamed = F.col("_misnamed") & (F.col("_start") == 0)
    anchored = F.col("_anchored")
    found = F.when(anchored.isNotNull(), keras_config_findings(hits, keras_modules(anchored), path))
    return F.coalesce(found, rows_where((renamed, not_hdf5(path))))


def detect_keras_config(files: DataFrame) -> DataFrame:
    """HDF5 files and the ``config.json`` member of Keras archives (path ``model.keras!config.json``)."""
    rows = with_keras_columns(files).filter("_keras IS NOT NULL").withColumn("_hits", patterns.hits(F.col("content")))
    return emit(rows, keras_findings(F.col("path"), F.col("_hits")))


def graph_findings(path: Column, found: Column) -> Column:
    """Operation names by substring and climbing references, from the pattern numbers of a graph file."""
    ext = S.extension(path)
    has = lambda *names: patterns.occurs(found, *(n if isinstance(n, bytes) else n.encode() for n in names))
    saved = [
        (has(op), finding("AR-TF-001", "Graph operation reaches outside the graph", severity, path, f"operation {op}"))
        for op, severity in V.SAVED_MODEL_OPS.items()
    ]
    onnx = [
        (has(op), finding("AR-ONNX-001", "Suspicious graph operator", "High", path, f"operator {op}")) for op in V.ONNX_OPS
    ]
    climbs = has(*patterns.CLIMBING["location"]) & has(*patterns.CLIMBING["up"])
    escape = finding("AR-ONNX-002", "External data leaves the directory", "Critical", path, "a reference contains ../")
    of = {".pb": rows_where(*saved), ".onnx": rows_where(*onnx, (climbs, escape))}
    anything = F.size(found) > 0  # most files hold none of the patterns
    return F.when(anything & (ext == ".pb"), of[".pb"]).when(anything & (ext == ".onnx"), of[".onnx"]).otherwise(F.array().cast(EMPTY))


def detect_graph_ops(files: DataFrame) -> DataFrame:
    """Operation names a graph should not need, by substring; ONNX external data that climbs out."""
    rows = files.filter(S.extension(F.col("path")).isin(".pb", ".onnx")).withColumn("_hits", patterns.hits(F.col("content")))
    return emit(rows, graph_findings(F.col("path"), F.col("_hits")))


def magic_findings(path: Column, content: Column) -> Column:
    """Pickles and HDF5 are left to their own detectors."""
    first_line = F.btrim(F.substring_index(F.decode(content, "ISO-8859-1"), "\n", 1), F.lit(S.WHITESPACE))

    def native(number: int, name: str) -> Column:
        return finding(f"AR-BIN-{number:03d}", f"{name} executable in a model artifact", "High", path, "native executable")

    kind = (
        F.when(_begins(content, V.MAGIC_ELF), native(1, "ELF"))
        .when(_begins(content, V.MAGIC_PE), native(2, "PE"))
        .when(any_of(_begins(content, m) for m in V.MAGIC_MACHO), native(3, "Mach-O"))
        .when(is_pickle_magic(content) | _begins(content, V.MAGIC_HDF5), F.lit(None).cast(FINDING))
        .when(
            _begins(content, V.MAGIC_SHEBANG),
            finding("AR-SHELL-002", "Script with an interpreter line", "Medium", path, first_line),
        )
    )
    return F.array_compact(F.array(F.when(_sniffed(path, content), kind)))


def detect_magic(files: DataFrame) -> DataFrame:
    """Payloads behind an extension without a reader of its own."""
    return emit(files, magic_findings(F.col("path"), F.col("content")))


def with_array_header(files: DataFrame) -> DataFrame:
    """Adds the declared header length of array files and where the header starts."""
    content = F.col("content")
    array = (S.extension(F.col("path")) == ".npy") & _begins(content, V.MAGIC_NUMPY) & (F.length(content) >= 8)
    wide = _byte(content, 7) >= 2
    length = F.when(wide, little_endian(content, 9, 4)).otherwise(little_endian(content, 9, 2))
    return files.withColumns({"_length": F.when(array, length), "_offset": F.when(wide, 13).otherwise(11)})


def array_findings(path: Column, content: Column) -> Column:
    """Over the columns of ``with_array_header``."""
    implausible = (F.col("_length") <= 0) | (F.col("_length") > V.MAX_NPY_HEADER)
    header = F.when(
        ~implausible & (F.length(content) >= F.col("_offset") - 1 + F.col("_length")),
        F.substr(content, F.col("_offset"), F.col("_length").cast("int")),
    )
    objects = _has(header, b"'|O'") | _has(header, b"'O'")
    return rows_where(
        (implausible, finding("AR-NPY-002", "Implausible array header length", "Medium", path, "header length")),
        (objects, finding("AR-NPY-001", "Object array", "High", path, "its elements are pickles")),
    )


def detect_npy(files: DataFrame) -> DataFrame:
    """Array headers: an implausible length, or object elements, which are pickles."""
    rows = with_array_header(files).filter("_length IS NOT NULL")
    return emit(rows, array_findings(F.col("path"), F.col("content")))


# --- listings ---------------------------------------------------------------------------------------------------
def detect_file_meta(listing: DataFrame, root: str = "/artifact") -> DataFrame:
    """Native libraries, shell scripts, executable bits and escaping links of a file listing."""
    path, ext = F.col("path"), S.extension(F.col("path"))
    is_link = F.col("link_target").isNotNull()
    escapes = P.link_escape(F.lit(root), path, F.col("link_target"))
    cases = rows_where(
        (
            is_link & escapes,
            finding("AR-LINK-001", "Link leaves the model directory", "High", path, F.col("link_target")),
        ),
        (
            ~is_link & F.coalesce("is_exec", F.lit(False)),
            finding("AR-EXEC-001", "Executable file in a model artifact", "Medium", path, "execute permission is set"),
        ),
        (
            ~is_link & ext.isin(V.NATIVE_LIBRARY_EXTS),
            finding("AR-NATIVE-001", "Native library in a model artifact", "High", path, "runs native code on load"),
        ),
        (
            ~is_link & ext.isin(V.SHELL_EXTS),
            finding("AR-SHELL-001", "Shell script in a model artifact", "Medium", path, "may run on load or serving"),
        ),
    )
    return emit(listing, cases)


def detect_unreadable(failures: DataFrame) -> DataFrame:
    """Files that could not be read: worse when their format runs code on load. Input (path, error)."""
    path = F.col("path")
    runs = S.executes_on_load(path, "inspect")
    return emit(
        failures,
        F.array(
            finding(
                "AR-IO-001",
                F.when(runs, "Unreadable file in an executable format").otherwise("Unreadable file"),
                F.when(runs, "High").otherwise("Low"),
                path,
                F.col("error"),
            )
        ),
    )


def detect_truncated(listing: DataFrame, max_files: int) -> DataFrame:
    """One finding per artifact whose listing is longer than a walk that the caller stopped at ``max_files``."""
    large = listing.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_files)
    detail = F.concat(F.lit(f"examined {max_files} of "), F.col("n"))
    return emit(large, F.array(finding("AR-COVERAGE-001", "Artifact only partly examined", "High", "", detail)))


WIDE = "decimal(38,0)"
SLICE_MEMBERS = 1024  # members of an archive whose sizes are summed in one row


def _walked_sizes(entries: DataFrame, keys: list[str], max_entries: int, max_bytes: int) -> DataFrame:
    """Per archive: compressed and expanded bytes of the members before the walk stops, and whether it stopped for size.

    Two levels of sums: members meet in slices of ``SLICE_MEMBERS``, each with its total and its highest running total;
    only slices are put in order over an archive. The slice in which the walk stops is the first whose highest total,
    on top of what came before, passes the limit, and its own list tells the member. Sizes can be near the ends of int64
    and below zero, so they are summed as decimals and the running total need not rise.
    """
    wide = lambda c: F.coalesce(F.col(c).cast(WIDE), F.lit(0).cast(WIDE))
    slices = (
        entries.filter((F.col("ord") <= max_entries) & F.col("_counted"))
        .groupBy(*keys, F.floor((F.col("ord") - 1) / SLICE_MEMBERS).alias("slice"))
        .agg(F.sort_array(F.collect_list(F.struct("ord", wide("size").alias("out"), wide("compressed").alias("in")))).alias("members"))
    )
    state = f"struct<total:{WIDE},peak:{WIDE},packed:{WIDE},stopped:boolean>"
    nothing = F.lit(0).cast(WIDE)

    def fold(start: Column, stop: bool) -> Column:
        """Totals over the members of a slice; with ``stop``, up to the member that passes the limit."""
        first = F.struct(start.cast(WIDE).alias("total"), F.lit(None).cast(WIDE).alias("peak"), nothing.alias("packed"), F.lit(False).alias("stopped"))

        def step(acc: Column, m: Column) -> Column:
            total = (acc["total"] + m["out"]).cast(WIDE)
            after = F.struct(
                total.alias("total"), F.greatest(acc["peak"], total).alias("peak"), (acc["packed"] + m["in"]).cast(WIDE).alias("packed"),
                (total > max_bytes if stop else F.lit(False)).alias("stopped"),
            )
            return F.when(acc["stopped"], acc).otherwise(after).cast(state)

        return F.aggregate("members", first.cast(state), step)

    order = Window.partitionBy(*keys).orderBy("slice")
    summed = slices.withColumn("s", fold(nothing, False))
    before = F.coalesce(F.sum("s.total").over(order.rowsBetween(Window.unboundedPreceding, -1)), nothing).cast(WIDE)
    placed = summed.withColumn("before", before).withColumn("over", F.col("before") + F.col("s.peak") > max_bytes)
    earlier = F.coalesce(F.max("over").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    reached = placed.withColumn("earlier", earlier).filter(~F.col("earlier"))
    last = fold(F.col("before"), True)
    part = reached.withColumn("e", F.when(F.col("over"), last))
    return part.groupBy(*keys).agg(
        F.bool_or("over").alias("_stopped"),
        F.sum(F.coalesce(F.col("e.packed"), F.col("s.packed"))).cast("double").alias("_in"),
        F.sum(F.when(F.col("over"), F.col("e.total") - F.col("before")).otherwise(F.col("s.total"))).cast("double").alias("_out"),
    )


def detect_archive(
    entries: DataFrame,
    max_entries: int = V.MAX_ARCHIVE_ENTRIES,
    max_bytes: int = V.MAX_ARCHIVE_BYTES,
    max_ratio: float = V.MAX_COMPRESSION_RATIO,
) -> DataFrame:
    """Archive members: traversal, links, entry and size limits, and expansion ratio.

    ``ord`` is the 1-based position in the archive. Names and links of all members are judged, also of those that a walk
    with these limits would not reach; the limits decide what is summed, and each has its own finding.
    """
    keys = ["artifact_id", "archive"]
    link = F.coalesce("is_link", F.lit(False))
    rows = entries.withColumn("_escapes", P.archive_traversal(F.col("name"))).withColumn("_counted", ~F.col("_escapes") & ~link)
    inside = F.concat("archive", F.lit("!"), "name")
    members = emit(
        rows,
        rows_where(
            (
                F.col("_escapes"),
                finding("AR-ARCHIVE-003", "Archive member leaves the directory", "Critical", inside, F.col("name")),
            ),
            (
                ~F.col("_escapes") & link,
                finding("AR-ARCHIVE-004", "Link inside an archive", "High", inside, F.col("name")),
            ),
        ),
    )
    about = entries.groupBy(*keys).agg((F.max("ord") > max_entries).alias("_over"), F.max(F.col("kind") == "zip").alias("_zip"))
    stopped = F.coalesce("_stopped", F.lit(False))
    ratio = F.when((F.col("_in") > 0) & F.col("_zip"), F.col("_out") / F.col("_in"))
    archive = F.col("archive")
    whole = emit(
        about.join(_walked_sizes(rows, keys, max_entries, max_bytes), keys, "left"),
        rows_where(
            (
                F.col("_over") & ~stopped,
                finding("AR-ARCHIVE-002", "Archive has too many members", "High", archive, f"more than {max_entries}"),
            ),
            (
                stopped,
                finding("AR-ARCHIVE-005", "Archive expands too far", "High", archive, f"more than {max_bytes} bytes"),
            ),
            (
                ratio > max_ratio,
                finding("AR-ARCHIVE-006", "Suspicious expansion ratio", "High", archive, "possible archive bomb"),
            ),
        ),
    )
    return members.unionByName(whole)


# --- metadata ---------------------------------------------------------------------------------------------------
def active_template(template: Column) -> Column:
    hidden = S.has_any(template, [".__", "namespace(", "cycler"])
    return F.contains(template, F.lit("{%")) | (F.contains(template, F.lit("{{")) & hidden)


def suspicious_alignment(value: Column) -> Column:
    """Zero, above 2^20, or not a power of two. Values beyond int64 are above the limit anyway."""
    number = F.when(value.rlike(r"^[0-9]+$"), value.try_cast("decimal(38,0)"))
    in_uint64 = number <= F.lit("18446744073709551615").cast("decimal(38,0)")
    small = F.when(number <= V.MAX_ALIGNMENT, number.try_cast("bigint"))
    return F.coalesce(
        in_uint64 & ((number == 0) | (number > V.MAX_ALIGNMENT) | ~S.is_power_of_two(small)), F.lit(False)
    )


def detect_metadata(
    artifacts: DataFrame, raw_kv: DataFrame, licenses: DataFrame, domains: DataFrame | None = None
) -> DataFrame:
    """Findings from metadata alone. ``artifacts(artifact_id, format, primary_path)``."""
    keys = ["tokenizer.chat_template", "general.alignment", "onnx.external_data.traversal"]
    wanted = raw_kv.filter(F.col("key").isin(keys))
    wide = wanted.groupBy("artifact_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_k{i}") for i, k in enumerate(keys)]
    )
    resolved = licenses.filter(F.coalesce("spdx_id", F.lit("")) != "").select("artifact_id", F.lit(True).alias("_licensed"))
    rows = artifacts.join(wide, "artifact_id", "left").join(resolved.distinct(), "artifact_id", "left")
    if domains is None:
        rows = rows.withColumn("_domains", F.lit(0))
    else:
        counted = domains.groupBy("artifact_id").agg(F.count_distinct("domain").alias("_domains"))
        rows = rows.join(counted, "artifact_id", "left")
    fmt, where = F.col("format"), F.col("primary_path")
    cases = rows_where(
        (
            (fmt == "gguf") & active_template(F.col("_k0")),
            finding("AR-GGUF-010", "Chat template contains control logic", "High", where, "rendered on load"),
        ),
        (
            (fmt == "gguf") & suspicious_alignment(F.col("_k1")),
            finding("AR-GGUF-011", "Suspicious tensor alignment", "Medium", where, F.col("_k1")),
        ),
        (
            (fmt == "onnx") & (F.coalesce("_domains", F.lit(0)) > 0),
            finding("AR-ONNX-010", "Custom operator domain", "High", where, "needs native kernels of its own"),
        ),
        (
            (fmt == "onnx") & (F.col("_k2") == "true"),
            finding("AR-ONNX-011", "External data leaves the directory", "Critical", where, "path traversal"),
        ),
        (
            F.col("_licensed").isNull(),
            finding("AR-LIC-001", "No license disclosed", "Low", where, "no usable license", "license"),
        ),
    )
    return emit(rows, cases)


def detect_component(references: DataFrame, files: DataFrame, max_files: int | None = None) -> DataFrame:
    """References of a model that are missing, escape its directory, or exceed the limit the caller set."""
    escapes = P.path_traversal(F.col("path"))
    leaving = finding("AR-FILE-003", "Referenced file leaves the directory", "Critical", F.col("path"), F.col("role"))
    missing = finding("AR-FILE-001", "Referenced file is missing", "Medium", F.col("path"), F.col("role"))
    inside = references.filter(~escapes)
    present = files.select("artifact_id", "path").distinct()
    found = emit(references.filter(escapes), F.array(leaving)).unionByName(
        emit(inside.join(present, ["artifact_id", "path"], "left_anti"), F.array(missing))
    )
    if max_files is None:
        return found
    large = (
        inside.join(present, ["artifact_id", "path"], "left_semi")
        .groupBy("artifact_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > max_files)
    )
    incomplete = finding("AR-FILE-002", "Component set is incomplete", "Medium", "", f"more than {max_files} files")
    return found.unionByName(emit(large, F.array(incomplete)))


def inspect_contents(files: DataFrame) -> DataFrame:
    """All content detectors over a file table.

    One scan serves every array-valued detector: a column of a detector is NULL where it does not apply,
    which makes its findings empty. Only JSON files are read a second time, for the JSON walk.
    """
    tolerate_repeated_keys(files.sparkSession)
    path, content = F.col("path"), F.col("content")
    rows = files.select("artifact_id", "path", "content").withColumns(
        {
            "declared": S.extension(path).isin(V.DECLARED_PICKLE_EXTS),
            "_pickle": F.when(_is_pickle_file(path, content), content),
            "_text": F.when(S.extension(path) == ".py", S.utf8_text(content)),
            "_doc": _config_document(_config_text()),
        }
    )
    keras = with_keras_columns(rows)
    searched = F.col("_pickle").isNotNull() | F.col("_text").isNotNull() | F.col("_keras").isNotNull() | S.extension(path).isin(".pb", ".onnx")
    rows = keras.withColumn("_hits", patterns.hits(F.when(searched, content)))
    rows = with_array_header(with_rule_positions(with_imports(rows, "_pickle"), "_text"))
    parts = [
        dangerous_imports(path),
        pickle_fallback(F.col("_pickle"), path, F.col("declared")),
        container_findings(path, content),
        python_findings(F.col("_text"), path, F.col("_hits")),
        config_flag_findings(F.col("_doc"), path),
        keras_findings(path, F.col("_hits")),
        graph_findings(path, F.col("_hits")),
        magic_findings(path, content),
        array_findings(path, content),
    ]
    empty = F.array().cast(EMPTY)
    found = emit(rows, F.concat(*[F.coalesce(part, empty) for part in parts]))
    return found.unionByName(detect_instantiation(files))


CONTENT_DETECTORS = [
    detect_dangerous_import,
    detect_pickle_fallback,
    detect_python_rules,
    detect_config_flags,
    detect_instantiation,
    detect_keras_config,
    detect_graph_ops,
    detect_magic,
    detect_npy,
]
