"""Detectors over contents derived from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as S
from ..operators import chunked
from ..operators import detect as D
from ..sources import chunks
from . import tables as T

SHORT = ["artifact_id", "id", "severity", "location"]

# every document becomes the tail of a file whose head depends on its number
PICKLES = """
SELECT source AS artifact_id, 'w' || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 4 THEN '.bin' WHEN 1 THEN '.bin' WHEN 6 THEN '.pt' WHEN 3 THEN '.weights' ELSE '.pkl' END AS path,
       CASE doc_id % 7 WHEN 0 THEN '80036F730A73797374656D0A' WHEN 1 THEN '80048C05706F7369788C0673797374656D93'
         WHEN 2 THEN '80048C05706F7369788C0673797374656D' WHEN 3 THEN '80047D' WHEN 4 THEN '0102' WHEN 5 THEN '80055806000000736F636B6574580600' || '0000736F636B657493'
         ELSE '504B0304' END AS head, text
FROM {documents}
"""
SOURCES = """
SELECT source AS artifact_id, 'm' || CAST(doc_id AS STRING) || '.py' AS path,
       text || chr(10) || CASE doc_id % 8 WHEN 0 THEN 'os.system (cmd)' WHEN 1 THEN 'y = eval(z)' WHEN 2 THEN 'import requests' || chr(10) || 'requests.get(u)'
         WHEN 3 THEN 'pickle.loads(b); torch.load(f)' WHEN 4 THEN 'base64.b64decode(s)' WHEN 5 THEN 'load_inline' WHEN 6 THEN 'my_eval(z) retrieval(x)'
         ELSE 'subprocess.run(["ls"])' || chr(10) || 'exec(code)' END AS text
FROM {documents}
"""
CONFIGS = """
SELECT 'u' || CAST(user_id AS STRING) AS artifact_id, 'c' || CAST(event_id AS STRING) || '.json' AS path,
       '{"model_type": "' || event_type || '", "trust_remote_code": ' ||
       CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' WHEN 2 THEN 'false' ELSE 'null' END ||
       CASE event_id % 3 WHEN 0 THEN ', "auto_map": null' ELSE '' END || ', "props": ' || props ||
       CASE event_id % 5 WHEN 0 THEN ', "_target_": "os.system"'
         WHEN 1 THEN ', "net": {"layers": [{"a": 1}, {"class_path": "my.models.' || event_type || '"}]}'
         WHEN 2 THEN ', "l1": {"l2": {"l3": {"l4": {"l5": {"l6": {"l7": [[{"callable": "x.subprocess.run", "_target_": ""}]]}}}}}}'
         WHEN 3 THEN ', "callable": {"target_": 5}' ELSE '' END || '}' AS body,
       event_id, event_type
FROM {events}
"""
KERAS = """
SELECT source AS artifact_id, 'k' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.h5' WHEN 1 THEN '.keras!config.json' WHEN 2 THEN '.HDF5' ELSE '.data' END AS path,
       doc_id,
       CASE doc_id % 4 WHEN 3 THEN '894844460D0A1A0A' ELSE '' END AS head,
       text || CASE doc_id % 3 WHEN 0 THEN '{"class_name": "Lambda", "module": "keras.layers"}'
         WHEN 1 THEN '{"class_name":"TFSMLayer", "module" : "evil.' || lang || '", "module": "evil.' || lang || '", "module": "kerasfoo"}'
         ELSE '' END AS body
FROM {documents}
"""
GRAPHS = """
SELECT source AS artifact_id, 'g' || CAST(doc_id AS STRING) || CASE doc_id % 2 WHEN 0 THEN '.pb' ELSE '.onnx' END AS path,
       text || CASE doc_id % 6 WHEN 0 THEN 'SaveV2' WHEN 1 THEN 'com.microsoft.PythonOp' WHEN 2 THEN 'ReadFile' WHEN 3 THEN 'location ../etc' ELSE 'MatMul' END AS body, doc_id
FROM {documents}
"""
MAGIC = """
SELECT source AS artifact_id, 'f' || CAST(doc_id AS STRING) || CASE doc_id % 2 WHEN 0 THEN '.weights' ELSE '' END AS path, doc_id,
       CASE doc_id % 7 WHEN 0 THEN '7F454C46' WHEN 1 THEN '4D5A' WHEN 2 THEN 'CAFEBABE' WHEN 3 THEN 'CFFAEDFE' WHEN 4 THEN '23212F62696E2F7368200A' ELSE '' END AS head, text
FROM {documents}
"""
ARRAYS = """
SELECT source AS artifact_id, 'a' || CAST(doc_id AS STRING) || '.npy' AS path, doc_id,
       CASE doc_id % 5 WHEN 0 THEN '934E554D505901000A00' || '7B277C4F277D20202020' WHEN 1 THEN '934E554D505902000A000000' || '7B274F277D2020202020'
         WHEN 2 THEN '934E554D505901000000' WHEN 3 THEN '934E554D505902000000' || '2000' ELSE '934E554D505901000A00' || '7B273C6634277D202020' END AS head, text
FROM {documents}
"""
LISTING = """
SELECT 'm' || CAST(l_orderkey AS STRING) AS artifact_id,
       'd/p' || CAST(l_partkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || CASE l_partkey % 5 WHEN 0 THEN '.so' WHEN 1 THEN '.sh' ELSE '.txt' END AS path,
       l_returnflag = 'R' AS is_exec,
       CASE WHEN l_suppkey % 9 = 0 THEN '../x' WHEN l_suppkey % 9 = 1 THEN '../../y' WHEN l_suppkey % 9 = 2 THEN '/etc/passwd'
            WHEN l_suppkey % 9 = 3 THEN '/artifact/ok' WHEN l_suppkey % 9 = 4 THEN './../z/../../q' END AS link_target
FROM {lineitem}
"""
ARCHIVE = """
SELECT 'm' || CAST(l_orderkey AS STRING) AS artifact_id, 'a.zip' AS archive,
       CASE WHEN l_orderkey % 3 = 0 THEN 'tar' ELSE 'zip' END AS kind,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord,
       CASE WHEN l_suppkey % 13 = 0 THEN '../p' WHEN l_suppkey % 13 = 1 THEN 'a/../b' WHEN l_suppkey % 13 = 2 THEN 'C:/x' ELSE 'data/' END || CAST(l_partkey AS STRING) AS name,
       l_partkey % 50 AS compressed,
       CAST(floor(l_extendedprice) AS BIGINT) AS size,
       l_suppkey % 11 = 0 AS is_link
FROM {lineitem}
"""
ARCHIVE_LIMITS = {"max_entries": 5, "max_bytes": 200_000, "max_ratio": 2000.0}
EVENT_LISTING = "SELECT 'u' || CAST(user_id AS STRING) AS artifact_id, CAST(event_id AS STRING) AS path FROM {events}"


def _binary(spark, sf, text, body="text"):
    rows = T.read(spark, sf, text)
    return rows.withColumn("content", F.concat(F.unhex("head"), F.encode(body, "UTF-8")))


def _encoded(spark, sf, text, body):
    return T.read(spark, sf, text).withColumn("content", F.encode(body, "UTF-8"))



def licenses(spark, sf):
    r = F.create_map(F.lit(0), F.lit("apache 2.0"), F.lit(1), F.lit("SPDX:mit"), F.lit(2), F.lit(" gpl-3.0-ONLY "))
    raw = F.coalesce(F.try_element_at(r, (F.col("doc_id") % 7).cast("int")), F.when(F.col("doc_id") % 7 == 3, F.col("source")),
                     F.when(F.col("doc_id") % 7 == 4, "Llama3.1"), F.when(F.col("doc_id") % 7 == 5, F.concat("lang", F.lit(" terms_v1/é"))), F.lit(" "))
    resolved = T.table(spark, sf, "documents").select("doc_id", S.license_resolve(raw).alias("l"))
    return resolved.select("doc_id", "l.*")


def metadata(spark, sf):
    kv = T.read(spark, sf, T.RAW_KV)
    fmt = F.when(F.substring("artifact_id", -1, 1).isin("0", "1", "2", "3", "4", "5", "6"), "gguf").otherwise("onnx")
    artifacts = kv.select("artifact_id").distinct().withColumns({"format": fmt, "primary_path": F.lit("w")})
    named = kv.filter(F.col("key") == "general.license").withColumn(
        "spdx_id", S.license_resolve(F.col("value"))["spdx_id"]
    )
    domains = T.table(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey")).alias("artifact_id"), F.col("p_type").alias("domain"))
    return D.detect_metadata(artifacts, kv, named, domains).select("artifact_id", "id", "severity")


def component_findings(spark, sf):
    refs = T.read(spark, sf, T.SHARD_INDEX).distinct()
    path = F.when(F.col("path") == "shard-3", "..\\up").when(F.col("path") == "shard-5", "c:/d").otherwise(F.col("path"))
    files = T.read(spark, sf, T.SHARD_FILES)
    return D.detect_component(refs.withColumns({"path": path, "role": F.lit("shard")}).distinct(), files, 4).select(SHORT)


RANGED = ["detect_dangerous_import", "detect_pickle_fallback", "detect_python_rules", "detect_keras_config", "detect_graph_ops"]


def inspect_ranges(spark, sf):
    """Pickles, sources, Keras and graph files, cut into ranges so short that patterns lie across their edges."""
    kinds = [_binary(spark, sf, PICKLES), _encoded(spark, sf, SOURCES, "text"), _binary(spark, sf, KERAS, "body"), _encoded(spark, sf, GRAPHS, "body")]
    files = reduce(DataFrame.union, [k.select("artifact_id", "path", "content") for k in kinds])
    return chunked.inspect_ranges(chunks.chunked(files, 600, 256)).select(SHORT)


QUERIES = {
    "inspect_ranges": inspect_ranges,
    "detect_dangerous_import": lambda s, d: D.detect_dangerous_import(_binary(s, d, PICKLES)).select(
        *SHORT, "description"
    ),
    "detect_pickle_fallback": lambda s, d: D.detect_pickle_fallback(_binary(s, d, PICKLES)).select(SHORT),
    "detect_python_rules": lambda s, d: D.detect_python_rules(_encoded(s, d, SOURCES, "text")).select(SHORT),
    "detect_config_flags": lambda s, d: D.detect_config_flags(_encoded(s, d, CONFIGS, "body")).select(SHORT),
    "detect_instantiation": lambda s, d: D.detect_instantiation(_encoded(s, d, CONFIGS, "body")).select(
        *SHORT, "description"
    ),
    "detect_keras_config": lambda s, d: D.detect_keras_config(_binary(s, d, KERAS, "body")).select(
        *SHORT, "description"
    ),
    "detect_graph_ops": lambda s, d: D.detect_graph_ops(_encoded(s, d, GRAPHS, "body")).select(*SHORT, "description"),
    "detect_magic": lambda s, d: D.detect_magic(_binary(s, d, MAGIC)).select(SHORT),
    "detect_npy": lambda s, d: D.detect_npy(_binary(s, d, ARRAYS)).select(SHORT),
    "detect_file_meta": lambda s, d: D.detect_file_meta(T.read(s, d, LISTING)).select(SHORT),
    "detect_archive": lambda s, d: D.detect_archive(T.read(s, d, ARCHIVE), **ARCHIVE_LIMITS).select(SHORT),
    "detect_unreadable": lambda s, d: D.detect_unreadable(
        T.read(s, d, T.FILES).select("artifact_id", "path", F.lit("denied").alias("error"))
    ).select(SHORT),
    "detect_truncated": lambda s, d: D.detect_truncated(T.read(s, d, EVENT_LISTING), 65).select(*SHORT, "description"),
    "detect_metadata": metadata,
    "detect_component": component_findings,
    "license_resolve": licenses,
    "executes_on_load": lambda s, d: T.read(s, d, T.FILES).select(
        "artifact_id", "path", *[S.executes_on_load(F.col("path"), v).alias(v) for v in ("inspect", "provenance", "fetch")]
    ),
    "path_traversal": lambda s, d: T.read(s, d, ARCHIVE).select(
        "artifact_id",
        "name",
        P.path_traversal(F.col("name")).alias("reference"),
        P.archive_traversal(F.col("name")).alias("member"),
    ),
    "link_escape": lambda s, d: T.read(s, d, LISTING).select(
        "artifact_id", "path", P.link_escape(F.lit("/artifact"), F.col("path"), F.col("link_target")).alias("escapes")
    ),
}

LINE = "length(pre) - length(replace(pre, chr(10), '')) + 1"


def _py(pattern, rule, severity):
    return (
        f"SELECT artifact_id, '{rule}' AS id, '{severity}' AS severity, path || ':' || CAST({LINE} AS VARCHAR) AS location FROM "
        f"(SELECT *, regexp_extract(text, '(?s)^(.*?){pattern}', 1) AS pre FROM s WHERE regexp_matches(text, '{pattern}'))"
    )


EXT = "lower(regexp_extract(path, '(\\.[^.]*)$', 1))"


def _in_list(exts):
    return f"{EXT} IN (" + ", ".join(f"'{e}'" for e in exts) + ")"


ORACLES = {
    "detect_dangerous_import": T.with_ctes(
        """SELECT artifact_id, 'AR-PICKLE-001' AS id, 'Critical' AS severity, path AS location, 'runs on load: ' || CASE head[1:6] WHEN '80036F' THEN 'os.system' WHEN '80048C' THEN 'posix.system' ELSE 'socket.socket' END AS description
        FROM p WHERE head LIKE '80036F%' OR (head LIKE '80048C%' AND regexp_matches(head || hex(encode(text)), '^(..)*93')) OR head LIKE '80055806%'""",
        p=PICKLES,
    ),
    # the heads without a dangerous import; every text holds at least one opcode byte, which is checked here
    "detect_pickle_fallback": T.with_ctes(
        """SELECT artifact_id, CASE WHEN head='504B0304' THEN 'AR-PICKLE-002' WHEN regexp_matches(text, '[cRiob]') OR head LIKE '%6F%' OR head LIKE '%8C%' THEN 'AR-PICKLE-003' ELSE 'AR-PICKLE-004' END AS id,
        CASE WHEN head='504B0304' THEN 'Medium' WHEN regexp_matches(text, '[cRiob]') OR head LIKE '%8C%' THEN 'Low' ELSE 'Medium' END AS severity, path AS location
        FROM p WHERE head='504B0304' OR (head LIKE '80048C%' AND NOT regexp_matches(head || hex(encode(text)), '^(..)*93')) OR head='80047D'""",
        p=PICKLES,
    ),
    "detect_python_rules": T.with_ctes(
        " UNION ALL ".join(
            [
                _py(r"\b(os\.system|os\.popen|subprocess\.(?:Popen|run|call|check_output))\s*\(", "AR-PY-001", "Critical"),
                _py(r"\b(eval|exec|compile)\s*\(", "AR-PY-002", "High"),
                _py(r"\b(requests\.(?:get|post)|urllib\.request\.urlopen|socket\.socket|httpx\.(?:get|post))\s*\(", "AR-PY-003", "High"),
                _py(r"\b(pickle\.loads?|torch\.load|joblib\.load|dill\.loads?|yaml\.load)\s*\(", "AR-PY-004", "High"),
                _py(r"base64\.b64decode\s*\(", "AR-PY-005", "Medium"),
                "SELECT artifact_id, 'AR-PY-006', 'High', path FROM s WHERE contains(text, 'torch.utils.cpp_extension') OR contains(text, 'load_inline')",
            ]
        ),
        s=SOURCES,
    ),
    "detect_config_flags": T.with_ctes(
        """SELECT artifact_id, 'AR-HF-001' AS id, 'Critical' AS severity, path AS location FROM c WHERE event_id % 4 = 0
        UNION ALL SELECT artifact_id, 'AR-HF-002', 'High', path FROM c WHERE event_id % 3 = 0""",
        c=CONFIGS,
    ),
    "detect_instantiation": T.with_ctes(
        """SELECT artifact_id, 'AR-CONFIG-001' AS id, CASE event_id % 5 WHEN 1 THEN 'Low' ELSE 'Critical' END AS severity,
        path || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' at net.layers.1' ELSE ' at l1.l2.l3.l4.l5.l6.l7.0.0' END AS location,
        CASE event_id % 5 WHEN 0 THEN '_target_ names os.system' WHEN 1 THEN 'class_path names my.models.' || event_type ELSE 'callable names x.subprocess.run' END AS description
        FROM c WHERE event_id % 5 IN (0, 1, 2)""",
        c=CONFIGS,
    ),
    "detect_keras_config": T.with_ctes(
        """SELECT artifact_id, CASE doc_id % 3 WHEN 0 THEN 'AR-KERAS-001' ELSE 'AR-KERAS-002' END AS id, 'Critical' AS severity, path AS location,
          CASE doc_id % 3 WHEN 0 THEN 'runs on load' ELSE 'loads a path it names' END AS description FROM k WHERE doc_id % 3 < 2
        UNION ALL SELECT artifact_id, 'AR-KERAS-003', 'High', path, 'module ' || unnest(list_distinct(regexp_extract_all(body, '"module"\\s*:\\s*"(evil[a-z.]*|kerasfoo)"', 1))) FROM k WHERE doc_id % 3 = 1
        UNION ALL SELECT artifact_id, 'AR-KERAS-004', 'Medium', path, 'the header is not HDF5' FROM k WHERE doc_id % 3 = 2 AND doc_id % 4 IN (0, 2)""",
        k=KERAS,
    ),
    "detect_graph_ops": T.with_ctes(
        """SELECT artifact_id, 'AR-TF-001' AS id, CASE op WHEN 'ReadFile' THEN 'Medium' ELSE 'High' END AS severity, path AS location, 'operation ' || op AS description
          FROM g, (VALUES ('PyFunc'),('PyFuncStateless'),('ReadFile'),('WriteFile'),('MergeV2Checkpoints'),('Save'),('SaveV2'),('DecodeJpeg')) o(op) WHERE path LIKE '%.pb' AND contains(body, op)
        UNION ALL SELECT artifact_id, 'AR-ONNX-001', 'High', path, 'operator ' || op
          FROM g, (VALUES ('com.microsoft.PythonOp'),('PythonOp'),('ai.onnx.contrib'),('CustomOp'),('TorchScript')) o(op) WHERE path LIKE '%.onnx' AND contains(body, op)
        UNION ALL SELECT artifact_id, 'AR-ONNX-002', 'Critical', path, 'a reference contains ../' FROM g WHERE path LIKE '%.onnx' AND (contains(body,'location') OR contains(body,'external_data')) AND contains(body, '../')""",
        g=GRAPHS,
    ),
    "detect_magic": T.with_ctes(
        """SELECT artifact_id, CASE doc_id % 7 WHEN 0 THEN 'AR-BIN-001' WHEN 1 THEN 'AR-BIN-002' WHEN 4 THEN 'AR-SHELL-002' ELSE 'AR-BIN-003' END AS id,
        CASE doc_id % 7 WHEN 4 THEN 'Medium' ELSE 'High' END AS severity, path AS location FROM m WHERE head <> ''
        UNION ALL SELECT artifact_id, CASE WHEN text LIKE 'MZ%' THEN 'AR-BIN-002' ELSE 'AR-SHELL-002' END, CASE WHEN text LIKE 'MZ%' THEN 'High' ELSE 'Medium' END, path FROM m WHERE head = '' AND (text LIKE 'MZ%' OR text LIKE '#!%')""",
        m=MAGIC,
    ),
    "detect_npy": T.with_ctes(
        """SELECT artifact_id, CASE WHEN doc_id % 5 < 2 THEN 'AR-NPY-001' ELSE 'AR-NPY-002' END AS id, CASE WHEN doc_id % 5 < 2 THEN 'High' ELSE 'Medium' END AS severity, path AS location
        FROM a WHERE doc_id % 5 < 4""",
        a=ARRAYS,
    ),
    "detect_file_meta": T.with_ctes(
        """SELECT artifact_id, 'AR-LINK-001' AS id, 'High' AS severity, path AS location FROM l WHERE link_target IN ('../../y', '/etc/passwd', './../z/../../q')
        UNION ALL SELECT artifact_id, 'AR-EXEC-001', 'Medium', path FROM l WHERE link_target IS NULL AND is_exec
        UNION ALL SELECT artifact_id, 'AR-NATIVE-001', 'High', path FROM l WHERE link_target IS NULL AND path LIKE '%.so'
        UNION ALL SELECT artifact_id, 'AR-SHELL-001', 'Medium', path FROM l WHERE link_target IS NULL AND path LIKE '%.sh'""",
        l=LISTING,
    ),
    "detect_archive": T.with_ctes(
        """, w AS (SELECT *, name LIKE '../%' OR name LIKE 'a/../%' AS esc FROM e WHERE ord <= 5),
        t AS (SELECT *, sum(CASE WHEN esc OR is_link THEN 0 ELSE size END) OVER (PARTITION BY artifact_id ORDER BY ord) AS tot FROM w),
        st AS (SELECT artifact_id, min(ord) FILTER (WHERE NOT esc AND NOT is_link AND tot > 200000) AS stop FROM t GROUP BY 1),
        sn AS (SELECT t.*, stop FROM t JOIN st USING (artifact_id) WHERE stop IS NULL OR ord <= stop),
        ag AS (SELECT artifact_id, any_value(kind) AS kind, any_value(stop) AS stop, sum(compressed) FILTER (WHERE NOT esc AND NOT is_link) AS i, sum(size) FILTER (WHERE NOT esc AND NOT is_link) AS o FROM sn GROUP BY 1)
        SELECT artifact_id, CASE WHEN esc THEN 'AR-ARCHIVE-003' ELSE 'AR-ARCHIVE-004' END AS id, CASE WHEN esc THEN 'Critical' ELSE 'High' END AS severity, archive || '!' || name AS location FROM (SELECT *, name LIKE '../%' OR name LIKE 'a/../%' AS esc FROM e) WHERE esc OR is_link
        UNION ALL SELECT artifact_id, 'AR-ARCHIVE-002', 'High', 'a.zip' FROM ag WHERE stop IS NULL AND artifact_id IN (SELECT artifact_id FROM e GROUP BY 1 HAVING max(ord) > 5)
        UNION ALL SELECT artifact_id, 'AR-ARCHIVE-005', 'High', 'a.zip' FROM ag WHERE stop IS NOT NULL
        UNION ALL SELECT artifact_id, 'AR-ARCHIVE-006', 'High', 'a.zip' FROM ag WHERE kind = 'zip' AND i > 0 AND o / i > 2000""",
        e=ARCHIVE,
    ).replace(") , w", "), w"),
    "detect_unreadable": T.with_ctes(
        f"SELECT artifact_id, 'AR-IO-001' AS id, CASE WHEN {_in_list(['.gguf', '.onnx', '.bin', '.pkl', '.h5'])} THEN 'High' ELSE 'Low' END AS severity, path AS location FROM f",
        f=T.FILES,
    ),
    "detect_truncated": T.with_ctes(
        "SELECT artifact_id, 'AR-COVERAGE-001' AS id, 'High' AS severity, '' AS location, 'examined 65 of ' || count(*) AS description FROM e GROUP BY artifact_id HAVING count(*) > 65",
        e=EVENT_LISTING,
    ),
    "detect_metadata": T.with_ctes(
        """, a AS (SELECT DISTINCT artifact_id, CASE WHEN right(artifact_id, 1) <= '6' THEN 'gguf' ELSE 'onnx' END AS format FROM kv),
        al AS (SELECT artifact_id, TRY_CAST(value AS BIGINT) AS n FROM kv WHERE key = 'general.alignment')
        SELECT artifact_id, 'AR-GGUF-010' AS id, 'High' AS severity FROM a JOIN kv USING (artifact_id) WHERE format = 'gguf' AND key = 'tokenizer.chat_template' AND (contains(value, '{' || '%') OR contains(value, '.__'))
        UNION ALL SELECT artifact_id, 'AR-GGUF-011', 'Medium' FROM a JOIN al USING (artifact_id) WHERE format = 'gguf' AND (n = 0 OR n > 1048576 OR bit_count(n) <> 1)
        UNION ALL SELECT artifact_id, 'AR-ONNX-010', 'High' FROM a WHERE format = 'onnx' AND artifact_id IN (SELECT 'm' || p_partkey FROM part)
        UNION ALL SELECT artifact_id, 'AR-LIC-001', 'Low' FROM a WHERE artifact_id NOT IN (SELECT artifact_id FROM kv WHERE key = 'general.license' AND value <> '')""",
        kv=T.RAW_KV,
    ).replace(") , a AS", "), a AS"),
    "detect_component": T.with_ctes(
        """, r AS (SELECT DISTINCT artifact_id, CASE path WHEN 'shard-3' THEN '..\\up' WHEN 'shard-5' THEN 'c:/d' ELSE path END AS path FROM i), p AS (SELECT DISTINCT artifact_id, path FROM f)
        SELECT artifact_id, 'AR-FILE-003' AS id, 'Critical' AS severity, path AS location FROM r WHERE path IN ('..\\up', 'c:/d')
        UNION ALL SELECT artifact_id, 'AR-FILE-001', 'Medium', path FROM r WHERE path LIKE 'shard%' AND NOT EXISTS (SELECT 1 FROM p WHERE p.artifact_id = r.artifact_id AND p.path = r.path)
        UNION ALL SELECT artifact_id, 'AR-FILE-002', 'Medium', '' FROM r JOIN p USING (artifact_id, path) GROUP BY artifact_id HAVING count(*) > 4""",
        i=T.SHARD_INDEX,
        f=T.SHARD_FILES,
    ).replace(") , r AS", "), r AS"),
    "license_resolve": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'MIT' WHEN 2 THEN 'GPL-3.0-only' WHEN 3 THEN 'LicenseRef-' || source
        WHEN 4 THEN 'LicenseRef-Llama-3.1' WHEN 5 THEN 'LicenseRef-' || lang || '-terms-v1' END AS spdx_id,
        CASE doc_id % 7 WHEN 0 THEN 'normalized' WHEN 1 THEN 'normalized' WHEN 2 THEN 'exact' WHEN 4 THEN 'model' ELSE 'none' END AS confidence FROM documents""",
    "executes_on_load": T.with_ctes(
        f"SELECT artifact_id, path, {_in_list(['.gguf', '.onnx', '.bin', '.pkl', '.h5'])} AS inspect, {_in_list(['.bin', '.pkl', '.h5'])} AS provenance, "
        f"{_in_list(['.onnx', '.bin', '.pkl', '.py', '.h5', '.so', '.sh'])} AS fetch FROM f",
        f=T.FILES,
    ),
    "path_traversal": T.with_ctes(
        "SELECT artifact_id, name, name LIKE '../%' OR name LIKE 'a/../%' OR name LIKE 'C:%' AS reference, name LIKE '../%' OR name LIKE 'a/../%' AS member FROM e",
        e=ARCHIVE,
    ),
    "link_escape": T.with_ctes(
        "SELECT artifact_id, path, link_target IN ('../../y', '/etc/passwd', './../z/../../q') AS escapes FROM l",
        l=LISTING,
    ),
}
ORACLES["inspect_ranges"] = " UNION ALL ".join(f"SELECT artifact_id, id, severity, location FROM ({ORACLES[name]})" for name in RANGED)
