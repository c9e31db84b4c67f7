"""Readers and document sinks. Report and document texts are built from rows of the given tables, so the
SQL statements can state the expected rows straight from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookups import nullif_empty
from ..operators import coverage as CV
from ..operators import findings as O
from ..operators import measure as M
from ..session import kept, shared_folder
from ..sinks import cyclonedx as CX
from ..sinks import sarif as SA
from ..sinks import spdx as SP
from ..sinks import streams as ST
from ..sources import boms as B
from ..sources import chunks as CH
from ..sources import files as FI
from ..sources import reports as R
from ..sources import sidecars as SC
from . import platform as PL
from . import tables as T

NOW = "2026-01-01T00:00:00Z"
SHOWN = ["artifact_id", "ord", "id", "title", "severity", "category", "location", "description"]

KEY = "CAST(o_orderkey AS STRING)"
BODIES = {
    "clamav": f"'start' || chr(10) || '  /d/' || {KEY} || '.bin: Win.' || o_orderstatus || ' FOUND  ' || chr(10) || 'x: OK' || chr(10) || 'broken FOUND' || chr(10) || CASE o_orderstatus WHEN 'F' THEN 'a: b: c FOUND' ELSE '' END",
    "trivy-json": f"""'{{"Results":[{{"Target":"t' || {KEY} || '","Vulnerabilities":[{{"VulnerabilityID":"CVE-' || {KEY} || '","PkgName":"p","InstalledVersion":"1"' ||
        CASE o_orderstatus WHEN 'F' THEN ',"FixedVersion":"2"' ELSE '' END || ',"Severity":"' || substr(o_orderpriority, 3) || '","Title":"' || CASE o_orderstatus WHEN 'P' THEN 'known' ELSE '' END || '"}}],
        "Secrets":[{{"RuleID":"r' || {KEY} || '","Severity":"moderate","Title":"sec","Match":"m"}}]}},{{"Target":"none"}}]}}'""",
    "grype-json": f"""'{{"matches":[{{"vulnerability":{{"id":"G-' || {KEY} || '","severity":"' || substr(o_orderpriority, 3) || '","description":"' || repeat('x', CAST(o_custkey % 700 AS INT)) || '"}},"artifact":{{"name":"pkg","version":"1","locations":' ||
        CASE o_orderstatus WHEN 'F' THEN '[{{"path":"/p1"}},{{"path":"/p2"}}]' ELSE '[]' END || '}}}}]}}'""",
    "trufflehog-json": f"""'noise' || chr(10) || '{{"DetectorName":"D' || {KEY} || '","Verified":' || CASE o_orderstatus WHEN 'F' THEN 'true' ELSE 'false' END ||
        ',"SourceMetadata":{{"Data":{{"Filesystem":{{"file":"f.py","line":' || CAST(o_custkey % 3 AS STRING) || '}}}}}}}}' || chr(10) || '{{broken' || chr(10) || '{{"DetectorName":""}}'""",
    "native": f"""'{{"findings":[{{"id":"N-' || {KEY} || '","title":"n","severity":"negligible","category":"drift","location":"l"}},{{"id":"M","severity":"HIGH"}}]' || CASE o_orderstatus WHEN 'F' THEN ',"generated":true' WHEN 'O' THEN ',"generated":false' ELSE '' END || '}}'""",
    "syft-spdx": f"""'{{"packages":[{{"name":"p' || {KEY} || '"}}]}}'""",
}


def _reports_sql(fmt):
    return f"SELECT 'm' || {KEY} AS artifact_id, 'scan' AS scanner, '{fmt}' AS format, {BODIES[fmt]} AS body FROM {{orders}}"


MIXED = f"""SELECT 'm' || {KEY} AS artifact_id, 'scan' AS scanner, format, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN '{{"cut":' WHEN o_orderpriority = '2-HIGH' THEN '  ' ELSE body END AS body
FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 'clamav' WHEN 1 THEN 'trivy-json' WHEN 2 THEN 'grype-json' WHEN 3 THEN 'trufflehog-json' WHEN 4 THEN 'native' WHEN 5 THEN 'syft-spdx' ELSE 'mystery' END AS format,
  CASE o_orderkey % 7 WHEN 0 THEN {BODIES['clamav']} WHEN 1 THEN {BODIES['trivy-json']} WHEN 2 THEN {BODIES['grype-json']} WHEN 3 THEN {BODIES['trufflehog-json']} WHEN 4 THEN {BODIES['native']} WHEN 5 THEN {BODIES['syft-spdx']} ELSE 'x' END AS body
  FROM {{orders}}) s"""
CUST = "CAST(c_custkey AS STRING)"
CDX_BODY = f"""'{{"bomFormat":"CycloneDX","specVersion":"1.6","metadata":{{"component":{{"type":"machine-learning-model","name":"' || c_name || '","version":"' || CASE c_nationkey % 2 WHEN 0 THEN '1' ELSE '' END || '","hashes":[{{"alg":"sha-256","content":"aa' || {CUST} || '"}},{{"alg":"MD5","content":"x"}}],
  "properties":[{{"name":"fleetrisk:primaryFile","value":"w.gguf"}},{{"name":"fleetrisk:measuredParameters","value":"' || {CUST} || '"}},{{"name":"hyperparameter:x","value":"1"}}],"modelCard":{{"modelParameters":{{"modelArchitecture":"' || CASE c_nationkey % 3 WHEN 0 THEN 'llama' ELSE '' END || '"}},"properties":[{{"name":"fleetrisk:quantization","value":"Q4"}}]}}}}}},
  "components":[{{"type":"file","name":"s' || {CUST} || '","hashes":[{{"alg":"SHA-384","content":"bb"}}],"properties":[{{"name":"fleetrisk:size","value":"' || {CUST} || '"}}]}},{{"type":"library","name":"lib"}}]}}'"""
SPDX_BODY = f"""'{{"@context":"c","@graph":[{{"type":"SpdxDocument","name":"d"}},{{"type":"software_File","name":"s' || {CUST} || '","verifiedUsing":[{{"algorithm":"SHA256","hashValue":"cc"}}]}},{{"type":"ai_AIPackage","name":"' || c_name || '","software_packageVersion":"2","verifiedUsing":[{{"algorithm":"sha384","hashValue":"dd' || {CUST} || '"}}],
  "ai_typeOfModel":["bert"],"ai_hyperparameter":[{{"key":"quantization","value":"Q8"}},{{"key":"primaryFile","value":"w.onnx"}},{{"key":"layers","value":"3"}}]}},{{"type":"ai_AIPackage","name":"ancestor"}}]}}'"""
DOCUMENTS = f"""SELECT 'd' || {CUST} AS doc_id, 'm' || {CUST} AS artifact_id, c_nationkey,
  CASE c_nationkey % 5 WHEN 0 THEN {CDX_BODY} WHEN 1 THEN {SPDX_BODY} WHEN 2 THEN '{{"x":1}}' WHEN 3 THEN 'text' ELSE {CDX_BODY} END AS body FROM {{customer}}"""
CONFIG_BODY = f"""SELECT 'm' || {CUST} AS artifact_id, CASE c_nationkey % 9 WHEN 8 THEN '[1]' WHEN 7 THEN 'x' ELSE '{{"architectures":' || CASE c_nationkey % 3 WHEN 0 THEN '["A' || {CUST} || '","B"]' WHEN 1 THEN '[]' ELSE 'null' END || ',"model_type":"llama","torch_dtype":"' || CASE c_nationkey % 2 WHEN 0 THEN 'bfloat16' ELSE '' END ||
  '","dtype":"float16","quantization_config":' || CASE c_nationkey % 4 WHEN 0 THEN '{{"quant_method":"gptq","bits":4}}' WHEN 1 THEN '{{"quant_method":"awq"}}' ELSE 'null' END || ',"num_parameters":' || CASE c_nationkey % 4 WHEN 0 THEN {CUST} WHEN 1 THEN '"7B"' WHEN 2 THEN '1.5e9' ELSE 'null' END || '}}' END AS body, c_nationkey, c_custkey FROM {{customer}}"""
INDEX_BODY = f"""SELECT 'm' || {KEY} AS artifact_id, '{{"metadata":{{}},"weight_map":{{"a":"s1-' || o_orderstatus || '","b":"s1-' || o_orderstatus || '","c":"s2-' || CAST(o_custkey AS STRING) || '"}}}}' AS body, o_orderstatus, o_custkey FROM {{orders}}"""
CARD_BODY = f"""SELECT 'm' || {CUST} AS artifact_id, c_nationkey, c_custkey,
  CASE c_nationkey % 5 WHEN 4 THEN 'no front matter' ELSE '---' || chr(10) || 'license: "mit"' || chr(10) || '# note' || chr(10) || 'base_model:' || chr(10) || '- org/m' || {CUST} || chr(10) || '  - ''b''' || chr(10) || 'datasets:' || chr(10) || '' || chr(10) || '- org/d' || chr(10) || 'extra:' || chr(10) || '  nested: 1' || chr(10) || '- stray' || chr(10) ||
  CASE c_nationkey % 2 WHEN 0 THEN 'pipeline_tag: text:gen' || chr(10) ELSE '' END || 'library_name: ''tf''' || chr(10) || CASE c_nationkey % 5 WHEN 3 THEN '' ELSE '---' || chr(10) || 'license: late' END END AS body FROM {{customer}}"""
HEADERS = """SELECT 'm' || CAST(p_partkey AS STRING) AS artifact_id, 'w.safetensors' AS path, p_size, p_partkey, CASE p_size % 6 WHEN 5 THEN '{bad' ELSE
  '{"__metadata__":{"format":"pt","empty":""},"b.' || p_brand || '":{"dtype":"F32","shape":[' || CAST(p_size AS STRING) || ',2],"data_offsets":[0,8]},"a":{"dtype":"BF16","shape":[]}}' END AS header FROM {part}"""
DETECT = """SELECT source AS artifact_id, 'f' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.bin' WHEN 1 THEN '.ONNX' WHEN 2 THEN '.safetensors' WHEN 3 THEN '.ggml' WHEN 4 THEN '.txt' ELSE '.safetensors' END AS path, doc_id,
  CASE WHEN doc_id % 6 = 0 THEN '47475546' WHEN doc_id % 12 = 2 THEN '47475546' WHEN doc_id % 6 = 5 THEN '1000000000000000' ELSE '' END AS head, text FROM {documents}"""


def _report(fmt, reader):
    return lambda s, d: reader(T.read(s, d, _reports_sql(fmt))).select(SHOWN)


def _parsed_documents(s, d):
    detected = B.bom_detect(T.spread(T.read(s, d, DOCUMENTS), "doc_id"))
    return detected.filter("error IS NULL")


def _claims(rows):
    get = lambda k: F.try_element_at("properties", F.lit(k))
    return rows.select(
        "doc_id", "format", "model_name", "version", get("architecture").alias("architecture"),
        get("quantization").alias("quantization"), get("measuredParameters").alias("parameters"),
    )


def _with_files(claims, files):
    """Claims and files side by side: one row per documented file."""
    return _claims(claims).join(files, "doc_id", "left")


def read_cyclonedx(s, d):
    docs = _parsed_documents(s, d).filter("kind = 'cyclonedx'")
    return _with_files(*B.bom_read_cyclonedx(docs))


def read_spdx(s, d):
    docs = _parsed_documents(s, d).filter("kind = 'spdx'")
    return _with_files(*B.bom_read_spdx(docs))


def _document_ranges(s, d):
    """The documents in ranges of 200 bytes."""
    body = F.encode("body", "UTF-8").alias("content")
    rows = CH.chunked(T.read(s, d, DOCUMENTS).select("artifact_id", F.col("doc_id").alias("path"), body), 200, 0)
    return rows.withColumnRenamed("path", "doc_id")


def read_bom_ranges(s, d):
    _, claims, files = B.read_ranges(_document_ranges(s, d))
    return _with_files(claims, files)


def _header_files(s, d):
    rows = T.read(s, d, HEADERS)
    size = F.length(F.encode("header", "UTF-8"))
    stated = F.when(F.col("p_size") % 6 == 0, 0).when(F.col("p_size") % 6 == 1, size + 5).otherwise(size)
    digits = F.lpad(F.hex(stated.cast("bigint")), 16, "0")
    prefix = F.unhex(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(8, 0, -1)]))
    content = F.when(F.col("p_size") % 6 == 2, F.unhex(F.lit("0102"))).otherwise(F.concat(prefix, F.encode("header", "UTF-8")))
    return rows.withColumn("content", content).withColumn("size", F.length("content").cast("bigint"))


def header_tensors(s, d):
    tensors, _, _ = FI.header_safetensors(_header_files(s, d))
    return tensors.select("artifact_id", "ord", "name", "dtype", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"))


def header_problems(s, d):
    _, metadata, findings = FI.header_safetensors(_header_files(s, d))
    lifted = metadata.select("artifact_id", F.col("key").alias("what"), F.col("value").alias("detail"))
    return lifted.unionByName(findings.select("artifact_id", F.col("id").alias("what"), F.col("severity").alias("detail")))


def cards(s, d):
    return SC.sidecar_card(T.read(s, d, CARD_BODY))


# --- sinks ---------------------------------------------------------------------------------------------------
def _hyper(s, d):
    return M.hyperparameters(T.read(s, d, T.RAW_KV))


def _refs(s, d):
    return M.lineage_collect(T.read(s, d, T.RAW_KV)).select("artifact_id", "ord", "name", "url", "doi")


def _inputs(s, d):
    read = lambda text: T.read(s, d, text)
    # one row per artifact, read once per list of the documents
    profiles = kept(PL._profiles(s, d), "profiles")
    return profiles, read(T.COMPONENT_FILES), read(T.LICENSE_ROWS), read(T.DATASET_ROWS), read(T.DOMAIN_ROWS), O.normalized(read(T.FINDINGS))


def _cyclonedx(s, d):
    profiles, files, licenses, datasets, domains, findings = _inputs(s, d)
    return profiles, CX.cyclonedx_nodes(profiles, files, licenses, datasets, domains, findings, _hyper(s, d), _refs(s, d))


def _spdx(s, d):
    profiles, files, _, datasets, _, findings = _inputs(s, d)
    return profiles, SP.spdx_nodes(profiles, files, datasets, findings, _hyper(s, d), _refs(s, d))


def _sarif(s, d):
    # a log needs no more of an artifact than its name and its primary file
    names = T.read(s, d, T.PROFILES).select("artifact_id", nullif_empty(F.col("name")).alias("name"))
    profiles = names.join(CV.file_facts(T.read(s, d, T.COMPONENT_FILES)), "artifact_id", "left")
    return profiles, SA.sarif_nodes(profiles, O.normalized(T.read(s, d, T.FINDINGS)))


def emit_cyclonedx(s, d, version="1.6"):
    return CX.emit_cyclonedx(*_cyclonedx(s, d), NOW, version).select("artifact_id", "document")


def emit_spdx(s, d):
    return SP.emit_spdx(*_spdx(s, d), NOW).select("artifact_id", "document")


def emit_sarif(s, d):
    return SA.emit_sarif(*_sarif(s, d), NOW).select("artifact_id", "document")


def _written(s, pieces):
    """Documents written as chunk files in the shared folder, and read back from them."""
    path = shared_folder(s, "documents")
    ST.write(pieces, path)
    return ST.read_documents(s, path)


QUERIES = {
    "ingest_clamav": _report("clamav", R.ingest_clamav),
    "ingest_trivy": _report("trivy-json", R.ingest_trivy),
    "ingest_grype": _report("grype-json", R.ingest_grype),
    "ingest_trufflehog": _report("trufflehog-json", R.ingest_trufflehog),
    "ingest_native": _report("native", R.ingest_native),
    "ingest_spdx_sbom": lambda s, d: R.ingest_spdx_sbom(T.read(s, d, _reports_sql("syft-spdx"))).select("artifact_id", "format", "state"),
    "ingest_dispatch": lambda s, d: R.ingest(T.read(s, d, MIXED))[1],
    "ingest_findings": lambda s, d: R.ingest(T.read(s, d, MIXED))[0].select("artifact_id", "id", "severity", "category"),
    "bom_detect": lambda s, d: B.bom_detect(T.read(s, d, DOCUMENTS)).select("doc_id", "kind", "error"),
    "bom_read_cyclonedx": read_cyclonedx,
    "bom_read_spdx": read_spdx,
    "bom_detect_ranges": lambda s, d: B.read_ranges(_document_ranges(s, d))[0].select("doc_id", "kind", "error"),
    "bom_read_ranges": read_bom_ranges,
    "sidecar_config": lambda s, d: SC.sidecar_config(T.read(s, d, CONFIG_BODY)),
    "sidecar_index": lambda s, d: SC.sidecar_index(T.read(s, d, INDEX_BODY)),
    "sidecar_card": cards,
    "card_references": lambda s, d: SC.card_references(cards(s, d)),
    "header_safetensors": header_tensors,
    "header_findings": header_problems,
    "file_inventory": lambda s, d: FI.file_inventory(T.read(s, d, T.FILES).select("artifact_id", "path", "size"), 45),
    "format_detect": lambda s, d: FI.format_detect(
        T.read(s, d, DETECT).withColumn("content", F.concat(F.unhex("head"), F.encode("text", "UTF-8")))
    ),
    "emit_cyclonedx": emit_cyclonedx,
    "emit_spdx": emit_spdx,
    "emit_sarif": emit_sarif,
    "emit_cyclonedx_stream": lambda s, d: _written(s, CX.cyclonedx_pieces(*_cyclonedx(s, d), NOW)),
    "emit_spdx_stream": lambda s, d: _written(s, SP.spdx_pieces(*_spdx(s, d), NOW)),
    "emit_sarif_stream": lambda s, d: _written(s, SA.sarif_pieces(*_sarif(s, d), NOW)),
}

# --- the same in plain SQL ---------------------------------------------------------------------------------
OKEY = "o_orderkey::VARCHAR"
PRIORITY = "CASE substr(o_orderpriority, 3) WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' WHEN 'LOW' THEN 'Low' ELSE 'Unknown' END"


def js(x):
    return f"to_json(({x})::VARCHAR)::VARCHAR"


def member(name, value):
    return f"'\"{name}\":' || ({value})"


def ob(*fields):
    """SQL text of a JSON object; NULL members drop out of concat_ws."""
    return "('{' || concat_ws(',', " + ", ".join(member(n, v) for n, v in fields) + ") || '}')"


def lst(*values):
    return "('[' || concat_ws(',', " + ", ".join(values) + ") || ']')"


def opt(condition, value):
    return f"CASE WHEN {condition} THEN {value} END"


def some(x):
    return f"CASE WHEN {x} NOT IN ('{{}}', '[]') THEN {x} END"


def prop(name, value):
    return opt(f"({value}) IS NOT NULL", ob(("name", js(f"'{name}'")), ("value", js(value))))


def sql_hashes(p256, p384, p512):
    return some(lst(*[opt(f"{v} <> ''", ob(("alg", js(f"'SHA-{b}'")), ("content", js(v)))) for b, v in ((256, p256), (384, p384), (512, p512))]))


def uuid(seed):
    h = f"sha256('fleetrisk:' || {seed})"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:18])::INTEGER % 4) + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


def short(sha, fallback):
    return f"CASE WHEN length({sha}) >= 16 THEN left({sha}, 16) ELSE coalesce(nullif(trim(regexp_replace({fallback}, '[^A-Za-z0-9._-]', '-', 'g'), '-'), ''), 'x') END"


MODEL_REF = f"'urn:fleetrisk:model:' || {short('p256', 'name')}"
FILE_EXEC = f"CASE WHEN role = 'primary' THEN {PL.EXECUTABLE} ELSE 'non-executable' END"
FILE_STRUCT = "CASE WHEN role = 'primary' OR (role = 'shard' AND format = 'safetensors') OR path LIKE '%.safetensors' THEN 'structured' ELSE 'unstructured' END"
NORMAL = "CASE upper(severity) WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' WHEN 'LOW' THEN 'Low' ELSE 'Unknown' END"
KV_CTES = f""", fn AS (SELECT * REPLACE ({NORMAL} AS severity) FROM fi)""" + """, ar AS (SELECT artifact_id, value AS arch FROM kv WHERE key='general.architecture' AND value<>''),
 hy AS (SELECT artifact_id, CASE WHEN key='general.quantization_version' THEN 'quantization_version' ELSE substr(key, length(arch)+2) END AS name, value
   FROM kv JOIN ar USING (artifact_id) WHERE (starts_with(key, arch||'.') AND NOT starts_with(key, arch||'.vocab')) OR key='general.quantization_version'),
 rf AS (SELECT artifact_id, CAST(split_part(key,'.',3) AS INTEGER) AS ord, max(value) FILTER (WHERE split_part(key,'.',4) IN ('name','organization')) AS name,
   max(value) FILTER (WHERE split_part(key,'.',4)='repo_url') AS url, max(value) FILTER (WHERE split_part(key,'.',4)='doi') AS doi FROM kv WHERE starts_with(key,'general.base_model.') AND value<>'' GROUP BY 1,2) """


def _doc_sql(body):
    head = T.with_ctes("SELECT 0", **PL.COVERAGE_CTES, kv=T.RAW_KV)[: -len("SELECT 0")].rstrip()
    return head + PL.WIDE + KV_CTES + body


def agg(name, source, value, order, extra="artifact_id"):
    return f", {name} AS (SELECT {extra}, '[' || string_agg({value}, ',' ORDER BY {order}) || ']' AS j FROM {source} GROUP BY 1)"


def pick(name):
    return f"(SELECT j FROM {name} WHERE {name}.artifact_id = q.artifact_id)"



BARE = lambda name: f"substr({pick(name)}, 2, length({pick(name)}) - 2)"
FILE_PROPS = [("bsi:component:executable", FILE_EXEC), ("bsi:component:archive", "'no archive'"), ("bsi:component:structured", FILE_STRUCT), ("bsi:component:filename", "path")]
FILE_NODE = ob(
    ("type", js("'file'")), ("bom-ref", js(f"'urn:fleetrisk:file:' || {short('sha256', 'path')}")), ("name", js("path")), ("hashes", sql_hashes("sha256", "sha384", "sha512")),
    ("properties", lst(prop("fleetrisk:role", "role"), prop("fleetrisk:size", "size::VARCHAR"), *[prop(n, v) for n, v in FILE_PROPS])),
)
LIB_NODE = ob(("type", js("'library'")), ("bom-ref", js("'urn:fleetrisk:op-domain:' || domain")), ("name", js("domain")), ("properties", lst(prop("fleetrisk:role", "'custom-operator-domain'"))))
VULN_NODE = ob(
    ("id", js("fn.id")), ("source", ob(("name", js("'fleetrisk'")))), ("ratings", lst(ob(("severity", js("lower(fn.severity)")), ("method", js("'other'"))))),
    ("description", js("fn.title || ' — ' || fn.description")), ("affects", lst(ob(("ref", js(MODEL_REF))))),
)
LIC_NODE = ob(("license", ob(("id", js("nullif(spdx_id, '')")), ("name", js("CASE WHEN spdx_id = '' THEN raw END")))))
REF_NODE = ob(
    ("type", js("'machine-learning-model'")), ("name", js("coalesce(name, '')")),
    ("externalReferences", some(lst(opt("url IS NOT NULL", ob(("type", js("'vcs'")), ("url", js("url")))), opt("doi IS NOT NULL", ob(("type", js("'other'")), ("url", js("'https://doi.org/' || doi"))))))),
)
IO_IN = opt("c_ins", """'[{"format":"F32[1]"},{"format":"F32[1]"}]'""").replace("c_ins", "ins IS NOT NULL")
IO_OUT = opt("outs IS NOT NULL", """'[{"format":"F32[1]"}]'""")
CARD = some(
    ob(
        ("modelParameters", some(ob(("architectureFamily", js("architecture")), ("modelArchitecture", js("architecture")), ("datasets", pick("dsn")), ("inputs", IO_IN), ("outputs", IO_OUT)))),
        ("properties", some(lst(prop("fleetrisk:quantization", "quantization"), BARE("hyn")))),
    )
)
COMPONENT = ob(
    ("type", js("'machine-learning-model'")), ("bom-ref", js(MODEL_REF)), ("name", js("name")), ("version", js("version")),
    ("purl", js("CASE WHEN repo_url IS NOT NULL THEN 'pkg:huggingface/o/' || regexp_extract(repo_url, '[0-9]+$') END")), ("description", js("description")), ("publisher", js("author")),
    ("supplier", opt("coalesce(organization, author) IS NOT NULL", ob(("name", js("coalesce(organization, author)"))))), ("licenses", pick("lin")), ("hashes", sql_hashes("p256", "p384", "p512")),
    ("externalReferences", some(lst(opt("url IS NOT NULL", ob(("type", js("'website'")), ("url", js("url")))), opt("repo_url IS NOT NULL", ob(("type", js("'vcs'")), ("url", js("repo_url")))),
        opt("doi IS NOT NULL", ob(("type", js("'other'")), ("url", js("'https://doi.org/' || substr(doi, 5)"))))))),
    ("modelCard", CARD), ("pedigree", opt(f"{pick('rfn')} IS NOT NULL", ob(("ancestors", pick("rfn"))))),
    ("properties", lst(prop("fleetrisk:format", "format"), prop("fleetrisk:framework", "framework"), prop("fleetrisk:uuid", "uuid"), prop("fleetrisk:producer", "producer"), prop("bsi:component:executable", PL.EXECUTABLE),
        prop("bsi:component:archive", "'no archive'"), prop("bsi:component:structured", "'structured'"), prop("bsi:component:filename", "pp"), prop("fleetrisk:primaryFile", "pp"), prop("fleetrisk:size", "psize::VARCHAR"),
        prop("fleetrisk:measuredParameters", "CASE WHEN mp > 0 THEN mp::VARCHAR END"))),
)
CDX_DOC = ob(
    ("bomFormat", js("'CycloneDX'")), ("specVersion", js("'1.6'")), ("serialNumber", js("'urn:uuid:' || " + uuid("coalesce(p256, '') || name"))), ("version", "'1'"),
    ("metadata", ob(("timestamp", js(f"'{NOW}'")), ("tools", ob(("components", lst(ob(("type", js("'application'")), ("name", js("'fleetrisk'")), ("version", js("'1.0'"))))))),
        ("component", COMPONENT), ("lifecycles", lst(ob(("phase", js("'post-build'"))))))),
    ("components", pick("cpn")), ("vulnerabilities", pick("vun")),
)
CDX_SQL = _doc_sql(
    ", cp AS (SELECT cf.artifact_id, 0 AS k, path, " + FILE_NODE + " AS j FROM cf JOIN q USING (artifact_id) WHERE role <> 'primary' UNION ALL SELECT artifact_id, 1, domain, " + LIB_NODE + " FROM dom)"
    + agg("cpn", "cp", "j", "k, path")
    + agg("vun", "fn JOIN q USING (artifact_id)", VULN_NODE, "ord", "fn.artifact_id")
    + agg("lin", "(SELECT * FROM li WHERE spdx_id <> '' OR raw <> '')", LIC_NODE, "ord")
    + agg("dsn", "ds", ob(("type", js("'dataset'")), ("name", js("name"))), "ord")
    + agg("hyn", "hy", ob(("name", js("'hyperparameter:' || name")), ("value", js("value"))), "name")
    + agg("rfn", "rf", REF_NODE, "ord")
    + ", ps AS (SELECT artifact_id, arg_min(size, struct_pack(a := role <> 'primary', b := path)) AS psize FROM cf GROUP BY 1)"
    + f" SELECT q.artifact_id, {CDX_DOC} AS document FROM q LEFT JOIN ps USING (artifact_id)"
)

RANK = "CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"
NS = "'https://spdx.org/spdxdocs/fleetrisk/' || " + uuid("coalesce(p256, '') || name")


def spdx_node(kind, spdx_id, *fields):
    return ob(("type", js(f"'{kind}'")), ("spdxId", js(spdx_id)), ("creationInfo", js("'_:creationinfo'")), *fields)


def spdx_hashes(p256, p384, p512):
    return some(lst(*[opt(f"{v} <> ''", ob(("type", js("'Hash'")), ("algorithm", js(f"'sha{b}'")), ("hashValue", js(v)))) for b, v in ((256, p256), (384, p384), (512, p512))]))


def relation(local, kind, to):
    return spdx_node("Relationship", f"ns || '#' || {local}", ("from", js("ns || '#model'")), ("relationshipType", js(f"'{kind}'")), ("to", to))


def dictionary(key, value):
    return opt(f"({value}) IS NOT NULL", ob(("type", js("'DictionaryEntry'")), ("key", js(key)), ("value", js(value))))


FILE_LOCAL = short("sha256", "path")
MAKER = "coalesce(organization, author)"
SIGNATURE = "CASE WHEN ins IS NOT NULL OR outs IS NOT NULL THEN 'in(' || coalesce(regexp_replace(ins, 'F32', 'x:F32[1]', 'g'), '') || ') -> out(' || coalesce(regexp_replace(outs, 'F32', 'x:F32[1]', 'g'), '') || ')' END"
TOOL_ID = lst(js("ns || '#tool'"))
SPDX_GRAPH = lst(
    spdx_node("SpdxDocument", "ns || '#document'", ("name", js("name || ' bill of materials'")), ("profileConformance", """'["core","software","ai","dataset","simpleLicensing"]'"""), ("rootElement", lst(js("ns || '#model'")))),
    ob(("type", js("'CreationInfo'")), ("@id", js("'_:creationinfo'")), ("specVersion", js("'3.0.1'")), ("created", js(f"'{NOW}'")), ("createdBy", TOOL_ID), ("createdUsing", TOOL_ID)),
    spdx_node("Tool", "ns || '#tool'", ("name", js("'fleetrisk 1.0'"))),
    opt(f"{MAKER} IS NOT NULL", spdx_node("Organization", "ns || '#supplier'", ("name", js(MAKER)))),
    spdx_node("ai_AIPackage", "ns || '#model'", ("name", js("name")), ("software_primaryPurpose", js("'other'")), ("software_downloadLocation", js("coalesce(url, repo_url, 'NOASSERTION')")), ("software_packageVersion", js("version")),
        ("suppliedBy", opt(f"{MAKER} IS NOT NULL", js("ns || '#supplier'"))), ("description", js("description")), ("ai_typeOfModel", opt("architecture IS NOT NULL", lst(js("architecture")))),
        ("ai_hyperparameter", some(lst(dictionary("'quantization'", "quantization"), dictionary("'measuredParameters'", "CASE WHEN mp > 0 THEN mp::VARCHAR END"), dictionary("'inputOutputSignature'", SIGNATURE), BARE("hyn"), dictionary("'primaryFile'", "pp")))),
        ("verifiedUsing", opt("p256 <> ''", spdx_hashes("p256", "p384", "p512"))), ("ai_limitation", js("(SELECT l FROM lim WHERE lim.artifact_id = q.artifact_id)"))),
    BARE("fin"), BARE("dsn"), BARE("rfn"),
    opt("license IS NOT NULL", spdx_node("simplelicensing_LicenseExpression", "ns || '#license'", ("simplelicensing_licenseExpression", js("license")))),
    BARE("rel"),
    opt(f"{pick('dsi')} IS NOT NULL", relation("'rel-trainedon'", "trainedOn", pick("dsi"))),
    opt(f"{pick('rfi')} IS NOT NULL", relation("'rel-ancestry'", "descendantOf", pick("rfi"))),
    opt("license IS NOT NULL", relation("'rel-license'", "hasDeclaredLicense", lst(js("ns || '#license'")))),
)
DS_ID, RF_ID = "ns || '#dataset-' || ds.name || '-' || ds.ord", "ns || '#basemodel-' || coalesce(nullif(regexp_replace(rf.name, '[^A-Za-z0-9._-]', '-', 'g'), ''), 'x') || '-' || rf.ord"
SPDX_SQL = _doc_sql(
    f", qn AS (SELECT q.*, {NS} AS ns FROM q)"
    + agg("fin", "cf JOIN qn USING (artifact_id) WHERE role <> 'primary'", spdx_node("software_File", f"ns || '#file-' || {FILE_LOCAL}", ("name", js("path")), ("verifiedUsing", spdx_hashes("sha256", "sha384", "sha512"))), "path", "cf.artifact_id")
    + agg("rel", "cf JOIN qn USING (artifact_id) WHERE role <> 'primary'", relation(f"'rel-file-' || {FILE_LOCAL}", "contains", lst(js(f"ns || '#file-' || {FILE_LOCAL}"))), "path", "cf.artifact_id")
    + agg("dsn", "ds JOIN qn USING (artifact_id)", spdx_node("dataset_DatasetPackage", DS_ID, ("name", js("ds.name")), ("dataset_datasetType", """'["other"]'"""), ("software_downloadLocation", js("'NOASSERTION'"))), "ord", "ds.artifact_id")
    + agg("dsi", "ds JOIN qn USING (artifact_id)", js(DS_ID), "ord", "ds.artifact_id")
    + agg("rfn", "rf JOIN qn USING (artifact_id)", spdx_node("ai_AIPackage", RF_ID, ("name", js("rf.name")), ("software_downloadLocation", js("coalesce(rf.url, 'NOASSERTION')"))), "ord", "rf.artifact_id")
    + agg("rfi", "rf JOIN qn USING (artifact_id)", js(RF_ID), "ord", "rf.artifact_id")
    + agg("hyn", "hy", dictionary("name", "value"), "name")
    + f", lim AS (SELECT artifact_id, string_agg('[' || severity || '] ' || id || ': ' || title, chr(10) ORDER BY {RANK}, ord) AS l FROM fn GROUP BY 1)"
    + f""" SELECT artifact_id, {ob(("@context", js("'https://spdx.org/rdf/3.0.1/spdx-context.jsonld'")), ("@graph", SPDX_GRAPH))} AS document FROM qn q"""
)

LEVEL = "CASE severity WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' WHEN 'Low' THEN 'note' ELSE 'none' END"
SCORE = "CASE severity WHEN 'High' THEN '7.5' WHEN 'Medium' THEN '5.0' WHEN 'Low' THEN '2.0' ELSE '0.0' END"
RULE_NODE = ob(
    ("id", js("id")), ("name", js("'Ar' || split_part(id,'-',2) || split_part(id,'-',3)")), ("shortDescription", ob(("text", js("title")))), ("fullDescription", ob(("text", js("description")))),
    ("defaultConfiguration", ob(("level", js(LEVEL)))), ("properties", ob(("tags", lst(js("'fleetrisk'"), js("category"), opt("category = 'drift'", js("'supply-chain'")))), ("security-severity", js(SCORE)))),
)
RESULT_NODE = ob(
    ("ruleId", js("fn.id")), ("level", js(LEVEL)), ("message", ob(("text", js("fn.description")))), ("locations", lst(ob(("physicalLocation", ob(("artifactLocation", ob(("uri", js("location"))))))))),
    ("partialFingerprints", ob(("fleetriskFinding/v1", js(f"({short('p256', 'name')}) || ':' || fn.id")))),
)
SARIF_DOC = ob(
    ("$schema", js(f"'{SA.SCHEMA}'")), ("version", js("'2.1.0'")),
    ("runs", lst(ob(("tool", ob(("driver", ob(("name", js("'fleetrisk'")), ("version", js("'1.0'")), ("rules", f"coalesce({pick('run')}, '[]')"))))),
        ("artifacts", lst(ob(("location", ob(("uri", js("coalesce(pp, 'model')")))), ("hashes", some(ob(("sha256", js("p256")), ("sha384", js("p384")), ("sha512", js("p512")))))))),
        ("invocations", lst(ob(("executionSuccessful", "'true'"), ("endTimeUtc", js(f"'{NOW}'"))))), ("results", f"coalesce({pick('ren')}, '[]')")))),
)
SARIF_SQL = _doc_sql(
    agg("run", f"(SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY artifact_id, id ORDER BY {RANK}, ord) = 1)", RULE_NODE, f"{RANK}, id")
    + agg("ren", "fn JOIN q USING (artifact_id)", RESULT_NODE, f"{RANK}, fn.id, ord", "fn.artifact_id")
    + f" SELECT artifact_id, {SARIF_DOC} AS document FROM q"
)

ORACLES = {
    "ingest_clamav": f"""SELECT 'm' || {OKEY} AS artifact_id, 1 AS ord, 'Win.' || o_orderstatus AS id, 'Malware signature match' AS title, 'Critical' AS severity, 'malware' AS category, '/d/' || {OKEY} || '.bin' AS location, 'signature Win.' || o_orderstatus AS description FROM orders
      UNION ALL SELECT 'm' || {OKEY}, 4, 'b: c', 'Malware signature match', 'Critical', 'malware', 'a', 'signature b: c' FROM orders WHERE o_orderstatus = 'F'""",
    "ingest_trivy": f"""SELECT 'm' || {OKEY} AS artifact_id, 0 AS ord, 'CVE-' || {OKEY} AS id, CASE o_orderstatus WHEN 'P' THEN 'known' ELSE 'CVE-' || {OKEY} || ' in p' END AS title, {PRIORITY} AS severity, 'cve' AS category, 't' || {OKEY} AS location,
        'p 1 is affected' || CASE o_orderstatus WHEN 'F' THEN '; fixed in 2' ELSE '' END AS description FROM orders
      UNION ALL SELECT 'm' || {OKEY}, 1000000000, 'r' || {OKEY}, 'sec', 'Medium', 'secret', 't' || {OKEY}, 'a secret pattern matched' FROM orders""",
    "ingest_grype": f"""SELECT 'm' || {OKEY} AS artifact_id, 0 AS ord, 'G-' || {OKEY} AS id, 'G-' || {OKEY} || ' in pkg' AS title, {PRIORITY} AS severity, 'cve' AS category, CASE o_orderstatus WHEN 'F' THEN '/p1' ELSE 'pkg' END AS location,
        CASE WHEN o_custkey % 700 > 512 THEN repeat('x', 512) || '...' ELSE repeat('x', o_custkey % 700) END AS description FROM orders""",
    "ingest_trufflehog": f"""SELECT 'm' || {OKEY} AS artifact_id, 1 AS ord, 'D' || {OKEY} AS id, 'D' || {OKEY} || ' credential' AS title, CASE o_orderstatus WHEN 'F' THEN 'Critical' ELSE 'High' END AS severity, 'secret' AS category,
        'f.py' || CASE WHEN o_custkey % 3 > 0 THEN ':' || (o_custkey % 3) ELSE '' END AS location, CASE o_orderstatus WHEN 'F' THEN 'the credential is live' ELSE 'a credential pattern matched' END AS description FROM orders""",
    "ingest_native": f"""SELECT 'm' || {OKEY} AS artifact_id, 0 AS ord, 'N-' || {OKEY} AS id, 'n' AS title, 'Low' AS severity, 'drift' AS category, 'l' AS location, '' AS description FROM orders
      UNION ALL SELECT 'm' || {OKEY}, 1, 'M', '', 'High', '', '', '' FROM orders""",
    "ingest_spdx_sbom": f"SELECT 'm' || {OKEY} AS artifact_id, 'syft-spdx' AS format, 'parsed' AS state FROM orders",
    "ingest_dispatch": f"""SELECT 'm' || {OKEY} AS artifact_id, 'scan' AS scanner, format, CASE WHEN o_orderpriority = '5-LOW' THEN 'absent' WHEN format = 'mystery' THEN 'error' WHEN o_orderpriority = '3-MEDIUM' AND format NOT IN ('clamav', 'trufflehog-json') THEN 'error' ELSE 'parsed' END AS state,
        CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN format = 'mystery' THEN 'unknown format mystery' WHEN o_orderpriority = '3-MEDIUM' AND format NOT IN ('clamav', 'trufflehog-json') THEN 'malformed report' END AS detail,
        CASE WHEN format = 'native' AND o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END END AS produced
      FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN 'clamav' WHEN 1 THEN 'trivy-json' WHEN 2 THEN 'grype-json' WHEN 3 THEN 'trufflehog-json' WHEN 4 THEN 'native' WHEN 5 THEN 'syft-spdx' ELSE 'mystery' END AS format FROM orders)""",
    "ingest_findings": f"""WITH o AS (SELECT *, 'm' || {OKEY} AS a, o_orderkey % 7 AS f, {PRIORITY} AS p FROM orders WHERE o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED'))
      SELECT a AS artifact_id, 'Win.' || o_orderstatus AS id, 'Critical' AS severity, 'malware' AS category FROM o WHERE f = 0 UNION ALL SELECT a, 'b: c', 'Critical', 'malware' FROM o WHERE f = 0 AND o_orderstatus = 'F'
      UNION ALL SELECT a, 'CVE-' || {OKEY}, p, 'cve' FROM o WHERE f = 1 UNION ALL SELECT a, 'r' || {OKEY}, 'Medium', 'secret' FROM o WHERE f = 1 UNION ALL SELECT a, 'G-' || {OKEY}, p, 'cve' FROM o WHERE f = 2
      UNION ALL SELECT a, 'D' || {OKEY}, CASE o_orderstatus WHEN 'F' THEN 'Critical' ELSE 'High' END, 'secret' FROM o WHERE f = 3 UNION ALL SELECT a, 'N-' || {OKEY}, 'Low', 'drift' FROM o WHERE f = 4 UNION ALL SELECT a, 'M', 'High', '' FROM o WHERE f = 4""",
    "bom_detect": """SELECT 'd' || c_custkey AS doc_id, CASE c_nationkey % 5 WHEN 0 THEN 'cyclonedx' WHEN 1 THEN 'spdx' WHEN 4 THEN 'cyclonedx' END AS kind, CASE c_nationkey % 5 WHEN 2 THEN 'not a bill of materials' WHEN 3 THEN 'not JSON' END AS error FROM customer""",
    "bom_read_cyclonedx": """WITH c AS (SELECT 'd' || c_custkey AS doc_id, 'CycloneDX 1.6' AS format, c_name AS model_name, CASE c_nationkey % 2 WHEN 0 THEN '1' END AS version, CASE c_nationkey % 3 WHEN 0 THEN 'llama' END AS architecture,
        'Q4' AS quantization, c_custkey::VARCHAR AS parameters, c_custkey FROM customer WHERE c_nationkey % 5 IN (0, 4))
      SELECT * EXCLUDE (c_custkey), 'w.gguf' AS path, 'aa' || c_custkey AS sha256, NULL AS sha384, NULL::BIGINT AS size FROM c UNION ALL SELECT * EXCLUDE (c_custkey), 's' || c_custkey, NULL, 'bb', c_custkey FROM c""",
    "bom_read_spdx": """WITH c AS (SELECT 'd' || c_custkey AS doc_id, 'SPDX 3.0.1' AS format, c_name AS model_name, '2' AS version, 'bert' AS architecture, 'Q8' AS quantization, NULL::VARCHAR AS parameters, c_custkey FROM customer WHERE c_nationkey % 5 = 1)
      SELECT * EXCLUDE (c_custkey), 'w.onnx' AS path, NULL AS sha256, 'dd' || c_custkey AS sha384, NULL::BIGINT AS size FROM c UNION ALL SELECT * EXCLUDE (c_custkey), 's' || c_custkey, 'cc', NULL, NULL FROM c""",
    "sidecar_config": """SELECT 'm' || c_custkey AS artifact_id, 'config.json' AS declared_source, CASE c_nationkey % 3 WHEN 0 THEN 'A' || c_custkey ELSE 'llama' END AS declared_architecture, CASE c_nationkey % 2 WHEN 0 THEN 'bfloat16' ELSE 'float16' END AS declared_dtype,
        CASE c_nationkey % 4 WHEN 0 THEN 'gptq-4bit' WHEN 1 THEN 'awq' END AS declared_quantization, CASE c_nationkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN '7B' WHEN 2 THEN '1500000000' END AS declared_parameter_count FROM customer WHERE c_nationkey % 9 < 7""",
    "sidecar_index": """SELECT 'm' || o_orderkey AS artifact_id, 's1-' || o_orderstatus AS path FROM orders UNION ALL SELECT 'm' || o_orderkey, 's2-' || o_custkey FROM orders""",
    "sidecar_card": """SELECT 'm' || c_custkey AS artifact_id, 'README.md' AS declared_source, 'mit' AS license, 'org/m' || c_custkey || ',b' AS base_model, 'org/d' AS datasets, CASE c_nationkey % 2 WHEN 0 THEN 'text:gen' END AS task, 'tf' AS library FROM customer WHERE c_nationkey % 5 < 3""",
    "card_references": """SELECT 'm' || c_custkey AS artifact_id, unnest(['base_model', 'base_model', 'dataset']) AS kind, unnest(['org/m' || c_custkey, 'b', 'org/d']) AS name, unnest(['https://huggingface.co/org/m' || c_custkey, NULL, 'https://huggingface.co/datasets/org/d']) AS url FROM customer WHERE c_nationkey % 5 < 3""",
    "header_safetensors": """SELECT 'm' || p_partkey AS artifact_id, 0 AS ord, 'a' AS name, 'BF16' AS dtype, '' AS shape FROM part WHERE p_size % 6 IN (3, 4) UNION ALL SELECT 'm' || p_partkey, 1, 'b.' || p_brand, 'F32', p_size || 'x2' FROM part WHERE p_size % 6 IN (3, 4)""",
    "header_findings": """SELECT 'm' || p_partkey AS artifact_id, '__metadata__.format' AS what, 'pt' AS detail FROM part WHERE p_size % 6 IN (3, 4)
      UNION ALL SELECT 'm' || p_partkey, CASE p_size % 6 WHEN 2 THEN 'AR-ST-001' WHEN 5 THEN 'AR-ST-003' ELSE 'AR-ST-002' END, CASE WHEN p_size % 6 IN (0, 1) THEN 'High' ELSE 'Medium' END FROM part WHERE p_size % 6 IN (0, 1, 2, 5)""",
    "file_inventory": T.with_ctes(
        """SELECT artifact_id, path, size, nullif(lower(regexp_extract(path, '(\\.[^.]*)$', 1)), '') AS extension, CASE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) WHEN '.gguf' THEN 'gguf' WHEN '.safetensors' THEN 'safetensors'
        WHEN '.onnx' THEN 'onnx' WHEN '.pkl' THEN 'pickle' WHEN '.h5' THEN 'keras' END AS format, count(*) OVER (PARTITION BY artifact_id) > 45 AS truncated FROM f QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY path) <= 45""",
        f=T.FILES,
    ),
    "format_detect": T.with_ctes(
        "SELECT artifact_id, path, CASE WHEN head = '47475546' THEN 'gguf' WHEN doc_id % 6 = 1 THEN 'onnx' WHEN doc_id % 6 IN (2, 5) THEN 'safetensors' ELSE 'gguf' END AS format FROM d WHERE doc_id % 6 <> 4", d=DETECT
    ),
    "emit_cyclonedx": CDX_SQL,
    "emit_spdx": SPDX_SQL,
    "emit_sarif": SARIF_SQL,
    "emit_cyclonedx_stream": CDX_SQL,
    "emit_spdx_stream": SPDX_SQL,
    "emit_sarif_stream": SARIF_SQL,
}
ORACLES["bom_detect_ranges"] = ORACLES["bom_detect"]
ORACLES["bom_read_ranges"] = f"SELECT {{shown}} FROM ({ORACLES['bom_read_cyclonedx']}) UNION ALL SELECT {{shown}} FROM ({ORACLES['bom_read_spdx']})".format(
    shown="doc_id, format, model_name, version, architecture, quantization, parameters, path, sha256, sha384, size"
)
