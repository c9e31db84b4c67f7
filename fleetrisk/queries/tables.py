"""The given tables seen through the engine's schemas.

The given tables hold no model files, so these texts project whole tables into the schemas the
operators take. They use only SQL that Spark and DuckDB read alike: a table is written ``{orders}``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

FINDINGS = """
SELECT 'm' || CAST(o_custkey AS STRING) AS artifact_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'trivy' WHEN 1 THEN 'model-inspector' ELSE 'aibom' END AS scanner,
       o_orderkey AS ord,
       'AR-' || o_orderstatus || '-' || CAST(o_orderkey % 7 AS STRING) AS id,
       'order ' || o_orderstatus AS title,
       substr(o_orderpriority, 3) AS severity,
       CASE o_orderstatus WHEN 'F' THEN 'drift' WHEN 'O' THEN 'model' ELSE 'cve' END AS category,
       'part' || CAST(o_orderkey % 4 AS STRING) AS location,
       'order of ' || CAST(o_custkey AS STRING) AS description
FROM {orders}
"""

SCANNER_RESULTS = f"""
SELECT 'm' || CAST(o_custkey AS STRING) AS artifact_id,
       CASE o_orderkey % 9 WHEN 0 THEN 'clamav' WHEN 1 THEN 'trivy' WHEN 2 THEN 'grype' WHEN 3 THEN 'syft'
            WHEN 4 THEN 'trufflehog' WHEN 5 THEN 'model-inspector' WHEN 6 THEN 'provenance'
            WHEN 7 THEN 'aibom' ELSE 'house-scanner-' || o_orderstatus END AS scanner,
       CASE o_orderstatus WHEN 'F' THEN 'Passed' WHEN 'O' THEN 'Failed'
            ELSE CASE o_orderkey % 5 WHEN 0 THEN 'Running' ELSE 'Skipped' END END AS status,
       CASE WHEN o_orderstatus = 'O' THEN {CENTS} % 3 ELSE 0 END AS findings,
       CASE WHEN o_orderpriority = '1-URGENT' THEN {CENTS} % 3 ELSE 0 END AS critical,
       CASE WHEN o_orderstatus = 'O' THEN {CENTS} % 4 ELSE 0 END AS high,
       {CENTS} % 5 AS medium,
       {CENTS} % 7 AS low,
       CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS unknown,
       CASE WHEN o_orderpriority = '2-HIGH' THEN {CENTS} % 2 ELSE 0 END AS drift_critical,
       CASE WHEN o_orderpriority = '2-HIGH' THEN {CENTS} % 3 ELSE 0 END AS drift_high,
       {CENTS} % 2 AS drift_medium,
       {CENTS} % 4 AS drift_low,
       0 AS drift_unknown,
       CASE WHEN o_orderkey % 9 <> 7 THEN NULL ELSE {CENTS} % 2 = 0 END AS produced
FROM {{orders}}
"""

ARTIFACTS = """
SELECT 'm' || CAST(c_custkey AS STRING) AS artifact_id,
       CASE c_nationkey % 4 WHEN 0 THEN 'GGUF' WHEN 1 THEN 'safetensors' WHEN 2 THEN 'Pickle' ELSE '' END AS format,
       c_mktsegment AS policy_id
FROM {customer}
"""

RULES = """
SELECT policy_id,
       CASE policy_id WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS max_critical_cves,
       CASE policy_id WHEN 'BUILDING' THEN 3 WHEN 'FURNITURE' THEN 1 END AS max_high_cves,
       CASE policy_id WHEN 'FURNITURE' THEN false END AS block_malware,
       CASE policy_id WHEN 'MACHINERY' THEN false WHEN 'BUILDING' THEN true END AS block_secrets,
       CASE policy_id WHEN 'MACHINERY' THEN false END AS block_unsafe_model,
       CASE policy_id WHEN 'HOUSEHOLD' THEN true WHEN 'BUILDING' THEN false END AS block_model_drift,
       CASE policy_id WHEN 'HOUSEHOLD' THEN true END AS require_signature,
       CASE policy_id WHEN 'BUILDING' THEN true END AS require_provenance,
       CASE policy_id WHEN 'MACHINERY' THEN true END AS require_sbom,
       CASE policy_id WHEN 'FURNITURE' THEN true END AS require_aibom,
       CASE policy_id WHEN 'BUILDING' THEN split('gguf,safetensors', ',') END AS allowed_formats,
       CASE policy_id WHEN 'FURNITURE' THEN split('PICKLE', ',') END AS blocked_formats
FROM (SELECT DISTINCT c_mktsegment AS policy_id FROM {customer} WHERE c_mktsegment <> 'AUTOMOBILE') s
"""

EXCEPTIONS = """
SELECT 'm' || CAST(o_custkey AS STRING) AS artifact_id,
       CASE WHEN o_orderstatus <> 'P' THEN split('noSuchRule', ',')
            WHEN o_orderpriority = '1-URGENT' THEN split('blockSecrets,maxHighCVEs', ',')
            WHEN o_orderpriority = '2-HIGH' THEN split('scanIncomplete', ',')
            ELSE split('blockModelDrift,noSuchRule', ',') END AS rules,
       'accepted' AS reason,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderdate END AS expires_at
FROM {orders}
"""

TENSORS = """
SELECT 'm' || CAST(l_orderkey AS STRING) AS artifact_id,
       l_linenumber * 1000000 + l_partkey AS ord,
       'layer.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS name,
       CASE l_returnflag WHEN 'A' THEN 'F32' WHEN 'N' THEN 'BF16' ELSE 'Q8_0' END AS dtype,
       l_partkey - 2 AS rows_dim,
       CAST(floor(l_quantity) AS BIGINT) AS cols_dim
FROM {lineitem}
"""

FILES = """
SELECT source AS artifact_id,
       lang || '-' || CAST(doc_id AS STRING) || CASE doc_id % 11
         WHEN 0 THEN '.gguf' WHEN 1 THEN '.safetensors' WHEN 2 THEN '.onnx' WHEN 3 THEN '.bin' WHEN 4 THEN '.pkl'
         WHEN 5 THEN '.py' WHEN 6 THEN '.json' WHEN 7 THEN '.H5' WHEN 8 THEN '.so' WHEN 9 THEN '.sh' ELSE '' END AS path,
       text,
       CAST(length(text) AS BIGINT) AS size
FROM {documents}
"""


RAW_KV = """
SELECT 'm' || CAST(c_custkey AS STRING) AS artifact_id, 'general.name' AS key, c_name AS value FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.architecture',
  CASE c_nationkey % 4 WHEN 0 THEN 'llama' WHEN 1 THEN 'qwen2' WHEN 2 THEN 'bert' ELSE '' END FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.file_type', CAST(c_nationkey * 2 AS STRING) FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.quantization_version', CAST(c_nationkey % 3 AS STRING) FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.license',
  CASE c_mktsegment WHEN 'BUILDING' THEN 'apache 2.0' WHEN 'MACHINERY' THEN 'llama3' WHEN 'FURNITURE' THEN 'House Terms/1' ELSE '' END FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.license.name', CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'mit' ELSE '' END FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.repo_url', 'https://huggingface.co/org' || CAST(c_nationkey AS STRING) || '/model' FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.size_label', CAST(c_nationkey AS STRING) || 'B' FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'general.alignment', CAST(c_custkey AS STRING) FROM {customer}
UNION ALL SELECT 'm' || CAST(c_custkey AS STRING), 'tokenizer.chat_template',
  CASE c_mktsegment WHEN 'BUILDING' THEN '{% if x %}' WHEN 'MACHINERY' THEN '{' || '{ x }}' WHEN 'FURNITURE' THEN '{' || '{ x.__class__ }}' ELSE 'plain' END FROM {customer}
UNION ALL SELECT 'm' || CAST(o_custkey AS STRING), 'llama.block.' || CAST(o_orderkey AS STRING), o_orderstatus FROM {orders}
UNION ALL SELECT 'm' || CAST(o_custkey AS STRING), 'llama.vocab_size.' || CAST(o_orderkey AS STRING), '32000' FROM {orders}
UNION ALL SELECT 'm' || CAST(o_custkey AS STRING),
  'general.base_model.' || CAST(o_orderkey AS STRING) || CASE o_orderstatus WHEN 'F' THEN '.name' WHEN 'O' THEN '.repo_url' ELSE '.organization' END,
  CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE 'base' || CAST(o_custkey AS STRING) END FROM {orders}
UNION ALL SELECT 'm' || CAST(o_custkey AS STRING), 'general.base_model.' || CAST(o_orderkey AS STRING) || '.doi',
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '10.1/' || CAST(o_orderkey AS STRING) ELSE '' END FROM {orders}
"""

DRIFT_ROWS = f"""
SELECT 'm' || CAST(o_orderkey AS STRING) AS artifact_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'gguf' WHEN 1 THEN 'safetensors' ELSE 'onnx' END AS format,
       'weights.' || o_orderstatus AS primary_path,
       CASE o_custkey % 2 WHEN 0 THEN 'config.json' ELSE '' END AS declared_source,
       CASE o_custkey % 4 WHEN 0 THEN 'LlamaForCausalLM' WHEN 1 THEN 'Qwen2ForCausalLM' WHEN 2 THEN '' ELSE 'BertModel' END AS declared_architecture,
       CASE o_orderstatus WHEN 'F' THEN 'llama' WHEN 'O' THEN 'qwen2' ELSE '' END AS architecture,
       CASE o_custkey % 5 WHEN 0 THEN 'bfloat16' WHEN 1 THEN 'Float16' WHEN 2 THEN 'float32' WHEN 3 THEN '' ELSE 'I8' END AS declared_dtype,
       CASE o_orderkey % 4 WHEN 0 THEN 'BF16' WHEN 1 THEN 'F16' WHEN 2 THEN 'f32' ELSE '' END AS dtype,
       CASE o_custkey % 3 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN ' q4_k_m ' ELSE '' END AS declared_quantization,
       CASE o_orderkey % 3 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'Q8_0' ELSE '' END AS quantization,
       CASE o_custkey % 7 WHEN 0 THEN CAST({CENTS} AS STRING) WHEN 1 THEN '30M' WHEN 2 THEN '22,000_000' WHEN 3 THEN 'large'
         WHEN 4 THEN '-3B' WHEN 5 THEN ' 0.02b ' ELSE '' END AS declared_parameter_count,
       CASE o_orderstatus WHEN 'F' THEN '25M' ELSE '' END AS size_label,
       {CENTS} AS measured_parameters,
       CAST(o_custkey % 4 AS INT) AS declared_shards,
       CAST(o_orderkey % 4 AS INT) AS present_shards,
       CAST(o_orderkey % 2 AS INT) AS peer_count,
       'a.bin' AS first_peer
FROM {{orders}}
"""

PRICED_ORDERS = """
SELECT 'm' || CAST(o_orderkey AS STRING) AS artifact_id, 'onnx' AS format, 'orders' AS declared_source,
       CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS declared_parameter_count,
       measured_parameters
FROM {orders} JOIN (
  SELECT l_orderkey, CAST(floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)
         * (100 - CAST(round(l_discount * 100) AS BIGINT)) * (100 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / 1000000.0) AS BIGINT)
         AS measured_parameters
  FROM {lineitem} GROUP BY l_orderkey) x ON o_orderkey = l_orderkey
"""

SHARD_INDEX = """
SELECT 'm' || CAST(l_orderkey AS STRING) AS artifact_id, 'shard-' || CAST(l_linenumber AS STRING) AS path FROM {lineitem}
"""

SHARD_FILES = """
SELECT 'm' || CAST(l_orderkey AS STRING) AS artifact_id, CASE l_returnflag WHEN 'R' THEN 'moved-' ELSE 'shard-' END || CAST(l_linenumber AS STRING) AS path,
       l_partkey * 1024 AS size
FROM {lineitem}
"""


MODEL_FILES = """
SELECT source AS artifact_id, 'd' || CAST(doc_id AS STRING) AS path, SHA256(text) AS sha256,
       CASE WHEN lang = 'de' THEN 'F' || SHA256(text) ELSE '' END AS sha384, CAST(length(text) AS BIGINT) AS size
FROM {documents}
"""

# a document lists the labelled files of its source, some of them wrongly, and some that do not exist
DOC_FILES = """
SELECT 'bom-' || source AS doc_id, 'd' || CAST(d.doc_id AS STRING) AS path,
       CASE WHEN toxic = 1 THEN SHA256(lang) WHEN lang = 'en' THEN upper(SHA256(text)) WHEN lang = 'fr' AND quality = 0 THEN '' ELSE SHA256(text) END AS sha256,
       CASE WHEN lang = 'de' AND quality = 1 THEN 'f' || SHA256(text) ELSE '' END AS sha384,
       CASE WHEN quality = 0 THEN CAST(length(text) + 1 AS BIGINT) WHEN quality = 1 THEN CAST(length(text) AS BIGINT) END AS size
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
UNION ALL
SELECT 'bom-src' || CAST(item_id % 20 AS STRING), 'bench' || CAST(item_id AS STRING), SHA256(text), '', CAST(length(text) AS BIGINT) FROM {benchmark}
"""

DOCS = """
SELECT 'bom-' || source AS doc_id, source AS artifact_id, upper(source) AS model_name,
       CASE WHEN count(*) % 2 = 0 THEN '1.0' ELSE '' END AS version,
       min(lang) AS architecture, CASE WHEN min(doc_id) % 3 = 0 THEN 'Q4' ELSE '' END AS quantization,
       'bf16' AS dtype, CAST(sum(n_chars) AS STRING) AS parameters
FROM {documents} GROUP BY source
"""

MODELS = """
SELECT source AS artifact_id, source AS name, CASE WHEN min(doc_id) % 4 = 0 THEN '1.0' WHEN min(doc_id) % 4 = 1 THEN '2.0' ELSE '' END AS version,
       upper(min(lang)) AS architecture, CASE WHEN min(doc_id) % 2 = 0 THEN 'Q8' ELSE '' END AS quantization,
       '' AS dtype, CAST(sum(n_chars) + min(doc_id) % 2 AS BIGINT) AS measured_parameters
FROM {documents} GROUP BY source
"""

BUNDLE_MEMBERS = """
SELECT source AS manifest_id, doc_id AS ord,
       CASE WHEN lang = 'es' AND doc_id % 9 = 0 THEN '../' ELSE '' END || 'd' || CAST(doc_id AS STRING) AS name,
       CAST(length(text) AS BIGINT) AS size, SHA256(text) AS sha256, SHA256(lang) AS sha512,
       CASE WHEN lang = 'fr' AND doc_id % 7 = 0 THEN 'link' ELSE 'file' END AS kind
FROM {documents}
UNION ALL SELECT DISTINCT source, 120, 'manifest.json', 0, '', '', 'file' FROM {documents} WHERE source <> 'src3'
"""

BUNDLE_ENTRIES = """
SELECT source AS manifest_id, 'd' || CAST(d.doc_id AS STRING) AS path,
       CAST(length(text) + quality AS BIGINT) AS size, CASE WHEN toxic = 1 THEN SHA256(lang) ELSE SHA256(text) END AS sha256, SHA256(lang) AS sha512
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
UNION ALL SELECT 'src' || CAST(item_id % 20 AS STRING), 'bench' || CAST(item_id AS STRING), 1, '', '' FROM {benchmark}
"""

BUNDLE_MANIFESTS = """
SELECT source AS manifest_id, CASE source WHEN 'src5' THEN 2 ELSE 1 END AS format_version,
       CASE source WHEN 'src1' THEN '' ELSE 'rule-pack' END AS kind, CASE source WHEN 'src2' THEN '' ELSE source END AS name,
       CASE source WHEN 'src4' THEN '' ELSE '2026-01-01T00:00:00Z' END AS created_at
FROM (SELECT DISTINCT source FROM {documents} UNION ALL SELECT 'src-empty') s
"""

BUNDLE_SOURCES = """
SELECT source AS manifest_id, lang AS name, CASE WHEN source = 'src6' AND lang = 'en' THEN '' ELSE '2026-01-01' END AS retrieved_at
FROM (SELECT DISTINCT source, lang FROM {documents}) s
"""

COMPONENT_FILES = """
SELECT 'm' || CAST(o_custkey AS STRING) AS artifact_id,
       'f' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 5 WHEN 0 THEN '.safetensors' ELSE '' END AS path,
       CASE o_orderkey % 4 WHEN 0 THEN 'shard' WHEN 1 THEN 'external-data' WHEN 2 THEN 'primary' ELSE 'shard' END AS role,
       o_orderkey + 1 AS size,
       CASE o_orderstatus WHEN 'P' THEN '' ELSE SHA256(o_orderstatus) END AS sha256,
       CASE o_orderstatus WHEN 'F' THEN SHA256(o_orderpriority) ELSE '' END AS sha384,
       CASE o_orderstatus WHEN 'O' THEN SHA256(o_orderpriority) ELSE '' END AS sha512
FROM {orders}
"""

LICENSE_ROWS = """
SELECT 'm' || CAST(o_custkey AS STRING) AS artifact_id, o_orderkey AS ord,
       CASE o_orderkey % 4 WHEN 0 THEN 'house' WHEN 1 THEN '' WHEN 2 THEN 'mit' ELSE 'terms' END AS raw,
       CASE o_orderkey % 8 WHEN 2 THEN 'MIT' ELSE '' END AS spdx_id
FROM {orders}
"""

DATASET_ROWS = """
SELECT 'm' || CAST(o_custkey AS STRING) AS artifact_id, o_orderkey AS ord, 'ds' || CAST(o_orderkey AS STRING) AS name
FROM {orders}
"""

DOMAIN_ROWS = """
SELECT DISTINCT 'm' || CAST(o_custkey AS STRING) AS artifact_id, 'dom' || CAST(o_orderkey % 5 AS STRING) AS domain
FROM {orders}
"""

PROFILES = """
SELECT 'm' || CAST(c_custkey AS STRING) AS artifact_id, c_name AS name,
       CASE c_nationkey % 2 WHEN 0 THEN '1.0' ELSE '' END AS version,
       CASE c_nationkey % 3 WHEN 0 THEN 'dev@example.org' WHEN 1 THEN 'dev' ELSE '' END AS author,
       CASE c_nationkey % 4 WHEN 0 THEN 'org' ELSE '' END AS organization,
       CASE c_nationkey % 5 WHEN 0 THEN 'about' ELSE '' END AS description,
       CASE c_nationkey % 6 WHEN 0 THEN 'uuid-' || CAST(c_custkey AS STRING) ELSE '' END AS uuid,
       CASE c_nationkey % 7 WHEN 0 THEN 'https://example.org/' || CAST(c_custkey AS STRING) ELSE '' END AS url,
       CASE c_nationkey % 5 WHEN 1 THEN 'https://huggingface.co/o/' || CAST(c_custkey AS STRING) ELSE '' END AS repo_url,
       CASE c_nationkey % 8 WHEN 0 THEN 'doi:10.1/' || CAST(c_custkey AS STRING) ELSE '' END AS doi,
       CASE c_nationkey % 3 WHEN 0 THEN 'llama' ELSE '' END AS architecture,
       CASE c_nationkey % 4 WHEN 1 THEN 'Q4_0' ELSE '' END AS quantization,
       CASE c_nationkey % 9 WHEN 0 THEN '' ELSE 'gguf/ggml' END AS framework,
       CASE c_nationkey % 10 WHEN 1 THEN 'maker' ELSE '' END AS producer,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'gguf' WHEN 'MACHINERY' THEN 'onnx' ELSE 'safetensors' END AS format,
       CASE c_nationkey % 2 WHEN 0 THEN 'tpl' ELSE '' END AS chat_template,
       CASE WHEN c_nationkey % 3 = 1 THEN CAST(c_custkey AS BIGINT) END AS measured_parameters,
       c_nationkey
FROM {customer}
"""

EVIDENCE = """
SELECT 'm' || CAST(c_custkey AS STRING) AS artifact_id, c_mktsegment AS profile,
       c_nationkey <> 3 AS scan_complete, CASE c_nationkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' ELSE 'Approved' END AS verdict,
       c_custkey % 2 = 0 AS risk_scored, c_custkey % 3 <> 0 AS security_scanned, c_custkey % 5 <> 0 AS secrets_scanned,
       c_custkey % 7 <> 0 AS sbom_generated, c_custkey % 4 <> 0 AS aibom_generated, c_custkey % 6 = 0 AS signature_verified,
       CASE WHEN c_acctbal > 0 THEN 'p' ELSE '' END AS policy_ref, c_custkey % 8 <> 0 AS inventoried,
       c_custkey % 9 = 0 AS continuous_monitoring, c_custkey % 2 = 1 AS admission_enforcing,
       c_custkey % 3 = 0 AS residual_risks_documented, c_custkey % 11 = 0 AS bias_evaluated
FROM {customer}
"""

ATTESTATIONS = """
SELECT 'm' || CAST(o_custkey AS STRING) AS artifact_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'GOVERN 1.1' WHEN 1 THEN 'MAP 2.1' WHEN 2 THEN 'MEASURE 2.7' WHEN 3 THEN 'MANAGE 1.1' WHEN 4 THEN 'GOVERN 2.1' ELSE 'NO 1' END AS control_id,
       o_orderkey AS ord, CASE o_orderstatus WHEN 'P' THEN ' ' ELSE 'stated' END AS statement,
       CASE o_orderpriority WHEN '1-URGENT' THEN '' ELSE 'person' END AS attested_by,
       CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE o_orderdate END AS expires_at
FROM {orders}
"""

SCOPE = """
SELECT profile, 'GOVERN 2.2' AS control_id, CASE profile WHEN 'BUILDING' THEN ' ' ELSE 'no suppliers' END AS justification
FROM (SELECT DISTINCT c_mktsegment AS profile FROM {customer} WHERE c_mktsegment <> 'HOUSEHOLD') s
"""

SIGNED_FILES = """
SELECT DISTINCT 'm' || CAST(l_orderkey AS STRING) AS artifact_id,
       CASE l_partkey % 14 WHEN 0 THEN 'w.bin' WHEN 1 THEN 'w.bin.sig' WHEN 2 THEN 'w.bin.pem' WHEN 3 THEN 'w.bin.crt' WHEN 4 THEN 'd/Model.sig'
         WHEN 5 THEN 'x.pkl.sigstore.json' WHEN 6 THEN 'x.pkl' WHEN 7 THEN 'y.cosign.bundle' WHEN 8 THEN 'z.SIGSTORE' WHEN 9 THEN 'q.safetensors'
         WHEN 10 THEN '.bundle' WHEN 11 THEN 'd/v.pt' WHEN 12 THEN 'd/v.pt.sig' ELSE 'readme.md' END AS path
FROM {lineitem}
"""

OUTCOMES = """
SELECT 'm' || CAST(o_orderkey AS STRING) AS artifact_id, 's' AS sig_path, o_orderstatus <> 'P' AS valid, o_orderstatus = 'O' AND o_custkey % 4 = 0 AS failed,
       'signer' || CAST(o_custkey AS STRING) AS signer, split('w.bin,x.pkl', ',') AS covered,
       CASE o_custkey % 5 WHEN 0 THEN 'no Matching Certificate found' WHEN 1 THEN 'subject MISMATCH' WHEN 2 THEN 'certificate expired'
         WHEN 3 THEN 'subject only' ELSE 'bad signature' END AS message
FROM {orders}
"""

STATEMENTS = """
SELECT source AS artifact_id, 'model.sig' AS sig_path, CASE WHEN toxic = 1 THEN 'gone' ELSE 'd' END || CAST(d.doc_id AS STRING) AS name,
       CASE WHEN quality = 0 THEN upper(SHA256(text)) WHEN lang = 'de' AND toxic = 0 THEN NULL WHEN lang = 'es' THEN SHA256(lang) ELSE SHA256(text) END AS sha256
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

URIS = "SELECT CAST(page_id AS STRING) AS artifact_id, url AS uri FROM {pages}"

PUBLISHERS = """
SELECT host AS name, CASE WHEN length(host) % 2 = 0 THEN '' ELSE 'Team ' || host END AS display_name,
       CASE WHEN length(host) % 3 = 0 THEN 'issuer' ELSE '' END AS issuer, CASE WHEN length(host) % 3 = 0 THEN 'https://example.org/*' ELSE '' END AS subject,
       CASE WHEN length(host) % 3 = 1 THEN 'PEM' ELSE '' END AS public_key, split('https://' || host || ',http://' || host || '/fr', ',') AS uri_prefixes
FROM (SELECT DISTINCT split_part(url, '/', 3) AS host FROM {pages}) h
UNION ALL SELECT 'any-' || r_name, '', '', '', '', CASE WHEN r_regionkey = 0 THEN NULL ELSE split('http', ',') END FROM {region}
"""

LINKS = """
SELECT page_id, url,
       CASE page_id % 8 WHEN 0 THEN 'HF://org' || CAST(page_id AS STRING) || '/m@Main' WHEN 1 THEN 'https://huggingface.co/org/m' || CAST(page_id AS STRING) || '/tree/dev/'
         WHEN 2 THEN 'https://HuggingFace.co/a/b/c' WHEN 3 THEN 'huggingface://solo' WHEN 4 THEN 'hf://' WHEN 5 THEN 'mlflow-artifacts:/run/' || CAST(page_id AS STRING)
         WHEN 6 THEN 'mlflow-artifacts://host:5000/run/x' ELSE 'S3://Bucket/Key' END AS uri,
       CASE page_id % 3 WHEN 0 THEN 'ABC' ELSE '' END AS commit_id
FROM {pages}
"""


def sql_for_duckdb(text: str) -> str:
    """The same text with table names DuckDB knows."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an adapter text on the parquet files of ``sf_dir``."""
    for name in set(re.findall(r"\{(\w+)\}", text)):
        table(spark, sf_dir, name).createOrReplaceTempView(f"fleetrisk_{name}")
    # the one function whose name differs between the two engines
    text = re.sub(r"SHA256\((\w+)\)", r"sha2(\1, 256)", text)
    return spark.sql(re.sub(r"\{(\w+)\}", r"fleetrisk_\1", text))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over all tasks: a table of few bytes is one split, however much work follows for each row."""
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ctes(body: str, **ctes: str) -> str:
    """Oracle text: adapters as common table expressions, then the body."""
    parts = ", ".join(f"{name} AS ({sql_for_duckdb(text).strip()})" for name, text in ctes.items())
    return f"WITH {parts} {body.strip()}" if parts else body.strip()
