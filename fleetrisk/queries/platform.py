"""Verification, manifests, coverage, controls, provenance and fetch planning over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import controls as K
from ..functions import paths as P
from ..functions import text as S
from ..operators import chunked
from ..operators import compliance as C
from ..operators import coverage as CV
from ..operators import digest as DG
from ..operators import fetch as FE
from ..operators import provenance as PR
from ..operators import verify as VF
from ..sources import chunks
from . import tables as T

NOW = datetime(1998, 1, 1)
KEYS = ["doc_id", "artifact_id"]
FETCH = {"max_files": 40, "max_file_bytes": 3000, "max_total_bytes": 12000, "header_bytes": 500}


# --- verification ----------------------------------------------------------------------------------------
def _docs(s, d):
    claims = F.create_map(
        F.lit("architecture"), "architecture", F.lit("quantization"), "quantization", F.lit("dtype"), "dtype",
        F.lit("measuredParameters"), "parameters", F.lit("other"), F.lit("x"),
    )
    return T.read(s, d, T.DOCS).select(*KEYS, "model_name", "version", claims.alias("properties"))


def _checks(s, d):
    files = T.read(s, d, T.MODEL_FILES)
    return VF.all_checks(_docs(s, d), T.read(s, d, T.DOC_FILES), T.read(s, d, T.MODELS), files)


def bind(s, d):
    summary = VF.verify_summary(_checks(s, d))
    documents = T.read(s, d, T.DOCS).select("doc_id", F.sha2("doc_id", 256).alias("sha256"))
    changed = F.when(F.col("model_name").endswith("7"), "x").otherwise(F.sha2("doc_id", 256))
    records = T.read(s, d, T.DOCS).select(
        F.concat(F.lit("att-"), "doc_id").alias("attestation_id"), "doc_id", "artifact_id",
        changed.alias("document_sha256"),
        (~F.col("model_name").endswith("8")).alias("signed"),
        (~F.col("model_name").endswith("9")).alias("signature_valid"),
    )
    return VF.attestation_bind(records, documents, summary)


# --- coverage ---------------------------------------------------------------------------------------------
def _profiles(s, d):
    artifacts = T.read(s, d, T.PROFILES)
    spec = F.struct(F.lit("x").alias("name"), F.lit("F32").alias("dtype"), F.array(F.lit(1).cast("bigint")).alias("shape"))
    many = F.when(F.col("c_nationkey") % 2 == 0, F.array(spec, spec))
    artifacts = artifacts.withColumns({"inputs": many, "outputs": F.when(F.col("c_nationkey") % 3 == 0, F.array(spec))})
    return CV.profile(
        artifacts,
        T.read(s, d, T.COMPONENT_FILES),
        T.read(s, d, T.LICENSE_ROWS),
        T.read(s, d, T.DATASET_ROWS),
        T.read(s, d, T.DOMAIN_ROWS),
        T.read(s, d, T.FINDINGS).withColumn("id", F.when(F.col("ord") % 50 == 0, "AR-FILE-002").otherwise(F.col("id"))),
    )


def _coverage(standard):
    return lambda s, d: CV.coverage(_profiles(s, d), [standard]).select("artifact_id", "cluster", "name", "status", "value")


def coverage_values(s, d):
    values = CV.values()
    return _profiles(s, d).select("artifact_id", "license", "original_license", *[e.alias(n) for n, e in values.items()])


# --- controls -----------------------------------------------------------------------------------------------
def _statuses(s, d):
    return C.control_status(
        T.read(s, d, T.EVIDENCE), K.AI_RMF, T.read(s, d, T.ATTESTATIONS), T.read(s, d, T.SCOPE), NOW
    )


def _artifact_frameworks(s, d):
    """Each artifact's own catalogue: every control with the artifact's function counts."""
    evidence = T.spread(T.read(s, d, T.EVIDENCE), "artifact_id")
    return C.control_status(evidence, K.SP_800_53).select("artifact_id", "control_id", "function", "automation")


def catalog_by_artifact(s, d):
    return C.catalog_coverage(
        _artifact_frameworks(s, d).withColumnRenamed("artifact_id", "framework")
    )


def technique_lookup(s, d):
    ids = F.concat(F.lit("AML.T00"), F.lpad((F.col("c_custkey") % 120).cast("string"), 2, "0"))
    rows = T.table(s, d, "customer").select("c_custkey", C.atlas_lookup(ids).alias("t"))
    return rows.select("c_custkey", "t.technique_id", "t.coverage")


def control_keys(s, d):
    function = F.when(F.col("p_size") % 4 == 0, "GOVERN").when(F.col("p_size") % 4 == 1, "MAP").when(
        F.col("p_size") % 4 == 2, "MEASURE").otherwise("MANAGE")
    control = F.concat(function, F.lit(" "), (F.col("p_partkey") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 14).cast("string"))
    key = S.control_sort_key(function, control)
    return T.table(s, d, "part").select("p_partkey", key.alias("k")).select("p_partkey", "k.*")


# --- provenance, fetching, identifiers ----------------------------------------------------------------------
def _signed(s, d):
    return T.read(s, d, T.SIGNED_FILES)


def _plan(s, d):
    return FE.fetch_plan(T.read(s, d, T.FILES), FETCH)


def coverage_of_statements(s, d):
    covered = PR.manifest_coverage(T.read(s, d, T.STATEMENTS), T.read(s, d, T.MODEL_FILES))
    return PR.manifest_outcome(covered)


def uncovered(s, d):
    covered = T.read(s, d, T.OUTCOMES).filter("valid").select("artifact_id", F.explode("covered").alias("path"))
    return PR.unsigned_executables(_signed(s, d), covered)


def rolled(s, d):
    orders = T.read(s, d, T.OUTCOMES)
    return PR.rollup(orders, _signed(s, d), orders)


def uri_parts(s, d):
    rows = T.read(s, d, T.LINKS)
    return rows.select(
        "page_id",
        P.uri_scheme(F.col("uri")).alias("scheme"),
        P.hub_reference(F.col("uri")).alias("r"),
        P.mlflow_rewrite(F.col("uri"), F.lit("https://track.example.org:8080/base")).alias("mlflow"),
    ).select("page_id", "scheme", "mlflow", "r.repo", "r.revision", "r.error")


def range_digests(s, d):
    """Digests of documents that come in ranges of 1000 bytes."""
    content = F.encode("text", "UTF-8").alias("content")
    files = T.table(s, d, "documents").select(F.col("source").alias("artifact_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("path"), content)
    return chunked.digests(chunks.chunked(files, 1000, 0)).select("artifact_id", "path", "size", "sha256", "complete")


QUERIES = {
    "file_digests": lambda s, d: DG.file_digests(
        T.table(s, d, "documents").select(
            F.col("source").alias("artifact_id"), F.concat(F.lit("d"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")
        )
    ).select("artifact_id", "path", "size", "sha256"),
    "range_digests": range_digests,
    "file_digests_all": lambda s, d: DG.file_digests(
        T.table(s, d, "documents").select(
            F.col("source").alias("artifact_id"), F.concat(F.lit("d"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")
        )
    ),
    "tree_digest": lambda s, d: DG.tree_digest(T.read(s, d, T.MODEL_FILES)),
    "verify_files": lambda s, d: VF.verify_files(_docs(s, d), T.read(s, d, T.DOC_FILES), T.read(s, d, T.MODEL_FILES)).drop("detail"),
    "verify_identity": lambda s, d: VF.verify_identity(_docs(s, d), T.read(s, d, T.MODELS)).drop("detail"),
    "verify_properties": lambda s, d: VF.verify_properties(_docs(s, d), T.read(s, d, T.MODELS)).drop("detail"),
    "verify_summary": lambda s, d: VF.verify_summary(_checks(s, d)),
    "manifest_build": lambda s, d: VF.manifest_build(
        T.read(s, d, T.BUNDLE_MANIFESTS),
        T.read(s, d, T.BUNDLE_SOURCES),
        T.read(s, d, T.MODEL_FILES).withColumnRenamed("artifact_id", "manifest_id"),
    ),
    "manifest_verify": lambda s, d: VF.manifest_verify(
        T.read(s, d, T.BUNDLE_MANIFESTS), T.read(s, d, T.BUNDLE_ENTRIES), T.read(s, d, T.BUNDLE_MEMBERS)
    ),
    "attestation_bind": bind,
    "coverage_g7": _coverage("g7"),
    "coverage_certin": _coverage("cert-in"),
    "coverage_bsi": _coverage("bsi"),
    "coverage_cisa2026": _coverage("cisa-2026"),
    "coverage_values": coverage_values,
    "coverage_report": lambda s, d: CV.coverage_counts(_profiles(s, d)),
    "bsi_properties": lambda s, d: CV.bsi_properties(_profiles(s, d), T.read(s, d, T.COMPONENT_FILES)),
    "catalog_controls": _artifact_frameworks,
    "catalog_coverage": catalog_by_artifact,
    "evidence_observed": lambda s, d: C.evidence_observed(T.read(s, d, T.EVIDENCE)),
    "control_status": lambda s, d: _statuses(s, d).select("artifact_id", "control_id", "status", "attested_by", "warning"),
    "attestation_valid": lambda s, d: C.attestation_valid(T.read(s, d, T.ATTESTATIONS), NOW).select(
        "artifact_id", "control_id", "valid", "warning"
    ),
    "assessment": lambda s, d: C.assessment(_statuses(s, d)),
    "unmeasured_traits": lambda s, d: C.unmeasured_traits(T.read(s, d, T.EVIDENCE)),
    "atlas_summary": lambda s, d: C.atlas_summary(
        T.read(s, d, T.FINDINGS).withColumn("id", F.when(F.col("ord") % 3 == 0, "AR-PROV-001").otherwise("AR-KERAS-002"))
    ),
    "atlas_lookup": technique_lookup,
    "control_sort_key": control_keys,
    "signature_discovery": lambda s, d: PR.signatures(_signed(s, d)),
    "plain_files": lambda s, d: PR.plain_files(_signed(s, d)),
    "publisher_scope": lambda s, d: PR.publisher_scope(T.read(s, d, T.URIS), T.read(s, d, T.PUBLISHERS)).select(
        "artifact_id", "publisher", "keyless", "label"
    ),
    "manifest_coverage": coverage_of_statements,
    "unsigned_executables": uncovered,
    "provenance_rollup": rolled,
    "failure_class": lambda s, d: T.read(s, d, T.OUTCOMES)
    .select("artifact_id", PR.failure_class(F.col("message")).alias("f"))
    .select("artifact_id", "f.*"),
    "fetch_plan": lambda s, d: _plan(s, d).select("artifact_id", "path", "action", "reason"),
    "fetch_coverage": lambda s, d: FE.fetch_coverage(_plan(s, d)),
    "uri_parse": uri_parts,
    "purl": lambda s, d: T.read(s, d, T.LINKS).select(
        "page_id",
        P.purl(F.regexp_replace("url", "^(https?)://[^/]*", "$1://HuggingFace.co"), F.col("commit_id")).alias("purl"),
        P.purl(F.col("url"), F.col("commit_id")).alias("elsewhere"),
    ),
    "hub_url": lambda s, d: T.read(s, d, T.LINKS).select(
        "page_id",
        P.hub_url(F.regexp_replace("url", "^https?://", "")).alias("model"),
        P.hub_url(F.regexp_replace("url", "^https?://([^/]*)/([^/]*).*$", "$1/$2"), "dataset").alias("dataset"),
    ),
    "slug": lambda s, d: T.table(s, d, "pages").select("page_id", S.slug(F.col("url")).alias("slug")),
    "serial_uuid": lambda s, d: T.table(s, d, "pages").select("page_id", S.serial_uuid(F.col("url")).alias("uuid")),
    "fingerprint": lambda s, d: T.read(s, d, T.COMPONENT_FILES).select(
        "artifact_id", "path", S.fingerprint(F.col("sha256"), F.col("path"), F.lit("AR-X-1")).alias("fingerprint")
    ),
    "io_format": lambda s, d: T.read(s, d, T.TENSORS).select(
        "artifact_id", "ord",
        S.io_format(F.col("dtype"), F.array("rows_dim", "cols_dim"), F.lit("tensor")).alias("text"),
        S.io_signature(
            F.array(F.struct(F.lit("x").alias("name"), "dtype", F.array("rows_dim", "cols_dim").alias("shape"))),
            F.array(F.struct(F.lit("").alias("name"), "dtype", F.array().cast("array<bigint>").alias("shape"))),
        ).alias("signature"),
    ),
}

# --- the same in plain SQL ---------------------------------------------------------------------------------
VERIFY_CTES = {"docs": T.DOCS, "df": T.DOC_FILES, "mf": T.MODEL_FILES, "models": T.MODELS}
SHORT = "CASE WHEN length({0}) > 16 THEN left({0}, 16) || '…' ELSE {0} END"
FILE_CHECKS = f"""
SELECT docs.doc_id, docs.artifact_id, outcome, subject, claim, measured FROM docs JOIN (
  SELECT doc_id, 'fail' AS outcome, 'file ' || path AS subject, 'present' AS claim, NULL AS measured FROM j WHERE NOT held
  UNION ALL SELECT doc_id, CASE WHEN lower(c384) = lower(m384) THEN 'pass' ELSE 'fail' END, 'file ' || path || ' (SHA-384)', {SHORT.format('c384')}, {SHORT.format('m384')} FROM j WHERE held AND c384 <> '' AND m384 <> ''
  UNION ALL SELECT doc_id, CASE WHEN lower(c256) = lower(m256) THEN 'pass' ELSE 'fail' END, 'file ' || path || ' (SHA-256)', {SHORT.format('c256')}, {SHORT.format('m256')} FROM j WHERE held AND NOT (c384 <> '' AND m384 <> '') AND c256 <> '' AND m256 <> ''
  UNION ALL SELECT doc_id, 'uncheckable', 'file ' || path, NULL, NULL FROM j WHERE held AND NOT (c384 <> '' AND m384 <> '') AND NOT (c256 <> '' AND m256 <> '')
  UNION ALL SELECT doc_id, 'fail', 'file ' || path || ' (size)', cs::VARCHAR, ms::VARCHAR FROM j WHERE held AND cs > 0 AND ms > 0 AND cs <> ms
  UNION ALL SELECT 'bom-' || artifact_id, 'extra', 'file ' || path, NULL, {SHORT.format('sha256')} FROM mf WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.doc_id = 'bom-' || mf.artifact_id AND df.path = mf.path)
) k USING (doc_id)
"""
FILE_JOIN = """, j AS (SELECT df.doc_id, df.path, df.sha256 AS c256, df.sha384 AS c384, df.size AS cs, mf.sha256 AS m256, mf.sha384 AS m384, mf.size AS ms, mf.path IS NOT NULL AS held
  FROM df LEFT JOIN mf ON df.doc_id = 'bom-' || mf.artifact_id AND df.path = mf.path) """
IDENTITY_CHECKS = """
SELECT doc_id, docs.artifact_id, CASE WHEN lower(model_name) = lower(name) THEN 'pass' ELSE 'fail' END AS outcome, 'model name' AS subject, model_name AS claim, name AS measured FROM docs JOIN models USING (artifact_id)
UNION ALL SELECT doc_id, artifact_id, CASE WHEN docs.version = models.version THEN 'pass' ELSE 'fail' END, 'model version', docs.version, models.version FROM docs JOIN models USING (artifact_id) WHERE docs.version <> '' AND models.version <> ''
"""
PROPERTY_CHECKS = """
SELECT doc_id, artifact_id, CASE WHEN got = '' THEN 'uncheckable' WHEN lower(claim) = lower(got) THEN 'pass' ELSE 'fail' END AS outcome, subject, claim, nullif(got, '') AS measured FROM (
  SELECT doc_id, artifact_id, 'architecture' AS subject, docs.architecture AS claim, models.architecture AS got FROM docs JOIN models USING (artifact_id)
  UNION ALL SELECT doc_id, artifact_id, 'quantization', docs.quantization, models.quantization FROM docs JOIN models USING (artifact_id)
  UNION ALL SELECT doc_id, artifact_id, 'dtype', docs.dtype, models.dtype FROM docs JOIN models USING (artifact_id)
  UNION ALL SELECT doc_id, artifact_id, 'measuredParameters', parameters, measured_parameters::VARCHAR FROM docs JOIN models USING (artifact_id)) WHERE claim <> ''
"""
ALL_CHECKS = f"{FILE_CHECKS} UNION ALL ({IDENTITY_CHECKS}) UNION ALL ({PROPERTY_CHECKS})"


def _verify_sql(body):
    return (T.with_ctes("SELECT 0", **VERIFY_CTES)[: -len("SELECT 0")]).rstrip() + FILE_JOIN + body


SUMMARY = f""", checks AS ({ALL_CHECKS}), s AS (SELECT doc_id, artifact_id, count(*) FILTER (WHERE outcome='pass') AS passed, count(*) FILTER (WHERE outcome='fail') AS failed,
  count(*) FILTER (WHERE outcome='uncheckable') AS uncheckable, count(*) FILTER (WHERE outcome='extra') AS not_in_document FROM checks GROUP BY 1, 2) """

COVERAGE_CTES = {
    "p": T.PROFILES, "cf": T.COMPONENT_FILES, "li": T.LICENSE_ROWS, "ds": T.DATASET_ROWS, "dom": T.DOMAIN_ROWS, "fi": T.FINDINGS,
}
WIDE = """, ff AS (SELECT artifact_id, arg_min(path, k) AS pp, arg_min(sha256, k) AS p256, arg_min(sha384, k) AS p384, arg_min(sha512, k) AS p512, count(*) AS files,
   count(*) FILTER (WHERE role='shard') AS shards, count(*) FILTER (WHERE role='external-data') AS externals, count(*) FILTER (WHERE sha256<>'') AS hashed
   FROM (SELECT *, struct_pack(a := role <> 'primary', b := path) AS k FROM cf) GROUP BY 1),
 ll AS (SELECT artifact_id, coalesce(arg_min(spdx_id, ord) FILTER (WHERE spdx_id<>''), arg_min(raw, ord) FILTER (WHERE raw<>'')) AS license, arg_min(raw, ord) FILTER (WHERE raw<>'') AS original_license FROM li GROUP BY 1),
 dd AS (SELECT artifact_id, string_agg(name, ', ' ORDER BY ord) AS datasets FROM ds GROUP BY 1),
 mm AS (SELECT artifact_id, string_agg(domain, ', ' ORDER BY domain) AS domains, count(*) AS nd FROM dom GROUP BY 1),
 nn AS (SELECT artifact_id, count(*) AS nf, bool_or(ord % 50 = 0) AS inc FROM fi GROUP BY 1),
 q AS (SELECT p.artifact_id, nullif(name,'') AS name, nullif(version,'') AS version, nullif(author,'') AS author, nullif(organization,'') AS organization, nullif(description,'') AS description,
   nullif(uuid,'') AS uuid, nullif(url,'') AS url, nullif(repo_url,'') AS repo_url, nullif(doi,'') AS doi, nullif(architecture,'') AS architecture, nullif(quantization,'') AS quantization,
   nullif(framework,'') AS framework, nullif(producer,'') AS producer, format, chat_template, measured_parameters AS mp,
   CASE WHEN c_nationkey % 2 = 0 THEN 'F32, F32' END AS ins, CASE WHEN c_nationkey % 3 = 0 THEN 'F32' END AS outs,
   pp, nullif(p256,'') AS p256, nullif(p384,'') AS p384, nullif(p512,'') AS p512, coalesce(files,0) AS files, coalesce(shards,0) AS shards, coalesce(externals,0) AS externals, coalesce(hashed,0) AS hashed,
   license, original_license, datasets, domains, coalesce(nd,0) AS nd, coalesce(nf,0) AS nf, coalesce(inc,false) AS inc
   FROM p LEFT JOIN ff USING (artifact_id) LEFT JOIN ll USING (artifact_id) LEFT JOIN dd USING (artifact_id) LEFT JOIN mm USING (artifact_id) LEFT JOIN nn USING (artifact_id)) """
VALUE_SQL = {
    "hash_algorithms": "nullif(concat_ws(', ', CASE WHEN p256 IS NOT NULL THEN 'sha-256' END, CASE WHEN p384 IS NOT NULL THEN 'sha-384' END, CASE WHEN p512 IS NOT NULL THEN 'sha-512' END), '')",
    "architecture": "nullif(concat_ws(', ', architecture, CASE WHEN mp > 0 THEN mp || ' parameters' END, quantization), '')",
    "io": "CASE WHEN ins IS NOT NULL OR outs IS NOT NULL THEN coalesce(ins,'') || ' -> ' || coalesce(outs,'') END",
    "inputs": "ins",
    "outputs": "outs",
    "dependencies": "coalesce(domains, framework)",
    "finding_summary": "CASE WHEN nf = 0 THEN 'no findings' ELSE nf || ' finding(s)' END",
    "integrity": "CASE WHEN p384 IS NOT NULL THEN 'per-file digests, recomputable' END",
    "identifiers": "nullif(concat_ws(', ', coalesce(uuid, repo_url, url, doi), 'sha256:' || p256), '')",
    "relationships": "CASE WHEN shards>0 AND externals>0 THEN 'model contains ' || shards || ' shard(s) and ' || externals || ' external data file(s)' WHEN shards>0 THEN 'model contains ' || shards || ' shard(s)' WHEN externals>0 THEN 'model contains ' || externals || ' external data file(s)' WHEN files>0 THEN 'single-file model; no subcomponents' END",
    "component_coverage": "CASE WHEN files>0 THEN hashed || ' of ' || files || ' component file(s) enumerated and hashed' END",
    "contact": "coalesce(CASE WHEN contains(author,'@') AND contains(author,'.') THEN author END, CASE WHEN contains(organization,'@') AND contains(organization,'.') THEN organization END, repo_url, url)",
    "component_set": "CASE WHEN files=0 THEN 'no component files were enumerated' ELSE files || CASE WHEN files=1 THEN ' file' ELSE ' files' END || CASE WHEN inc THEN ' enumerated; the set is incomplete (AR-FILE-002)' WHEN nd>0 THEN ' and ' || nd || CASE WHEN nd=1 THEN ' custom operator domain' ELSE ' custom operator domains' END ELSE '' END END",
}
OUT = None
V = VALUE_SQL
MAKER = "coalesce(organization, author)"
EXECUTABLE = "CASE WHEN (format='gguf' AND chat_template<>'') OR (format='onnx' AND nd>0) THEN 'executable' ELSE 'non-executable' END"
ELEMENT_SQL = {
    "g7": [
        ("Metadata", "SBOM author", "'fleetrisk'"), ("Metadata", "Timestamp", "'generated per document'"), ("Metadata", "Generation context", "'post-build'"),
        ("Models", "Model name", "name"), ("Models", "Model version", "version"), ("Models", "Model producer", f"coalesce({MAKER}, producer)"),
        ("Models", "Model description", "description"), ("Models", "Model hash value", "p384"), ("Models", "Model hash algorithm", V["hash_algorithms"]),
        ("Models", "Model license", "license"), ("Models", "Model identifier", "uuid"), ("Models", "Model properties", V["architecture"]),
        ("Models", "Model input-output properties", V["io"]), ("Models", "Model training properties", OUT),
        ("Models", "Model external references", "coalesce(repo_url, url, doi)"), ("Datasets", "Dataset name", "datasets"),
        ("Datasets", "Dataset hash value", OUT), ("Datasets", "Dataset properties", OUT), ("System", "Model dependencies", V["dependencies"]),
        ("System", "System-level properties", OUT), ("Infrastructure", "Compute and runtime environment", OUT),
        ("Security", "Known vulnerabilities and findings", V["finding_summary"]), ("Security", "Integrity verification", V["integrity"]), ("KPI", "Performance indicators", OUT),
    ],
    "cert-in": [
        ("AIBOM", n, e)
        for n, e in [
            ("Model Name", "name"), ("Model Version", "version"), ("Model Type", V["architecture"]), ("Model Developer", MAKER),
            ("Model Licensing Information", "license"), ("Software Dependencies", V["dependencies"]), ("ML Models and Algorithms", V["architecture"]),
            ("Model Performance Metrics", OUT), ("Data Source", "datasets"), ("Data Sets", "datasets"), ("Hardware", OUT), ("Security Requirements", V["finding_summary"]),
            ("Input", "ins"), ("Output", "outs"), ("Intended Usage", OUT), ("Out of Scope Usage", OUT), ("Environmental Impact", OUT),
            ("Vulnerabilities", V["finding_summary"]), ("Attestations", V["integrity"]),
        ]
    ],
    "bsi": [
        ("SBOM", "Creator of the SBOM", "'fleetrisk'"), ("SBOM", "Timestamp", "'generated per document, UTC'"), ("SBOM", "SBOM-URI", "'urn:uuid, derived from the primary file digest'"),
        ("SBOM", "Format and version", "'CycloneDX 1.6 and SPDX 3.0.1'"), ("Component", "Component creator", V["contact"]), ("Component", "Component name", "name"),
        ("Component", "Component version", "version"), ("Component", "Filename of the component", "pp"), ("Component", "Dependencies on other components", OUT),
        ("Component", "Distribution licences", "license"), ("Component", "Hash value of the deployable component (SHA-512)", "p512"), ("Component", "Executable property", EXECUTABLE),
        ("Component", "Archive property", "'no archive'"), ("Component", "Structured property", "'structured'"), ("Component", "Source code URI", "repo_url"),
        ("Component", "URI of the deployable form", "coalesce(url, repo_url)"), ("Component", "Other unique identifiers", "coalesce(doi, uuid, repo_url)"), ("Component", "Original licences", "original_license"),
    ],
    "cisa-2026": [
        ("Data Fields", n, e)
        for n, e in [
            ("Component Dependency Relationship", V["relationships"]), ("Component Hash Algorithm", V["hash_algorithms"]), ("Component Hash Value", "p256"), ("Component Identifiers", V["identifiers"]),
            ("Component License", "license"), ("Component Name", "name"), ("Component Producer", MAKER), ("Component Version", "version"), ("SBOM Author", "'fleetrisk'"),
            ("SBOM Author Signature", OUT), ("SBOM Data Format Name", "'CycloneDX and SPDX'"), ("SBOM Data Format Version", "'CycloneDX 1.6 or 1.7; SPDX 3.0.1'"),
            ("SBOM Generation Context", "'post-build'"), ("SBOM Timestamp", "'generated per document'"), ("SBOM Tool Name", "'fleetrisk'"), ("SBOM Tool Version", "'stamped into each document'"), ("SBOM Version", "'1'"),
        ]
    ] + [
        ("Practices and Processes", n, e)
        for n, e in [
            ("Accommodation of Updates to SBOM Data", OUT), ("Coverage", V["component_coverage"]), ("Distribution and Delivery", OUT),
            ("Explicitly Identifying Unknown Information", "'unknown elements are reported as absent or out-of-scope with a reason'"), ("Frequency", OUT),
            ("Machine-Processable Data", "'JSON: CycloneDX, SPDX 3.0.1 JSON-LD, SARIF'"),
        ]
    ],
}


def _coverage_sql(body):
    return (T.with_ctes("SELECT 0", **COVERAGE_CTES)[: -len("SELECT 0")]).rstrip() + WIDE + body


def _elements_sql(standard):
    rows = []
    for cluster, name, expression in ELEMENT_SQL[standard]:
        status = "'out-of-scope'" if expression is None else f"CASE WHEN {expression} IS NOT NULL THEN 'populated' ELSE 'absent' END"
        rows.append(f"SELECT artifact_id, '{standard}' AS standard, '{cluster}' AS cluster, '{name}' AS name, {status} AS status, {expression or 'NULL::VARCHAR'} AS value FROM q")
    return " UNION ALL ".join(rows)


def _controls_sql(framework):
    rows = ", ".join(
        f"('{c['control_id']}', '{c['function']}', '{c['automation']}', {c['evidence'] or '[]::VARCHAR[]'})" for c in K.catalog(framework)
    )
    return f"controls(control_id, function, automation, ev) AS (VALUES {rows})"


SEEN = """, seen AS (SELECT artifact_id, profile, CASE WHEN scan_complete THEN list_filter([
   CASE WHEN inventoried THEN 'inventory' END, CASE WHEN security_scanned THEN 'security-scan' END, CASE WHEN sbom_generated THEN 'sbom' END, CASE WHEN aibom_generated THEN 'aibom' END,
   CASE WHEN signature_verified THEN 'provenance' END, CASE WHEN secrets_scanned THEN 'secrets' END, CASE WHEN policy_ref <> '' THEN 'policy' END, CASE WHEN verdict NOT IN ('', 'Unknown') THEN 'verdict' END,
   CASE WHEN risk_scored THEN 'risk-score' END, CASE WHEN residual_risks_documented THEN 'residual-risk' END, CASE WHEN continuous_monitoring THEN 'scan-history' END, CASE WHEN admission_enforcing THEN 'revocation' END,
   'coverage-gap', CASE WHEN bias_evaluated THEN 'bias-eval' END], lambda x: x IS NOT NULL) ELSE [] END AS kinds FROM ev) """
ATTEST = """, last AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY artifact_id, control_id ORDER BY ord DESC) = 1),
  av AS (SELECT artifact_id, control_id, attested_by, CASE WHEN trim(attested_by) = '' THEN 'no named attester' WHEN trim(statement) = '' THEN 'no statement'
    WHEN expires_at < TIMESTAMP '1998-01-01' THEN 'expired' END AS problem, expires_at FROM last) """
STATUS = f""", {_controls_sql(K.AI_RMF)}, st AS (
  SELECT artifact_id, control_id, why, ok, av_by, problem, forever,
   CASE WHEN why IS NOT NULL AND trim(why) <> '' THEN 'NotApplicable' WHEN why IS NOT NULL THEN 'AttestationRequired'
     WHEN automation = 'None' THEN CASE WHEN ok THEN 'Attested' ELSE 'AttestationRequired' END
     WHEN NOT list_has_all(kinds, ev) THEN 'NotSatisfied' WHEN automation = 'Full' OR ok THEN 'Satisfied' ELSE 'PartiallySatisfied' END AS status
  FROM (SELECT seen.artifact_id, c.control_id, c.automation, c.ev, seen.kinds, scope.justification AS why, av.control_id IS NOT NULL AND av.problem IS NULL AS ok, av.attested_by AS av_by, av.problem, av.control_id IS NOT NULL AND av.expires_at IS NULL AS forever
    FROM seen CROSS JOIN controls c LEFT JOIN av ON av.artifact_id = seen.artifact_id AND av.control_id = c.control_id LEFT JOIN scope ON scope.profile = seen.profile AND scope.control_id = c.control_id)) """


def _control_sql(body):
    head = T.with_ctes("SELECT 0", ev=T.EVIDENCE, att=T.ATTESTATIONS, scope=T.SCOPE)[: -len("SELECT 0")].rstrip()
    return head + SEEN + ATTEST + STATUS + body


def _count_status(name, alias):
    return f"count(*) FILTER (WHERE status = '{name}') AS {alias}"


SIG_KIND = """CASE WHEN lower(base) IN ('model.sig', 'model.sig.json', 'model_signature.json', 'signature.json') THEN 'manifest'
   WHEN lower(base) LIKE '_%.sigstore.json' OR lower(base) LIKE '_%.sigstore' OR lower(base) LIKE '_%.bundle.json' OR lower(base) LIKE '_%.bundle' THEN 'bundle' WHEN base LIKE '%.sig' THEN 'detached' END"""
SIGS = f""", b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM sf), k AS (SELECT artifact_id, path, {SIG_KIND} AS kind FROM b),
  sg AS (SELECT artifact_id, path, kind, CASE path WHEN 'w.bin.sig' THEN 'w.bin' WHEN 'd/v.pt.sig' THEN 'd/v.pt' WHEN 'x.pkl.sigstore.json' THEN 'x.pkl' WHEN 'y.cosign.bundle' THEN 'y.cosign' WHEN 'z.SIGSTORE' THEN 'z.SIGSTORE' END AS target FROM k WHERE kind IS NOT NULL),
  s2 AS (SELECT sg.*, CASE WHEN path = 'w.bin.sig' THEN coalesce((SELECT min(path) FROM sf WHERE sf.artifact_id = sg.artifact_id AND sf.path = 'w.bin.crt'), (SELECT min(path) FROM sf WHERE sf.artifact_id = sg.artifact_id AND sf.path = 'w.bin.pem')) END AS cert_path FROM sg),
  pl AS (SELECT artifact_id, path FROM sf WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.artifact_id = sf.artifact_id AND (s2.path = sf.path OR s2.cert_path = sf.path))),
  cov AS (SELECT DISTINCT artifact_id, unnest(covered) AS path FROM oc WHERE valid),
  un AS (SELECT * FROM pl WHERE regexp_matches(path, '\\.(bin|pkl|pt)$') AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.artifact_id = pl.artifact_id AND cov.path = pl.path)) """


def _sig_sql(body):
    return T.with_ctes("SELECT 0", sf=T.SIGNED_FILES, oc=T.OUTCOMES)[: -len("SELECT 0")].rstrip() + SIGS + body


PLAN_SQL = """WITH RECURSIVE f AS ({files}), o AS (SELECT artifact_id, path, size, row_number() OVER (PARTITION BY artifact_id ORDER BY path) AS rn,
   lower(regexp_extract(path, '(\\.[^.]*)$', 1)) IN ('.safetensors', '.gguf', '.ggml', '.npy') AS hd FROM f),
  r AS (SELECT artifact_id, 0::BIGINT AS rn, 0::BIGINT AS total, '' AS path, 0::BIGINT AS size, '' AS action, NULL::VARCHAR AS reason FROM (SELECT DISTINCT artifact_id FROM f)
   UNION ALL SELECT o.artifact_id, o.rn, r.total + CASE WHEN hd THEN least(o.size, 500) WHEN o.size <= 3000 AND r.total + o.size <= 12000 THEN o.size ELSE 0 END, o.path, o.size,
     CASE WHEN hd THEN 'header' WHEN o.size <= 3000 AND r.total + o.size <= 12000 THEN 'whole' ELSE 'skipped' END,
     CASE WHEN hd THEN NULL WHEN o.size > 3000 THEN 'file too large and without a readable header' WHEN r.total + o.size > 12000 THEN 'total fetch limit reached' END
   FROM r JOIN o ON o.artifact_id = r.artifact_id AND o.rn = r.rn + 1 WHERE o.rn <= 40),
  plan AS (SELECT artifact_id, path, action, reason FROM r WHERE rn > 0 UNION ALL SELECT artifact_id, path, 'skipped', 'file limit reached' FROM o WHERE rn > 40) """.replace(
    "{files}", T.sql_for_duckdb(T.FILES).strip()
)

ORACLES = {
    "range_digests": "SELECT source AS artifact_id, 'd' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256, true AS complete FROM documents",
    "file_digests": "SELECT source AS artifact_id, 'd' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents",
    "tree_digest": T.with_ctes(
        "SELECT artifact_id, 'sha256:' || sha256(string_agg(sha256 || ' ' || path || chr(10), '' ORDER BY path)) AS tree_digest, sum(size)::BIGINT AS total_size FROM m GROUP BY 1",
        m=T.MODEL_FILES,
    ),
    "verify_files": _verify_sql(FILE_CHECKS),
    "verify_identity": _verify_sql(IDENTITY_CHECKS),
    "verify_properties": _verify_sql(PROPERTY_CHECKS),
    "verify_summary": _verify_sql(SUMMARY + "SELECT *, failed = 0 AND not_in_document = 0 AND passed > 0 AS verified FROM s"),
    "manifest_build": T.with_ctes(
        """SELECT manifest_id, 1 AS format_version, CASE WHEN kind = '' THEN 'mixed' ELSE kind END AS kind, name, created_at, coalesce(n, 0) AS entries, coalesce(t, 0) AS total_size, coalesce(k, 0) AS sources,
         CASE WHEN n IS NULL THEN 'no files' WHEN created_at = '' THEN 'no creation time' WHEN name = '' THEN 'no name' WHEN u > 0 THEN 'source without a retrieval date' END AS problem
        FROM m LEFT JOIN (SELECT artifact_id AS manifest_id, count(*) AS n, sum(size)::BIGINT AS t FROM f GROUP BY 1) USING (manifest_id)
        LEFT JOIN (SELECT manifest_id, count(*) AS k, count(*) FILTER (WHERE retrieved_at = '') AS u FROM s GROUP BY 1) USING (manifest_id)""",
        m=T.BUNDLE_MANIFESTS, s=T.BUNDLE_SOURCES, f=T.MODEL_FILES,
    ),
    "manifest_verify": T.with_ctes(
        """, h AS (SELECT manifest_id, min(ord) AS mat FROM b WHERE name = 'manifest.json' GROUP BY 1),
        j AS (SELECT coalesce(p.manifest_id, e.manifest_id) AS manifest_id, coalesce(p.name, e.path) AS name, p.name IS NOT NULL AS held, e.path IS NOT NULL AS listed, p.ord, p.kind, p.size AS s, e.size AS es,
          p.sha256 <> e.sha256 OR p.sha512 <> e.sha512 AS dd FROM (SELECT * FROM b WHERE name <> 'manifest.json') p FULL JOIN e ON p.manifest_id = e.manifest_id AND p.name = e.path),
        k AS (SELECT j.*, h.mat FROM j LEFT JOIN h USING (manifest_id))
        SELECT manifest_id, '' AS name, 'no manifest' AS failure FROM m LEFT JOIN h USING (manifest_id) WHERE mat IS NULL
        UNION ALL SELECT manifest_id, 'manifest.json', 'unsupported version' FROM m WHERE format_version <> 1
        UNION ALL SELECT manifest_id, name, 'not a regular file' FROM k WHERE held AND kind <> 'file'
        UNION ALL SELECT manifest_id, name, 'traversal' FROM k WHERE held AND name LIKE '../%'
        UNION ALL SELECT manifest_id, name, 'before the manifest' FROM k WHERE held AND (mat IS NULL OR ord < mat)
        UNION ALL SELECT manifest_id, name, 'not listed' FROM k WHERE held AND NOT listed
        UNION ALL SELECT manifest_id, name, 'size differs' FROM k WHERE held AND listed AND s <> es
        UNION ALL SELECT manifest_id, name, 'digest differs' FROM k WHERE held AND listed AND dd
        UNION ALL SELECT manifest_id, name, 'missing' FROM k WHERE NOT held""",
        m=T.BUNDLE_MANIFESTS, e=T.BUNDLE_ENTRIES, b=T.BUNDLE_MEMBERS,
    ).replace(") , h AS", "), h AS"),
    "attestation_bind": _verify_sql(
        SUMMARY
        + """, x AS (SELECT doc_id, CASE WHEN model_name LIKE '%8' THEN 'unsigned' WHEN model_name LIKE '%7' THEN 'document changed' WHEN model_name LIKE '%9' THEN 'signature invalid'
          WHEN failed = 0 AND not_in_document = 0 AND passed > 0 THEN 'verified' ELSE 'claims no longer hold' END AS status FROM docs LEFT JOIN s USING (doc_id))
        SELECT 'att-' || doc_id AS attestation_id, doc_id, status, status = 'verified' AS accepted FROM x"""
    ),
    "coverage_g7": _coverage_sql(f"SELECT artifact_id, cluster, name, status, value FROM ({_elements_sql('g7')})"),
    "coverage_certin": _coverage_sql(f"SELECT artifact_id, cluster, name, status, value FROM ({_elements_sql('cert-in')})"),
    "coverage_bsi": _coverage_sql(f"SELECT artifact_id, cluster, name, status, value FROM ({_elements_sql('bsi')})"),
    "coverage_cisa2026": _coverage_sql(f"SELECT artifact_id, cluster, name, status, value FROM ({_elements_sql('cisa-2026')})"),
    "coverage_values": _coverage_sql("SELECT artifact_id, license, original_license, " + ", ".join(f"{e} AS {n}" for n, e in V.items()) + " FROM q"),
    "coverage_report": _coverage_sql(
        "SELECT artifact_id, standard, count(*) FILTER (WHERE status='populated') AS populated, count(*) FILTER (WHERE status='absent') AS absent, count(*) FILTER (WHERE status='out-of-scope') AS out_of_scope FROM ("
        + " UNION ALL ".join(_elements_sql(s) for s in CV.STANDARDS) + ") GROUP BY 1, 2"
    ),
    "bsi_properties": _coverage_sql(
        f"""SELECT artifact_id, path, CASE WHEN role = 'primary' THEN {EXECUTABLE} ELSE 'non-executable' END AS executable, 'no archive' AS archive,
        CASE WHEN role = 'primary' OR (role = 'shard' AND format = 'safetensors') OR path LIKE '%.safetensors' THEN 'structured' ELSE 'unstructured' END AS structured FROM cf JOIN q USING (artifact_id)"""
    ),
    "catalog_controls": f"WITH {_controls_sql(K.SP_800_53)} SELECT 'm' || c_custkey AS artifact_id, control_id, function, automation FROM customer CROSS JOIN controls",
    "catalog_coverage": f"""WITH {_controls_sql(K.SP_800_53)} SELECT 'm' || c_custkey AS framework, function, count(*) AS total, count(*) FILTER (WHERE automation = 'Full') AS "full",
        count(*) FILTER (WHERE automation = 'Partial') AS partial, count(*) FILTER (WHERE automation = 'None') AS none FROM customer CROSS JOIN controls GROUP BY GROUPING SETS ((1, 2), (1))""",
    "evidence_observed": _control_sql("SELECT artifact_id, unnest(kinds) AS kind FROM seen"),
    "control_status": _control_sql(
        "SELECT artifact_id, control_id, status, CASE WHEN why IS NULL AND ok THEN av_by END AS attested_by, CASE WHEN why IS NULL THEN coalesce(problem, CASE WHEN forever THEN 'no expiry' END) END AS warning FROM st"
    ),
    "attestation_valid": _control_sql(
        "SELECT artifact_id, control_id, problem IS NULL AS valid, coalesce(problem, CASE WHEN expires_at IS NULL THEN 'no expiry' END) AS warning FROM av"
    ),
    "assessment": _control_sql(
        "SELECT artifact_id, 'nist-ai-rmf-1.0' AS framework, "
        + ", ".join(
            _count_status(n, a)
            for n, a in [("Satisfied", "satisfied"), ("PartiallySatisfied", "partially_satisfied"), ("NotSatisfied", "not_satisfied"), ("Attested", "attested"), ("AttestationRequired", "attestation_required"), ("NotApplicable", "not_applicable")]
        )
        + ", count(*) FILTER (WHERE status IN ('PartiallySatisfied', 'NotSatisfied', 'AttestationRequired')) = 0 AS conformant FROM st GROUP BY 1"
    ),
    "unmeasured_traits": T.with_ctes(
        """SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY k) - 1 AS ord, trait FROM (
        SELECT artifact_id, 1 AS k, 'Valid and Reliable' AS trait FROM e UNION ALL SELECT artifact_id, 2, 'Safe' FROM e UNION ALL SELECT artifact_id, 3, 'Explainable and Interpretable' FROM e
        UNION ALL SELECT artifact_id, 4, 'Fair with Harmful Bias Managed' FROM e WHERE NOT bias_evaluated
        UNION ALL SELECT artifact_id, 5, 'Secure and Resilient' FROM e WHERE NOT scan_complete OR NOT security_scanned
        UNION ALL SELECT artifact_id, 6, 'Privacy-Enhanced' FROM e WHERE NOT scan_complete OR NOT secrets_scanned
        UNION ALL SELECT artifact_id, 7, 'Accountable and Transparent' FROM e WHERE NOT scan_complete OR NOT signature_verified)""",
        e=T.EVIDENCE,
    ),
    "atlas_summary": T.with_ctes(
        """, m(k, t, c) AS (VALUES ('AR-PROV', 'AML.T0010', 'Partial'), ('AR-PROV', 'AML.T0010.003', 'Partial'), ('AR-PROV', 'AML.T0115.001', 'Partial'), ('AR-KERAS', 'AML.T0011.000', 'Detected'),
          ('trivy', 'AML.T0011.001', 'Detected'), ('trivy', 'AML.T0010.001', 'Partial'), ('model-inspector', 'AML.T0011.000', 'Detected'), ('model-inspector', 'AML.T0018.002', 'Detected'), ('model-inspector', 'AML.T0018.001', 'Partial'))
        SELECT artifact_id, t AS technique_id, count(*) AS findings, any_value(c) AS coverage FROM (
          SELECT DISTINCT artifact_id, ord, t, c FROM f JOIN m ON k = CASE WHEN ord % 3 = 0 THEN 'AR-PROV' ELSE 'AR-KERAS' END OR k = scanner) GROUP BY 1, 2""",
        f=T.FINDINGS,
    ).replace(") , m(", "), m("),
    "atlas_lookup": """SELECT c_custkey, coalesce(r, i) AS technique_id, CASE coalesce(r, i) WHEN 'AML.T0115.001' THEN 'Partial' WHEN 'AML.T0076' THEN 'Detected' WHEN 'AML.T0010' THEN 'Partial' WHEN 'AML.T0074' THEN 'Partial'
          WHEN 'AML.T0020' THEN 'OutOfScope' WHEN 'AML.T0031' THEN 'OutOfScope' WHEN 'AML.T0024' THEN 'OutOfScope' WHEN 'AML.T0051' THEN 'OutOfScope' WHEN 'AML.T0070' THEN 'OutOfScope' WHEN 'AML.T0044' THEN 'OutOfScope'
          WHEN 'AML.T0012' THEN 'OutOfScope' END AS coverage
        FROM (SELECT c_custkey, i, CASE i WHEN 'AML.T0019' THEN 'AML.T0115.000' WHEN 'AML.T0058' THEN 'AML.T0115.001' WHEN 'AML.T0045' THEN 'AML.T0048.004' END AS r
          FROM (SELECT c_custkey, 'AML.T00' || left(lpad((c_custkey % 120)::VARCHAR, greatest(2, 0), '0'), 2) AS i FROM customer))""",
    "control_sort_key": """SELECT p_partkey, p_size % 4 AS function_order, p_partkey % 5 AS major, p_partkey % 14 AS minor FROM part""",
    "signature_discovery": _sig_sql("SELECT artifact_id, path, kind, target, cert_path FROM s2"),
    "plain_files": _sig_sql("SELECT artifact_id, path FROM pl"),
    "publisher_scope": T.with_ctes(
        """SELECT DISTINCT artifact_id, name AS publisher, issuer <> '' AND subject <> '' AS keyless,
          CASE WHEN display_name = '' THEN name ELSE display_name END || CASE WHEN issuer <> '' AND subject <> '' THEN ' (' || subject || ' via ' || issuer || ')' WHEN public_key <> '' THEN ' (public key)' ELSE '' END AS label
        FROM u JOIN (SELECT *, unnest(coalesce(uri_prefixes, [''])) AS prefix FROM p) ON starts_with(uri, prefix)""",
        u=T.URIS, p=T.PUBLISHERS,
    ),
    "manifest_coverage": T.with_ctes(
        """SELECT s.artifact_id, sig_path, count(*) FILTER (WHERE ok) AS covered, count(*) FILTER (WHERE NOT ok) AS mismatched, bool_and(ok) AS matches
        FROM (SELECT s.*, f.path IS NOT NULL AND lower(f.sha256) = lower(s.sha256) AS ok FROM s LEFT JOIN f ON f.artifact_id = s.artifact_id AND f.path = s.name WHERE s.sha256 IS NOT NULL) s GROUP BY 1, 2""",
        s=T.STATEMENTS, f=T.MODEL_FILES,
    ),
    "unsigned_executables": _sig_sql("SELECT artifact_id, path FROM un"),
    "provenance_rollup": _sig_sql(
        """, z AS (SELECT oc.artifact_id, coalesce(n, 0) AS signatures, valid, failed, CASE WHEN valid THEN signer END AS sg, CASE WHEN valid THEN 2 ELSE 0 END AS cv, coalesce(x, 0) AS x
          FROM oc LEFT JOIN (SELECT artifact_id, count(*) AS n FROM sg GROUP BY 1) USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS x FROM un GROUP BY 1) USING (artifact_id)),
        y AS (SELECT *, signatures > 0 AND valid AND NOT failed AND x = 0 AS verified FROM z)
        SELECT artifact_id, signatures, CASE WHEN signatures > 0 THEN cv ELSE 0 END AS covered_files, CASE WHEN signatures > 0 THEN x ELSE 0 END AS unsigned_executables, verified, CASE WHEN signatures > 0 THEN sg END AS signer,
         CASE WHEN signatures = 0 THEN 'AR-PROV-001' WHEN valid AND x > 0 THEN 'AR-PROV-005' WHEN verified THEN 'AR-PROV-000' END AS finding_id,
         CASE WHEN signatures = 0 THEN 'Medium' WHEN valid AND x > 0 THEN 'High' WHEN verified THEN 'Low' END AS severity FROM y"""
    ),
    "failure_class": T.with_ctes(
        "SELECT artifact_id, CASE WHEN message IN ('no Matching Certificate found', 'subject MISMATCH') THEN 'AR-PROV-003' ELSE 'AR-PROV-002' END AS id, CASE WHEN message IN ('no Matching Certificate found', 'subject MISMATCH') THEN 'High' ELSE 'Critical' END AS severity FROM o",
        o=T.OUTCOMES,
    ),
    "fetch_plan": PLAN_SQL + "SELECT * FROM plan",
    "fetch_coverage": PLAN_SQL
    + """, c AS (SELECT artifact_id, count(*) FILTER (WHERE action='whole') AS whole, count(*) FILTER (WHERE action='header') AS header_only, count(*) FILTER (WHERE action='skipped') AS skipped,
      count(*) FILTER (WHERE action='skipped' AND regexp_matches(lower(path), '\\.(onnx|bin|pkl|py|h5|so|sh)$')) AS unread_executables FROM plan GROUP BY 1)
     SELECT *, header_only = 0 AND skipped = 0 AS complete, CASE WHEN header_only = 0 AND skipped = 0 THEN whole || ' file(s) read in full' ELSE whole || ' read in full, ' || header_only || ' header-only, ' || skipped || ' not read' END AS summary FROM c""",
    "uri_parse": T.with_ctes(
        """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'hf' WHEN 1 THEN 'https' WHEN 2 THEN 'https' WHEN 3 THEN 'huggingface' WHEN 4 THEN 'hf' WHEN 6 THEN 'mlflow-artifacts' WHEN 7 THEN 's3' END AS scheme,
          CASE page_id % 8 WHEN 5 THEN 'mlflow://track.example.org:8080/run/' || page_id WHEN 6 THEN 'mlflow://track.example.org:8080/run/x' END AS mlflow,
          CASE page_id % 8 WHEN 0 THEN 'org' || page_id || '/m' WHEN 1 THEN 'org/m' || page_id WHEN 3 THEN 'solo' END AS repo,
          CASE page_id % 8 WHEN 0 THEN 'Main' WHEN 1 THEN 'dev' END AS revision,
          CASE WHEN page_id % 8 = 4 THEN 'no repository' WHEN page_id % 8 IN (2, 5, 6, 7) THEN 'too many segments' END AS error FROM l""",
        l=T.LINKS,
    ),
    "purl": T.with_ctes(
        """SELECT page_id, CASE WHEN a <> '' AND b <> '' THEN 'pkg:huggingface/' || a || '/' || b || CASE WHEN commit_id <> '' THEN '@' || lower(commit_id) ELSE '' END END AS purl, NULL AS elsewhere
        FROM (SELECT *, split_part(p, '/', 1) AS a, split_part(p, '/', 2) AS b FROM (SELECT *, trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS p FROM l))""",
        l=T.LINKS,
    ),
    "hub_url": T.with_ctes(
        """SELECT page_id, CASE WHEN length(n) - length(replace(n, '/', '')) = 1 AND NOT regexp_matches(n, '[ \\\\:]') THEN 'https://huggingface.co/' || n END AS model,
          CASE WHEN length(x) - length(replace(x, '/', '')) = 1 AND NOT regexp_matches(x, '[ \\\\:]') THEN 'https://huggingface.co/datasets/' || x END AS dataset
        FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS n, regexp_replace(url, '^https?://([^/]*)/([^/]*).*$', '\\1/\\2') AS x FROM l)""",
        l=T.LINKS,
    ),
    "slug": "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), '-'), ''), 'x') AS slug FROM pages",
    "serial_uuid": """SELECT page_id, h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:18])::INTEGER % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid
        FROM (SELECT page_id, sha256('fleetrisk:' || url) AS h FROM pages)""",
    "fingerprint": T.with_ctes("SELECT artifact_id, path, CASE WHEN sha256 = '' THEN path ELSE left(sha256, 16) END || ':AR-X-1' AS fingerprint FROM c", c=T.COMPONENT_FILES),
    "io_format": T.with_ctes(
        """SELECT artifact_id, ord, dtype || '[' || a || ',' || cols_dim || ']' AS text, 'in(x:' || dtype || '[' || a || 'x' || cols_dim || ']) -> out(?:' || dtype || ')' AS signature
        FROM (SELECT *, CASE WHEN rows_dim < 0 THEN '?' ELSE rows_dim::VARCHAR END AS a FROM t)""",
        t=T.TENSORS,
    ),
}
