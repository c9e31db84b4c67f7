"""Measured aggregations, drift and their scalar rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as S
from ..operators import drift as D
from ..operators import measure as M
from . import tables as T


def _tensors(spark, sf):
    return T.read(spark, sf, T.TENSORS).withColumn("shape", F.array("rows_dim", "cols_dim"))


def _files(spark, sf):
    return T.read(spark, sf, T.FILES).select("artifact_id", "path", "size")


def _kv(spark, sf):
    return T.read(spark, sf, T.RAW_KV)


def _drift_rows(spark, sf):
    return T.read(spark, sf, T.DRIFT_ROWS)


def _primary(spark, sf):
    return M.primary_file(_files(spark, sf))


def components(spark, sf):
    files = T.read(spark, sf, T.SHARD_FILES).dropDuplicates(["artifact_id", "path"])
    refs = T.read(spark, sf, T.SHARD_INDEX).distinct()
    primary = refs.groupBy("artifact_id").agg(F.min("path").alias("primary_path"))
    external = refs.withColumn("path", F.when(F.col("path") == "shard-3", "../escape").otherwise(F.col("path")))
    result = M.component_set(files.select("artifact_id", "path"), primary, refs, external)
    return result.select("artifact_id", "path", "role")


def lift(spark, sf):
    artifacts = (
        _kv(spark, sf).select("artifact_id").distinct().withColumns({"format": F.lit("gguf"), "primary_path": F.lit("w.gguf")})
    )
    columns = ["artifact_id", "name", "url", "repo_url", "license", "license_id", "architecture", "parameter_count",
               "quantization", "framework"]
    return M.metadata_lift(_kv(spark, sf), artifacts).select(*columns)


def element_counts(spark, sf):
    shape = F.array(F.col("p_size").cast("bigint") - 1, F.floor("p_retailprice").cast("bigint"))
    return T.table(spark, sf, "part").select("p_partkey", S.element_count(shape).alias("elements"))


def onnx_domains(spark, sf):
    domain = F.when(F.col("p_size") % 5 == 0, "ai.onnx").otherwise(F.lower("p_type"))
    return M.custom_domains(T.table(spark, sf, "part").select(F.col("p_brand").alias("artifact_id"), domain.alias("domain")))


def graph_inputs(spark, sf):
    parts = T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("artifact_id"),
        F.col("l_linenumber").cast("string").alias("name"),
        "l_partkey",
        "l_returnflag",
    )
    return M.filter_initializers(parts.drop("l_returnflag"), parts.filter("l_returnflag = 'R'"))


def counts(spark, sf):
    rows = _drift_rows(spark, sf)
    count = S.parse_count(F.col("declared_parameter_count"))
    return rows.select("artifact_id", count.alias("count"))


QUERIES = {
    "measured_parameters": lambda s, d: M.measured_parameters(_tensors(s, d)),
    "dominant_dtype": lambda s, d: M.dominant_dtype(_tensors(s, d)),
    "tensor_inventory": lambda s, d: M.tensor_inventory(
        _tensors(s, d).withColumn("artifact_id", F.col("dtype")), 64
    ).select("artifact_id", "position", "name", "tensor_count"),
    "metadata_lift": lift,
    "hyperparameters": lambda s, d: M.hyperparameters(_kv(s, d)),
    "lineage_collect": lambda s, d: M.lineage_collect(_kv(s, d)).select("artifact_id", "ord", "name", "url", "doi"),
    "quant_name": lambda s, d: T.table(s, d, "customer").select(
        "c_custkey", S.quantization_name((F.col("c_nationkey") * 2).cast("string")).alias("quantization")
    ),
    "custom_domains": onnx_domains,
    "filter_initializers": graph_inputs,
    "format_by_ext": lambda s, d: M.format_set(_files(s, d)),
    "primary_file": _primary,
    "peer_weights": lambda s, d: M.peer_weights(_files(s, d), _primary(s, d)),
    "component_set": components,
    "element_count": element_counts,
    "parse_count": counts,
    "human_count": lambda s, d: T.table(s, d, "orders").select(
        "o_orderkey", S.human_count(F.floor(F.col("o_totalprice") * F.col("o_custkey")).cast("bigint")).alias("label")
    ),
    "max_ratio": lambda s, d: T.table(s, d, "orders").select(
        "o_orderkey", F.round(S.max_ratio(F.col("o_totalprice") / F.lit(99991.0)), 6).alias("factor")
    ),
    "dtype_agrees": lambda s, d: _drift_rows(s, d).select(
        "artifact_id", S.dtype_agrees(F.col("declared_dtype"), F.col("dtype")).alias("agrees")
    ),
    "arch_agrees": lambda s, d: _drift_rows(s, d).select(
        "artifact_id", S.arch_agrees(F.col("declared_architecture"), F.col("architecture")).alias("agrees")
    ),
    "drift_param_count": lambda s, d: D.drift(T.read(s, d, T.PRICED_ORDERS), ["drift_param_count"]).select(
        "artifact_id", "id", "severity", "location"
    ),
    "drift_shards": lambda s, d: D.drift(
        D.shard_counts(T.read(s, d, T.SHARD_INDEX), T.read(s, d, T.SHARD_FILES)), ["drift_shards"]
    ).select("artifact_id", "id", "severity", "description"),
}
for _name in ("drift_architecture", "drift_dtype", "drift_quantization", "drift_mixed_formats"):
    QUERIES[_name] = lambda s, d, n=_name: D.drift(_drift_rows(s, d), [n]).select(
        "artifact_id", "id", "severity", "location"
    )
QUERIES["drift_all"] = lambda s, d: D.drift(_drift_rows(s, d)).select("artifact_id", "ord", "id", "severity", "location")

FORMAT_SQL = """CASE lower(regexp_extract(path, '(\\.[^.]*)$', 1)) WHEN '.gguf' THEN 'gguf' WHEN '.safetensors' THEN 'safetensors'
  WHEN '.onnx' THEN 'onnx' WHEN '.pkl' THEN 'pickle' WHEN '.h5' THEN 'keras' END"""
PRIMARY_SQL = """p AS (SELECT artifact_id, arg_min(path, struct_pack(a := CASE WHEN path LIKE '%.gguf' THEN 0 WHEN path LIKE '%.safetensors' THEN 1 ELSE 2 END, b := path))
  AS primary_path FROM f WHERE regexp_matches(path, '\\.(gguf|safetensors|onnx)$') GROUP BY 1)"""
DTYPE_SQL = "lower(CASE lower(trim(declared_dtype)) WHEN 'bfloat16' THEN 'BF16' WHEN 'float16' THEN 'F16' WHEN 'float32' THEN 'F32' ELSE declared_dtype END) = lower(dtype)"
ARCH_SQL = "(declared_architecture='' OR architecture='' OR contains(lower(declared_architecture), lower(architecture)) OR contains(lower(architecture), lower(declared_architecture)))"


def _parse_sql(column: str) -> str:
    t = f"replace(replace(lower(trim({column})), ',', ''), '_', '')"
    body = f"trim(CASE WHEN right({t},1) IN ('b','m','k') THEN left({t}, length({t})-1) ELSE {t} END)"
    mult = f"CASE right({t},1) WHEN 'b' THEN 1e9 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1.0 END"
    return f"CAST(floor(greatest(coalesce(TRY_CAST({body} AS DOUBLE), 0), 0) * {mult}) AS BIGINT)"


DRIFT_CASES = {
    "drift_architecture": f"""SELECT artifact_id, 0 AS k, 'AR-DRIFT-005' AS id, 'Low' AS severity, declared_source AS location FROM r
        WHERE declared_architecture<>'' AND architecture='' AND format='gguf'
        UNION ALL SELECT artifact_id, 1, 'AR-DRIFT-001', 'High', declared_source FROM r
        WHERE declared_architecture<>'' AND architecture<>'' AND NOT {ARCH_SQL}""",
    "drift_dtype": f"SELECT artifact_id, 2 AS k, 'AR-DRIFT-002' AS id, 'High' AS severity, declared_source AS location FROM r WHERE declared_dtype<>'' AND dtype<>'' AND NOT ({DTYPE_SQL})",
    "drift_quantization": "SELECT artifact_id, 3 AS k, 'AR-DRIFT-003' AS id, 'Medium' AS severity, declared_source AS location FROM r WHERE declared_quantization<>'' AND quantization<>'' AND lower(trim(declared_quantization))<>lower(trim(quantization))",
    "drift_shards": "SELECT artifact_id, 4 AS k, 'AR-DRIFT-004' AS id, 'High' AS severity, 'model.safetensors.index.json' AS location FROM r WHERE declared_shards>0 AND declared_shards<>present_shards",
    "drift_mixed_formats": "SELECT artifact_id, 5 AS k, 'AR-DRIFT-006' AS id, 'Medium' AS severity, first_peer AS location FROM r WHERE peer_count>0 AND format IN ('safetensors','gguf')",
    "drift_param_count": """SELECT artifact_id, 6 AS k, 'AR-DRIFT-007' AS id, 'High' AS severity, CASE WHEN declared_source='' THEN primary_path ELSE declared_source END AS location
        FROM (SELECT *, CASE WHEN d1>0 THEN d1 ELSE d2 END AS d FROM (SELECT *, """
    + _parse_sql("declared_parameter_count")
    + " AS d1, "
    + _parse_sql("size_label")
    + """ AS d2 FROM r)) WHERE d>0 AND measured_parameters>0 AND NOT (measured_parameters::DOUBLE/d > 0.80 AND measured_parameters::DOUBLE/d < 1.25)""",
}

ORACLES = {
    "measured_parameters": T.with_ctes(
        "SELECT artifact_id, CAST(sum(CASE WHEN rows_dim<=0 OR cols_dim<=0 THEN 0 ELSE rows_dim*cols_dim END) AS BIGINT) AS measured_parameters, count(*) AS tensor_count FROM t GROUP BY 1",
        t=T.TENSORS,
    ),
    "dominant_dtype": T.with_ctes(
        """SELECT artifact_id, dtype FROM (SELECT artifact_id, dtype, sum((CASE WHEN rows_dim>0 THEN rows_dim ELSE 1 END)*(CASE WHEN cols_dim>0 THEN cols_dim ELSE 1 END)) AS w FROM t GROUP BY 1,2)
        QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY w DESC, dtype)=1""",
        t=T.TENSORS,
    ),
    "tensor_inventory": T.with_ctes(
        """SELECT dtype AS artifact_id, row_number() OVER (PARTITION BY dtype ORDER BY ord, name) AS position, name, count(*) OVER (PARTITION BY dtype) AS tensor_count
        FROM t QUALIFY position <= 64""",
        t=T.TENSORS,
    ),
    "metadata_lift": T.with_ctes(
        """SELECT artifact_id, n AS name, u AS url, u AS repo_url, coalesce(l, ln) AS license,
          CASE coalesce(l, ln) WHEN 'apache 2.0' THEN 'Apache-2.0' WHEN 'llama3' THEN 'LicenseRef-Llama-3' WHEN 'mit' THEN 'MIT' WHEN 'House Terms/1' THEN 'LicenseRef-House-Terms-1' END AS license_id,
          a AS architecture, sz AS parameter_count,
          CASE ft WHEN '0' THEN 'F32' WHEN '2' THEN 'Q4_0' WHEN '8' THEN 'Q5_0' WHEN '10' THEN 'Q2_K' WHEN '12' THEN 'Q3_K_M' WHEN '14' THEN 'Q4_K_S'
            WHEN '16' THEN 'Q5_K_S' WHEN '18' THEN 'Q6_K' WHEN '20' THEN 'IQ2_XS' WHEN '22' THEN 'IQ3_XS' WHEN '24' THEN 'IQ1_S' WHEN '26' THEN 'IQ3_S'
            WHEN '28' THEN 'IQ2_S' WHEN '30' THEN 'IQ4_XS' WHEN '32' THEN 'BF16' ELSE 'file_type=' || ft END AS quantization,
          'gguf/ggml' AS framework
        FROM (SELECT artifact_id, max(value) FILTER (WHERE key='general.name') AS n, max(value) FILTER (WHERE key='general.repo_url') AS u,
           nullif(nullif(max(value) FILTER (WHERE key='general.license'), ''),'') AS l, nullif(max(value) FILTER (WHERE key='general.license.name'), '') AS ln,
           nullif(max(value) FILTER (WHERE key='general.architecture'),'') AS a, max(value) FILTER (WHERE key='general.size_label') AS sz,
           max(value) FILTER (WHERE key='general.file_type') AS ft FROM kv GROUP BY 1)""",
        kv=T.RAW_KV,
    ),
    # only llama has keys of its own; its vocabulary is left out
    "hyperparameters": """SELECT 'm' || c_custkey AS artifact_id, 'block.' || o_orderkey AS name, o_orderstatus AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey % 4 = 0
        UNION ALL SELECT 'm' || c_custkey, 'quantization_version', CAST(c_nationkey % 3 AS VARCHAR) FROM customer WHERE c_nationkey % 4 <> 3""",
    "lineage_collect": T.with_ctes(
        """SELECT artifact_id, CAST(split_part(key,'.',3) AS INTEGER) AS ord,
          max(value) FILTER (WHERE split_part(key,'.',4) IN ('name','organization')) AS name,
          max(value) FILTER (WHERE split_part(key,'.',4)='repo_url') AS url, max(value) FILTER (WHERE split_part(key,'.',4)='doi') AS doi
        FROM kv WHERE starts_with(key,'general.base_model.') AND value<>'' GROUP BY 1,2""",
        kv=T.RAW_KV,
    ),
    "quant_name": """SELECT c_custkey, CASE c_nationkey*2 WHEN 0 THEN 'F32' WHEN 2 THEN 'Q4_0' WHEN 8 THEN 'Q5_0' WHEN 10 THEN 'Q2_K' WHEN 12 THEN 'Q3_K_M' WHEN 14 THEN 'Q4_K_S'
        WHEN 16 THEN 'Q5_K_S' WHEN 18 THEN 'Q6_K' WHEN 20 THEN 'IQ2_XS' WHEN 22 THEN 'IQ3_XS' WHEN 24 THEN 'IQ1_S' WHEN 26 THEN 'IQ3_S'
        WHEN 28 THEN 'IQ2_S' WHEN 30 THEN 'IQ4_XS' WHEN 32 THEN 'BF16' ELSE 'file_type=' || (c_nationkey*2) END AS quantization FROM customer""",
    "custom_domains": "SELECT DISTINCT p_brand AS artifact_id, lower(p_type) AS domain FROM part WHERE p_size % 5 <> 0",
    "filter_initializers": """SELECT l_orderkey::VARCHAR AS artifact_id, l_linenumber::VARCHAR AS name, l_partkey FROM lineitem a
        WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey=a.l_orderkey AND b.l_linenumber=a.l_linenumber AND b.l_returnflag='R')""",
    "format_by_ext": T.with_ctes(
        f"SELECT DISTINCT artifact_id, {FORMAT_SQL} AS format FROM f WHERE {FORMAT_SQL} IS NOT NULL", f=T.FILES
    ),
    "primary_file": T.with_ctes(f", {PRIMARY_SQL} SELECT * FROM p", f=T.FILES).replace(") , p", "), p"),
    "peer_weights": T.with_ctes(
        f", {PRIMARY_SQL} SELECT artifact_id, path FROM (SELECT artifact_id, path FROM f QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY path)<=4096) WHERE regexp_matches(lower(path), '\\.(bin|pt|pth|ckpt|pkl|pickle|dill|joblib)$')",
        f=T.FILES,
    ).replace(") , p", "), p"),
    "component_set": T.with_ctes(
        """SELECT i.artifact_id, i.path, CASE WHEN i.path=min(i.path) OVER (PARTITION BY i.artifact_id) THEN 'primary' ELSE 'shard' END AS role
        FROM (SELECT DISTINCT * FROM i) i LEFT JOIN (SELECT DISTINCT artifact_id, path FROM f) f USING (artifact_id, path)
        QUALIFY f.path IS NOT NULL""",
        i=T.SHARD_INDEX,
        f=T.SHARD_FILES,
    ),
    "element_count": "SELECT p_partkey, CASE WHEN p_size<=1 OR floor(p_retailprice)<=0 THEN 0 ELSE (p_size-1)*CAST(floor(p_retailprice) AS BIGINT) END AS elements FROM part",
    "parse_count": T.with_ctes(
        f"SELECT artifact_id, {_parse_sql('declared_parameter_count')} AS count FROM r", r=T.DRIFT_ROWS
    ),
    "human_count": """SELECT o_orderkey, CASE WHEN n>=1000000000 THEN printf('%.1fB', n/1e9) WHEN n>=1000000 THEN printf('%.1fM', n/1e6) WHEN n>=1000 THEN printf('%.1fK', n/1e3)
        ELSE n::VARCHAR END AS label FROM (SELECT o_orderkey, CAST(floor(o_totalprice*o_custkey) AS BIGINT) AS n FROM orders)""",
    "max_ratio": "SELECT o_orderkey, round(CASE WHEN r<1 THEN 1/r ELSE r END, 6) AS factor FROM (SELECT o_orderkey, o_totalprice/99991.0 AS r FROM orders)",
    "dtype_agrees": T.with_ctes(f"SELECT artifact_id, {DTYPE_SQL} AS agrees FROM r", r=T.DRIFT_ROWS),
    "arch_agrees": T.with_ctes(f"SELECT artifact_id, {ARCH_SQL} AS agrees FROM r", r=T.DRIFT_ROWS),
    "drift_param_count": T.with_ctes(
        """SELECT artifact_id, 'AR-DRIFT-007' AS id, 'High' AS severity, 'orders' AS location FROM r
        WHERE CAST(declared_parameter_count AS DOUBLE)>0 AND measured_parameters>0
        AND NOT (measured_parameters/CAST(declared_parameter_count AS DOUBLE)>0.80 AND measured_parameters/CAST(declared_parameter_count AS DOUBLE)<1.25)""",
        r=T.PRICED_ORDERS,
    ),
    "drift_shards": T.with_ctes(
        """SELECT artifact_id, 'AR-DRIFT-004' AS id, 'High' AS severity, 'the index names ' || n || ' shard(s), present: ' || k AS description FROM (
        SELECT i.artifact_id, count(*) AS n, count(f.path) AS k FROM (SELECT DISTINCT artifact_id, path FROM i) i
        LEFT JOIN (SELECT DISTINCT artifact_id, path FROM f) f USING (artifact_id, path) GROUP BY 1) WHERE n<>k""",
        i=T.SHARD_INDEX,
        f=T.SHARD_FILES,
    ),
    "drift_all": T.with_ctes(
        "SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY k) - 1 AS ord, id, severity, location FROM ("
        + " UNION ALL ".join(f"({sql})" for sql in DRIFT_CASES.values())
        + ")",
        r=T.DRIFT_ROWS,
    ),
}
for _name in ("drift_architecture", "drift_dtype", "drift_quantization", "drift_mixed_formats"):
    ORACLES[_name] = T.with_ctes(
        f"SELECT artifact_id, id, severity, location FROM ({DRIFT_CASES[_name]})", r=T.DRIFT_ROWS
    )
