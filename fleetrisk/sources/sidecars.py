"""Files beside the weights: configuration, shard index and model card. Input ``(artifact_id, body)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from ..functions.lookups import nullif_empty
from ..functions.paths import hub_url
from ..session import tolerate_repeated_keys

CONFIG = (
    "architectures array<string>, model_type string, torch_dtype string, dtype string, "
    "quantization_config struct<quant_method:string,bits:int>, num_parameters variant"
)


def sidecar_config(documents: DataFrame) -> DataFrame:
    """Declared facts of ``config.json``; a text that is not a JSON object declares nothing."""
    tolerate_repeated_keys(documents.sparkSession)
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json("body")), F.lit("OBJECT"))
    rows = documents.filter(F.coalesce(is_object, F.lit(False))).withColumn("j", F.from_json("body", CONFIG))
    c = F.col
    method = nullif_empty(c("j.quantization_config.quant_method"))
    bits = c("j.quantization_config.bits")
    first = F.when(F.size("j.architectures") > 0, c("j.architectures")[0])
    number_kind = F.schema_of_variant("j.num_parameters")
    as_text = F.try_variant_get("j.num_parameters", "$", "string")
    as_number = F.round(F.try_variant_get("j.num_parameters", "$", "decimal(38,4)"), 0).cast("decimal(38,0)").cast("string")
    count = F.when(number_kind == "STRING", as_text).when(
        number_kind.isin("BIGINT", "DOUBLE") | F.startswith(number_kind, F.lit("DECIMAL")), as_number
    )
    return rows.select(
        "artifact_id",
        F.lit("config.json").alias("declared_source"),
        F.when(F.size("j.architectures") > 0, nullif_empty(first)).otherwise(nullif_empty(c("j.model_type"))).alias("declared_architecture"),
        F.coalesce(nullif_empty(c("j.torch_dtype")), nullif_empty(c("j.dtype"))).alias("declared_dtype"),
        F.when(bits > 0, F.concat(method, F.lit("-"), bits, F.lit("bit"))).otherwise(method).alias("declared_quantization"),
        nullif_empty(count).alias("declared_parameter_count"),
    )


def sidecar_index(documents: DataFrame) -> DataFrame:
    """Distinct shard names of a weight index, one row each."""
    weights = F.from_json("body", "weight_map map<string,string>")["weight_map"]
    return documents.select("artifact_id", F.explode(F.array_distinct(F.map_values(weights))).alias("path"))


CARD_STATE = "struct<key:string,pairs:array<struct<key:string,value:string,listed:boolean>>>"


def frontmatter(body: Column) -> Column:
    """Pairs of a model card's front matter: scalars as they are, list items one pair each.

    A fold over the lines of one small text, kept inside its row: which list an item belongs to depends on
    the last key line before it.
    """
    opened = F.startswith(body, F.lit("---"))
    rest = F.substr(body, F.lit(4))
    end = F.locate("\n---", rest)
    block = F.when(opened & (end > 0), F.left(rest, end - 1))

    def pair(key: Column, value: Column, listed: bool) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), F.lit(listed).alias("listed"))

    def step(acc: Column, line: Column) -> Column:
        text = S.strip(line)
        ignored = (text == "") | F.startswith(text, F.lit("#"))
        item = F.startswith(text, F.lit("- "))
        listed = F.btrim(F.substr(text, F.lit(3)), F.lit("\"' "))
        colon = F.locate(":", text)
        nested = (line != text) & F.startswith(line, F.lit("  "))
        key = S.strip(F.left(text, colon - 1))
        value = F.btrim(S.strip(F.substr(text, colon + 1)), F.lit("\"'"))
        none = F.lit(None).cast("string")
        added = (
            F.when(item & acc["key"].isNotNull(), F.array(pair(acc["key"], listed, True)))
            .when(~item & (colon > 0) & ~nested & (value != ""), F.array(pair(key, value, False)))
            .otherwise(F.array().cast("array<struct<key:string,value:string,listed:boolean>>"))
        )
        current = (
            F.when(item, acc["key"]).when((colon > 0) & ~nested & (value == ""), key).otherwise(none)
        )
        return F.struct(
            F.when(ignored, acc["key"]).otherwise(current).alias("key"),
            F.when(ignored, acc["pairs"]).otherwise(F.concat(acc["pairs"], added)).alias("pairs"),
        ).cast(CARD_STATE)

    start = F.struct(
        F.lit(None).cast("string").alias("key"),
        F.array().cast("array<struct<key:string,value:string,listed:boolean>>").alias("pairs"),
    ).cast(CARD_STATE)
    return F.aggregate(F.split(block, "\n"), start, step)["pairs"]


def sidecar_card(documents: DataFrame) -> DataFrame:
    """License, base model, datasets, task and library a card declares; lists are joined with commas."""
    rows = documents.select("artifact_id", frontmatter(F.col("body")).alias("pairs")).filter(F.size("pairs") > 0)

    def field(name: str) -> Column:
        own = F.filter("pairs", lambda p: p["key"] == name)
        last = F.try_element_at(own, F.lit(-1))
        joined = F.array_join(F.transform(F.filter(own, lambda p: p["listed"]), lambda p: p["value"]), ",")
        return nullif_empty(F.when(last["listed"], joined).otherwise(last["value"]))

    return rows.select(
        "artifact_id",
        F.lit("README.md").alias("declared_source"),
        field("license").alias("license"),
        field("base_model").alias("base_model"),
        field("datasets").alias("datasets"),
        field("pipeline_tag").alias("task"),
        field("library_name").alias("library"),
    )


def card_references(cards: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Base models and datasets a card names, without those already ``known(artifact_id, kind, name)``."""

    def split(column: str, kind: str) -> Column:
        names = F.filter(F.transform(F.split(column, ","), S.strip), lambda n: n != "")
        return F.transform(
            F.array_distinct(names),
            lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), hub_url(n, "dataset" if kind == "dataset" else "model").alias("url")),
        )

    empty = F.array().cast("array<struct<kind:string,name:string,url:string>>")
    both = F.concat(F.coalesce(split("base_model", "base_model"), empty), F.coalesce(split("datasets", "dataset"), empty))
    rows = cards.select("artifact_id", F.explode(both).alias("r")).select("artifact_id", "r.*")
    if known is None:
        return rows
    return rows.join(known.select("artifact_id", "kind", "name").distinct(), ["artifact_id", "kind", "name"], "left_anti")
