"""The corpus pipeline: quality classifier, SimHash near duplicates, benchmark decontamination, mixing, token output.

Every stage takes ``(spark, docs, sf_dir)`` and returns rows with the columns of documents (the last: the index of the
token files it wrote). ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.llm import decontaminate, mixing, quality, simhash, tokens
from fleetrisk.llm.common import read
from fleetrisk.llm.queries import tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the model is trained on the labelled documents of this input."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays, once
    where rows repeat it. Rows without doc_id can name no group: of those, one of each text that no other row has stays.
    """
    marked = simhash.similar_groups(docs)
    first = marked.where("doc_id = component_id").select("doc_id").distinct()
    own = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = own.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)})
    named = own.where("doc_id is not null")
    kept = named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    others = own.where("doc_id is null").dropDuplicates(["h1", "h2"]).join(named.select("h1", "h2"), ["h1", "h2"], "left_anti")
    return kept.select(*COLUMNS).union(others.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which tiles cover half of a benchmark item."""
    return decontaminate.keep(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and time it is taken."""
    return mixing.mix(docs).select(*COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, and their index as read back from them."""
    path = tokens.shared_path(spark, "pipeline-shards")
    tokens.write(docs, tokenizer_json(), path)
    return tokens.read(spark, path)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]
#: A trained model, tilings and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = tokens.shared_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
