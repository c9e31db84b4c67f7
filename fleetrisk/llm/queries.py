"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, divergence, exact, fingerprint, hosts, mixing, oracles, phrases, quality, repeats, secrets, simhash, tokens
from .common import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The vocabulary file that the driver reads once; executors get its text."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.shared_path(spark, "token-shards")
    tokens.write(read(spark, sf_dir, "documents"), tokenizer_json(), path)
    return tokens.read(spark, path)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "pieces")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", quality.held_out(scored.doc_id))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.coverage(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    path = tokens.shared_path(spark, "chat")
    chat.render(turns).write.parquet(path)
    return chat.read_back(spark.read.parquet(path))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(read(spark, sf_dir, "pages"), RULES)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_versions(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_paragraph_sketch, op3_token_packing, op4_source_mixing, op5_chat_format, op6_quality_classifier, op7_decontamination, op8_simhash_golay, op9_host_reputation, op10_secret_scan, op11_collocations, op12_source_divergence, op13_exact_dedup)}
ORACLES: dict[str, str] = {"op5_chat_format": oracles.OP5, "op11_collocations": oracles.OP11, "op12_source_divergence": oracles.OP12, "op13_exact_dedup": oracles.OP13}
