"""Work and memory that must not grow faster than the tables: what plans and tasks hold, on rows made here."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import chunked, compliance, drift
from fleetrisk.queries import documents, tables
from fleetrisk.session import ensure_checkpoint_dir, kept
from fleetrisk.sinks import parts, spdx, streams
from fleetrisk.sources import chunks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


class Given:
    """Stands for a table: what an operator gives to ``mapInArrow`` is run here."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_facts_of_many_ranges_leave_together():
    run = chunked.facts(Given())
    rows = [("a", "f%d.py" % i, 10, 0, b"", b"eval(x)\n%d" % i) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["artifact_id", "path", "size", "offset", "before", "content"])
    found = list(run([batch]))
    assert len(found) <= 4 and [p for b in found for p in b.column(1).to_pylist()] == [r[1] for r in rows]


def test_ranges_do_not_carry_the_whole_content(spark):
    whole = bytes(range(256)) * 5
    files = spark.createDataFrame([("a", "f", bytearray(whole)), ("a", "none", bytearray())], "artifact_id string, path string, content binary")
    cut = chunks.chunked(files, 100, 30)
    got = sorted((r.path, r.offset, bytes(r.before), bytes(r.content)) for r in cut.collect())
    assert got == sorted([("f", o, whole[max(0, o - 30) : o], whole[o : o + 100]) for o in range(0, 1280, 100)] + [("none", 0, b"", b"")])
    assert "transform(" in [line for line in plan(cut).splitlines() if "Generate" in line][0]


def test_totals_of_frameworks_do_not_triple_the_rows(spark):
    rows = [("a", "f", "Full"), ("a", "g", "None"), ("a", None, "Partial"), ("b", "f", None), (None, "f", "Full")]
    got = compliance.catalog_coverage(spark.createDataFrame(rows, "framework string, function string, automation string"))
    assert "Expand" not in plan(got)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        ("a", "f", 1, 1, 0, 0), ("a", "g", 1, 0, 0, 1), ("a", None, 1, 0, 1, 0), ("a", None, 3, 1, 1, 1), ("b", "f", 1, 0, 0, 0), ("b", None, 1, 0, 0, 0),
    ]))


def test_nodes_of_two_sections_are_made_by_one_join(spark):
    profiles = spark.createDataFrame([("m", "n", "ab")], "artifact_id string, name string, primary_sha256 string")
    files = spark.createDataFrame([("m", "f", "shard", "", "", "")], "artifact_id string, path string, role string, sha256 string, sha384 string, sha512 string")
    datasets = spark.createDataFrame([("m", 1, "d")], "artifact_id string, ord long, name string")
    findings = spark.createDataFrame([("m", 1, "i", "t", "High")], "artifact_id string, ord long, id string, title string, severity string")
    nodes = spdx.spdx_nodes(profiles, files, datasets, findings)
    assert plan(nodes).count("Join") == 2
    assert sorted(r.section for r in nodes.collect()) == ["dataset_ids", "datasets", "files", "limitations", "rel_files"]


def test_one_list_for_all_sections(spark):
    made = [("m", "b", 2, "x", "3"), ("m", "a", 2, "x", "2"), ("m", "a", 1, "z", "1"), ("m", "a", 2, "y", None), ("k", "other", 0, "", "9")]
    rows = spark.createDataFrame(made, "artifact_id string, section string, ord long, tie string, json string")
    got = parts.gather(rows, ["a", "b"])
    assert plan(got).count("collect_list") == 1
    assert {r.artifact_id: (r.a, r.b) for r in got.collect()} == {"m": (["1", "2", None], ["3"]), "k": ([], [])}


def test_nodes_of_streams_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    heads = spark.range(40).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("artifact_id"))
    rows = heads.select("artifact_id", F.lit("s").alias("section"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("tie"), F.lit("1").alias("json"))
    nodes = rows.mapInArrow(count, "artifact_id string, section string, ord bigint, tie string, json string")
    text = F.concat(F.lit("["), F.array_join("s", ","), F.lit("]"))
    streams.write(streams.pieces(heads, nodes, [streams.Section("s")], text), str(tmp_path / "out"))
    assert made.value == 40
    for at_once in (1, 10, 1 << 20):
        got = streams.read_documents(spark, str(tmp_path / "out"), at_once)
        assert {tuple(r) for r in got.collect()} == {("m%d" % i, "[1]") for i in range(40)}


def test_shards_are_counted_without_a_join(spark):
    schema = "artifact_id string, path string"
    index = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("a", None), (None, "1"), ("b", "9")], schema)
    files = spark.createDataFrame([("a", "1"), ("a", "3"), ("a", None), (None, "1"), ("c", "1")], schema)
    got = drift.shard_counts(index, files)
    assert "Join" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {("a", 3, 1), ("b", 1, 0), (None, 1, 0)}


def test_documents_of_a_small_table_are_read_by_all_tasks(spark, tmp_path):
    rows = [(i, "n%d" % i, i % 25) for i in range(200)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    found = documents._parsed_documents(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 4 and found.count() == documents.B.bom_detect(tables.read(spark, str(tmp_path), documents.DOCUMENTS)).filter("error IS NULL").count()


def test_nodes_of_streams_meet_their_heads_in_the_sort_only(spark):
    heads = spark.createDataFrame([("m",)], "artifact_id string")
    nodes = spark.createDataFrame([("m", "s", 1, "", "1"), ("gone", "s", 1, "", "1")], "artifact_id string, section string, ord long, tie string, json string")
    assert "Join" not in plan(streams.pieces(heads, nodes, [streams.Section("s")], F.array_join("s", ",")))


def test_kept_rows_are_compressed_and_leave_no_shuffle(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {f.split("/")[-1] for f in blocks.getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = shuffles()
    rows = spark.range(20000).select((F.col("id") % 50).alias("k"), F.repeat(F.lit("text "), 20).alias("t")).repartition(8, "k")
    got = kept(rows, "rows")
    assert shuffles() <= before
    assert sorted(r.t for r in got.groupBy("k").agg(F.count("t").alias("t")).collect()) == [400] * 50
    assert sum(os.path.getsize(f.removeprefix("file:")) for f in got.inputFiles()) < 200_000


@pytest.mark.parametrize("name", ["emit_cyclonedx", "emit_spdx"])
def test_a_stream_of_documents_takes_less_disk_than_their_text(spark, tmp_path, name):
    n = F.col("id")
    customer = spark.range(30).select(n.alias("c_custkey"), F.concat(F.lit("c"), n).alias("c_name"), (n % 25).cast("int").alias("c_nationkey"), n.cast("double").alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    order = [n.alias("o_orderkey"), (n % 29).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), n.cast("double").alias("o_totalprice"), F.lit("2026-01-01").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")]
    customer.write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(3000).select(*order).write.parquet(str(tmp_path / "orders.parquet"))
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    sizes = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared) for f in names)
    before = sizes()
    got = {tuple(r) for r in documents.QUERIES[f"{name}_stream"](spark, str(tmp_path)).collect()}
    assert sizes() - before < sum(len(t) for _, t in got) / 4
    assert len(got) == 30 and got == {tuple(r) for r in documents.QUERIES[name](spark, str(tmp_path)).collect()}
