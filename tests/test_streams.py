"""Documents written as chunk streams equal those assembled in a cell, and an aborted write leaves nothing."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import findings as O
from fleetrisk.sinks import sarif, streams
from fleetrisk.sinks import parts as J

NOW = "2026-01-01T00:00:00Z"
FINDINGS = "artifact_id string, scanner string, ord long, id string, title string, severity string, category string, location string, description string"


def inputs(spark):
    rows = []
    for artifact, n in (("big", 700), ("small", 3), ("other", 40)):
        rows += [(artifact, "s", i, f"AR-X-{i % 17:03d}", f't "{i}"\\', ["Critical", "Low", "High"][i % 3], "model", f"p{i}", "d\né") for i in range(n)]
    profiles = spark.createDataFrame([(a, a, "w.bin", "ab" * 32, None, None) for a in ("big", "small", "other", "bare")], "artifact_id string, name string, primary_path string, primary_sha256 string, primary_sha384 string, primary_sha512 string")
    found = O.normalized(spark.createDataFrame(rows, FINDINGS))
    return profiles, sarif.sarif_nodes(profiles, found)


@pytest.mark.parametrize("partitions", ["1", "7", "60"])
def test_streams_equal_cells(spark, tmp_path, partitions):
    """With many partitions a document reaches over several tasks, inside one list as well."""
    profiles, nodes = inputs(spark)
    want = {r.artifact_id: r.document for r in sarif.emit_sarif(profiles, nodes, NOW).collect()}
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        streams.write(sarif.sarif_pieces(profiles, nodes, NOW), str(tmp_path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.artifact_id: r.document for r in streams.read_documents(spark, str(tmp_path)).collect()} == want
    assert len(json.loads(want["big"])["runs"][0]["results"]) == 700
    index = {r.artifact_id: r.pieces for r in streams.read_index(spark, str(tmp_path)).collect()}
    assert (len(index["big"]) > 1) == (partitions != "1")
    out = io.BytesIO()
    streams.copy_document(str(tmp_path), index["big"], out, at_once=100)
    assert out.getvalue().decode() == want["big"]


def test_lists_inside_strings_and_missing_lists(spark, tmp_path):
    heads = spark.createDataFrame([("a",), ("b",), ("c",)], "artifact_id string")
    nodes = spark.createDataFrame([("a", "lines", 2, "", 'x "2"\n'), ("a", "lines", 1, "", "é1"), ("a", "list", 1, "t", "{}"), ("b", "list", 1, "t", None), ("gone", "list", 1, "t", "1")], "artifact_id string, section string, ord long, tie string, json string")
    text = F.when(F.size("lines") > 0, F.array_join("lines", "\n"))
    document = J.splice(J.members(J.leaf(id=F.col("artifact_id"), lines=text)), J.member("list", J.joined(F.col("list"))))
    cells = {r.artifact_id: r.document for r in J.assembled(heads, nodes.filter("json is not null"), ["lines", "list"], document).collect()}
    streams.write(streams.pieces(heads, nodes.filter("json is not null"), [streams.Section("lines", True), streams.Section("list")], document), str(tmp_path))
    assert {r.artifact_id: r.document for r in streams.read_documents(spark, str(tmp_path)).collect()} == cells
    assert json.loads(cells["a"])["lines"] == 'é1\nx "2"\n'


def test_no_documents(spark, tmp_path):
    profiles, nodes = inputs(spark)
    streams.write(sarif.sarif_pieces(profiles.filter("false"), nodes, NOW), str(tmp_path))
    assert streams.read_documents(spark, str(tmp_path)).count() == 0


def on_disk(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_chunk_files_are_compressed(spark, tmp_path):
    profiles, nodes = inputs(spark)
    want = {r.artifact_id: r.document for r in sarif.emit_sarif(profiles, nodes, NOW).collect()}
    streams.write(sarif.sarif_pieces(profiles, nodes, NOW), str(tmp_path))
    assert on_disk(tmp_path / "chunks") < sum(len(t.encode()) for t in want.values()) / 4
    assert {r.artifact_id: r.document for r in streams.read_documents(spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("frame", [1, 50, 4096])
def test_documents_begin_anywhere_in_frames(spark, tmp_path, frame):
    """In small frames, over several tasks, with nodes that have no head, or no artifact, beside documents without text."""
    heads = spark.createDataFrame([(f"a{i:02d}",) for i in range(0, 40, 2)] + [(None,)], "artifact_id string").repartition(3)
    rows = [(f"a{i:02d}", "list", k, "", f'"{i}-{k}é"') for i in range(41) for k in range(0 if i % 5 == 0 else 300 if i in (11, 12) else 7)]
    nodes = spark.createDataFrame(rows + [(None, "list", 1, "", "0"), ("a02", "list", 9, "", None), ("a02", "other", 9, "", "1")], "artifact_id string, section string, ord long, tie string, json string")
    document = F.coalesce(J.joined(F.col("list")), F.lit(""))
    cells = {r.artifact_id: r.document for r in J.assembled(heads, nodes.filter("json is not null"), ["list"], document).collect()}
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        streams.write(streams.pieces(heads, nodes, [streams.Section("list")], document), str(tmp_path), frame)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.artifact_id: r.document for r in streams.read_documents(spark, str(tmp_path)).collect()} == cells
    assert cells["a00"] == cells[None] == "" and len(json.loads(cells["a12"])) == 300
    for r in streams.read_index(spark, str(tmp_path)).collect():
        out = io.BytesIO()
        streams.copy_document(str(tmp_path), r.pieces, out, at_once=7)
        assert out.getvalue().decode() == cells[r.artifact_id]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select(F.col("id").cast("string").alias("artifact_id"), F.lit(0).alias("slot"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("tie"), F.lit("").alias("separator"), F.when(F.col("id") == 3999, F.raise_error(F.lit("stop"))).otherwise("x").cast("string").alias("text"))
    with pytest.raises(Exception, match="stop"):
        streams.write(rows, str(tmp_path))
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []
