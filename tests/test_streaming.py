"""Arriving scans against the batch operators."""

import datetime
import random

import pytest

from fleetrisk.operators import findings as O
from fleetrisk.streaming import arrivals

ARRIVING = arrivals.FINDING + ", origin string"
EVENT = "artifact_id string, rule string, kind string, severity string, expires_at timestamp, at timestamp"


@pytest.fixture(autouse=True)
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", arrivals.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, tmp_path, schema, batches, transform, mode="append"):
    """Rows that come out when each of ``batches`` is a micro-batch."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream = transform(source).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.append(df.collect())).option("checkpointLocation", str(tmp_path / "state"))
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return out


def finding(rng, origin, ord_):
    k = rng.randrange(6)
    return ("m", "s", ord_, f"AR-{k}", "t", rng.choice(["High", "Low"]), rng.choice(["drift", "model"]), rng.choice(["a", "b", None]), f"d{ord_}", origin)


def test_merge_and_tally_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(1)
    parsed = [[finding(rng, "parsed", 100 * b + i) for i in range(4)] for b in range(2)]
    walked = [[finding(rng, "walked", 1000 + 100 * b + i) for i in range(12)] for b in range(3)]
    batches = [parsed[0] + parsed[1], *walked]
    got = [tuple(r) for rows in run(spark, tmp_path / "m", ARRIVING, batches, arrivals.merge_arriving) for r in rows]
    frame = lambda rows: spark.createDataFrame([r[:-1] for r in rows], arrivals.FINDING)
    want = [tuple(r) for r in O.merge_findings(frame(sum(parsed, [])), frame(sum(walked, []))).select(*[c.split()[0] for c in arrivals.FINDING.split(", ")]).collect()]
    assert sorted(got) == sorted(want)
    tallies = run(spark, tmp_path / "t", ARRIVING, batches, lambda s: O.tally(O.normalized(s.drop("origin"))), "complete")
    assert sorted(map(str, tallies[-1])) == sorted(map(str, O.tally(O.normalized(frame(sum(batches, [])))).collect()))


def test_waivers_end_with_their_time(spark, tmp_path):
    t = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    batches = [
        [("a", "r", "violation", "High", None, t(0)), ("b", "r", "waiver", None, None, t(0)), ("c", "r", "violation", "Low", None, t(0))],
        [("a", "r", "waiver", None, t(10), t(1)), ("b", "r", "violation", "Critical", None, t(2)), ("a", "q", "waiver", None, t(3), t(2))],
        [("z", "r", "violation", "Low", None, t(20))],
        [("z", "q", "violation", "Low", None, t(21)), ("a", "q", "violation", "Low", None, t(21))],
    ]
    got = sorted((r.artifact_id, r.rule, r.at.minute, r.severity, r.waived) for rows in run(spark, tmp_path, EVENT, batches, arrivals.waive_arriving) for r in rows)
    assert got == sorted([
        ("a", "r", 0, "High", False), ("a", "r", 1, "High", True), ("a", "r", 10, "High", False),
        ("b", "r", 2, "Critical", True), ("c", "r", 0, "Low", False),
        ("z", "r", 20, "Low", False), ("z", "q", 21, "Low", False), ("a", "q", 21, "Low", False),
    ])
