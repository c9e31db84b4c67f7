"""The stages of the pipeline on tables without rows, with nulls in any column, repeated rows and texts of any kind."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "über", "日本", "x1", "the"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    same = prose(60)
    rows = [(i, prose(40), "en", "a", 0) for i in range(40)]
    rows += [(100, same, "en", "a", 0), (100, same, "en", "a", 0), (101, same + " end", "en", "b", 0), (None, same, None, None, None), (None, "only here " + prose(30), "en", "a", 0)]
    rows += [(None, "twice " * 9, "en", "a", 0), (None, "twice " * 9, "en", "a", 0), (None, None, None, None, None), (102, None, "en", "a", 0), (103, "", None, "", 0), (104, "word " * 4000, "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(30)), (None, prose(30)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def run(spark, pipeline, docs, sf_dir, out):
    sizes = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        sizes.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == pipeline.COLUMNS
    return sizes


def test_nulls_repeats_and_odd_texts(spark, sf_dir, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(run(spark, pipeline, docs, sf_dir, tmp_path)) == 5


def test_no_documents(spark, sf_dir, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert run(spark, pipeline, docs, sf_dir, tmp_path) == [0, 0, 0, 0, 0]


def test_one_row_of_each_group_stays(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = pipeline.near_duplicates(spark, docs, sf_dir).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 100 in ids and 101 not in ids
    without = sorted((r.text or "")[:5] for r in kept if r.doc_id is None)
    assert without == ["only ", "twice"]
