"""Written tables and the pipeline as a whole."""

import os

import pytest

import corpus_pipeline
from coordspark.llm import common


def test_written_tables_can_be_cleared(spark):
    df = common.written(spark.range(5).selectExpr("id", "cast(null as string) s"), "some")
    assert df.count() == 5 and common.written(df.where("false"), "none").count() == 0
    folder = common.shared_folder(spark).removeprefix("file://")
    assert os.path.isdir(f"{folder}/coordspark")
    common.clear_written(spark)
    assert not os.path.isdir(f"{folder}/coordspark")


def test_small_is_by_counted_rows(spark):
    df = spark.range(1000)
    plan = lambda x: x._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(common.small(df, 10, 10_000)) and "broadcast" not in plan(common.small(df, 11, 10_000))


class _Session:
    """As much of a session as shared_folder reads."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder or default)})


def test_the_shared_folder_is_the_sessions():
    assert common.shared_folder(_Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        common.shared_folder(_Session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_folder(_Session("local-cluster[2,1,1024]"))
    own = common.shared_folder(_Session("local[4]"))
    assert own == common.shared_folder(_Session("local")) and os.path.isdir(own.removeprefix("file://"))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = common.new_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "token_ids":
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() >= 0.8 * before.select("doc_id").distinct().count()
    tokens = docs.orderBy("start").collect()
    assert len(tokens) == before.count() and tokens[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(tokens, tokens[1:], strict=False))


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
