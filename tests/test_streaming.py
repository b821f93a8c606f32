"""Streams agree with batches; state and late data follow the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimweave.streaming import events as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    df = spark.read.parquet(EVENTS).orderBy("ts")
    rows = df.collect()
    third = len(rows) // 3
    for k in range(3):
        spark.createDataFrame(rows[k * third : (k + 1) * third if k < 2 else None], df.schema).coalesce(1).write.mode("append").parquet(path)
    late = spark.createDataFrame([(10**9, dt.datetime(2030, 1, 1), 0, "flush", 0.0, "{}")], df.schema)
    late.coalesce(1).write.mode("append").parquet(path)
    return path


def batch(spark):
    return spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def same(a, b):
    key = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    return key(a) == key(b)


def test_tumbling_stream_equals_batch(spark, folder):
    got = S.drain(S.tumbling(S.event_stream(spark, folder, 100)), "tumbling").where("event_type <> 'flush'")
    assert same(got, S.tumbling(batch(spark)))


def test_session_stream_equals_batch(spark, folder):
    got = S.drain(S.sessions(S.event_stream(spark, folder, 100)), "sessions").where("year(session_start) < 2030")
    assert same(got, S.sessions(batch(spark)))


def test_duplicates_are_dropped(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).limit(50)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    got = S.drain(S.once_each(S.event_stream(spark, str(tmp_path / "d"), 2), "400 days"), "once")
    assert got.count() == rows.count()


def test_edges_keep_state_over_batches(spark, tmp_path):
    schema = "s string, rel string, o string, utility double"
    for u in (0.4, 0.9, 0.2):
        spark.createDataFrame([("a", "is", "b", u), ("a", "is", "c", u)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    got = S.drain(S.stateful_edges(stream), "edge_state", "update").groupBy("s", "rel", "o").agg(F.max("utility").alias("u"), F.max("n_claims").alias("n")).collect()
    assert {(r["o"], r["u"], r["n"]) for r in got} == {("b", 0.9, 3), ("c", 0.9, 3)}


def test_ingest_replaces_a_repeated_batch(spark, tmp_path):
    schema = "s string, rel string, o string, utility double"
    spark.createDataFrame([("a", "is", "b", 0.5)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    S.ingest(stream, str(tmp_path / "edges"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "edges")).select("s", "o").collect() == [("a", "b")]
