"""Streaming operators: windows with watermarks, sessions, duplicates, incremental graph state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from claimweave.session import STORED, shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1, schema: str = EVENTS) -> DataFrame:
    """A folder of Parquet files as a stream, with ts as a timestamp (timestamp_ntz takes no watermark)."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """T5: window_start, event_type, n, total of tumbling (or sliding) windows; batch or stream."""
    at = F.window("ts", width, slide or width)
    return events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """T5: user_id, session_start, session_end, n; batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """T5: events without repeats of an event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result table; the end of the query is the quiet test.

    Each micro-batch is a part of a table in the shared folder, so no result goes to the driver; mode
    complete keeps the last one, and a batch that is tried again replaces its own part.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    last: list[int] = []

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    writer = stream.writeStream.foreachBatch(add).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    STORED.append(path)
    made = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    return (made.where(F.col("batch") == last[0]) if mode == "complete" else made).drop("batch")


class EdgeState(StatefulProcessor):
    """One edge per (s, rel, o) over all micro-batches: highest utility, number of claims."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("edge", "utility double, n_claims long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, n = self.state.get() if self.state.exists() else (0.0, 0)
        for frame in rows:
            best, n = max(best, float(frame["utility"].max())), n + len(frame)
        self.state.update((best, n))
        yield pd.DataFrame({"s": [key[0]], "rel": [key[1]], "o": [key[2]], "utility": [best], "n_claims": [n]})

    def close(self) -> None:
        pass


def stateful_edges(claims: DataFrame) -> DataFrame:
    """A stream of claims (s, rel, o, utility) to updates of their edges; needs the RocksDB state store."""
    return claims.groupBy("s", "rel", "o").transformWithStateInPandas(EdgeState(), "s string, rel string, o string, utility double, n_claims long", "Update", "None")


def ingest(claims: DataFrame, path: str, checkpoint: str):
    """foreachBatch ingest: each micro-batch of claims becomes one part of the edge table at path.

    Parts are merged when read (merged_edges), so a batch that is tried again replaces its own part
    and no state is held on the driver.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return claims.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(edges: DataFrame, limit: int = 12000) -> DataFrame:
    """Node, degree, edges_seen over the first edges by edge_id: what a live view shows."""
    some = edges.orderBy("edge_id").limit(limit)
    return some.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
