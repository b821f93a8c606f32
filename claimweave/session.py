"""Session helpers: builder defaults, shared storage for cut lineage, table access."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package when it is run from a checkout."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; Spark's reader opens the path, so it may be in any store."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, a scan without a shuffle (whose partitions can be told without running it), dealt out to all cores if it has fewer partitions.

    Text work costs far more than moving the text; a large table has partitions enough and stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Stored(NamedTuple):
    """A table written to the shared folder, and where."""

    df: DataFrame
    path: str


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir if the cluster names one.

    Unset on a local master (tests), a folder below the warehouse is used; unset on a
    cluster, that is an error, since executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_claimweave"


def store(df: DataFrame, tag: str) -> Stored:
    """Cut lineage: write df as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    STORED.append(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def store_by(df: DataFrame, tag: str, *keys: str, then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> Stored:
    """store, in as many buckets of the keys as a shuffle has partitions: a join or group on the keys moves no row of it, however often it is read.

    then: what is done where the buckets are made: a group on the keys and more has no shuffle of its own.
    """
    spark = df.sparkSession
    path, name = f"{shared_dir(spark)}/{tag}-{(own := uuid.uuid4().hex)}", f"{tag}_{own}".replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    then(df.repartition(n, *keys)).write.option("compression", "zstd").option("path", path).bucketBy(n, *keys).saveAsTable(name)
    STORED.append(path)
    NAMED[path] = name
    return Stored(spark.table(name), path)


#: Paths of stored tables that have not been discarded, in order.
STORED: list[str] = []
#: Names of those that store_by put into the session's catalog.
NAMED: dict[str, str] = {}


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Discard the tables stored since len(STORED) was since, but those in keep: when what was made of them is stored itself."""
    for path in [p for p in STORED[since:] if p not in keep]:
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no live plan reads any more."""
    if path in STORED:
        STORED.remove(path)
    if path in NAMED:
        spark.sql(f"drop table if exists {NAMED.pop(path)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns whose names clash (in any case) with those an operator adds."""
    taken = {n.lower() for n in names}
    clash = [f"`{c}`" for c in df.columns if c.lower() in taken]
    return df.drop(*[c.strip("`") for c in clash]) if clash else df
