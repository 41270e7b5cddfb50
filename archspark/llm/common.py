"""Reading the tables, and tables written to the shared folder to cut lineage.

All operators project the columns they need before anything else, so further
columns of the input, whatever their names, neither clash nor travel along.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch while a table is written.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local one on a single machine and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = Path(tempfile.gettempdir(), "archspark-checkpoints").as_uri()
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    The plan that follows starts from files that survive the loss of any executor,
    and Spark knows their size. They go with the application, or before with purge().
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/archspark-{spark.sparkContext.applicationId}"
    at = f"{home}/{tag}-{uuid.uuid4().hex[:12]}"
    with small_batches(spark):
        df.write.parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts are long rows: fewer of them in a batch for Python workers, in what runs meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(key, "10000")
    spark.conf.set(key, str(min(int(rows), BATCH_ROWS)) if int(rows) > 0 else str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, rows)


def purge(spark: SparkSession) -> None:
    """Removes the tables that settle() wrote in this application; frames built on them can't be read after it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/archspark-{spark.sparkContext.applicationId}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the bound; else Spark deals both sides out by the key."""
    return F.broadcast(df) if rows <= bound else df


#: A key above this share of the counted rows is heavy; there are at most as many of them as this number.
HEAVY = 1000


def join_counted(rows: DataFrame, keys: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with keys (one row for each key, `count`: how many of rows have it, or more), no task getting a heavy key's rows.

    Keys with more than a HEAVY-th of the counted rows are at most HEAVY, so they are
    broadcast; the others are dealt out by key.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    heavy = keys.filter(F.col(count) > total / HEAVY)
    light = keys.filter(F.col(count) <= total / HEAVY)
    one = rows.join(F.broadcast(heavy), key)
    return one.unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))
