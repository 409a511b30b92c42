"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "attrlink", **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def stage_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a folder of its own. On a cluster a folder that
    every executor reaches has to be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="attrlink-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_MADE: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


@contextmanager
def staged_tables_removed(spark: SparkSession):
    """Tables that ``stage`` writes inside the block are deleted at its end, also after a failure.

    What was computed from them has to be written or collected by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        for path in made:
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store Spark sees it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Cuts the lineage at a point that several later steps read, survives the loss of executors,
    and gives the planner real sizes for its join choices.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for steps whose work is far larger than their bytes.

    Adaptive execution merges shuffle partitions by size; a few megabytes of values can stand for
    billions of pairs, so such steps name their number of partitions, which is then kept.
    """
    set_number = spark.conf.get("spark.sql.shuffle.partitions", "200")
    shuffle = int(set_number) if set_number.isdigit() else 200
    return max(shuffle, 2 * spark.sparkContext.defaultParallelism)
