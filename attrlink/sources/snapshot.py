"""Snapshots of the prepared reference table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as C
from ..schema import REFERENCE_COLUMNS
from .tables import load_reference, with_row_ids

COMPUTED = ["normalized", "composite_key", "has_units", "has_numbers", "has_commas"]
VERSION = T.StructType(
    [T.StructField("version", T.StringType()), T.StructField("written", T.TimestampType())]
)


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones, then point to it; readers never see half a table."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/version={version}")
    spark = df.sparkSession
    pointer = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("written")
    )
    pointer.coalesce(1).write.mode("append").json(f"{path}/current")
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    try:
        row = spark.read.schema(VERSION).json(f"{path}/current").agg(
            F.max_by("version", "written").alias("version")
        ).first()
    except AnalysisException:
        return None
    return row["version"]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return spark.read.parquet(f"{path}/version={version}") if version else None


def load_or_build(spark: SparkSession, path: str, source) -> DataFrame:
    """The snapshot if there is one, else ``source()`` prepared and written as the first."""
    found = read_snapshot(spark, path)
    if found is not None:
        return found
    write_snapshot(load_reference(source()), path)
    return read_snapshot(spark, path)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Clean again, compute again and replace the snapshot."""
    raw = df.drop(*COMPUTED)
    write_snapshot(C.add_computed_columns(C.clean_reference(with_row_ids(raw))), path)
    return read_snapshot(df.sparkSession, path)


def snapshot_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether a snapshot exists, its bytes and files, and when it was written."""
    version = current_version(spark, path)
    if version is None:
        return spark.range(1).select(
            F.lit(False).alias("exists"), F.lit(0).cast("long").alias("bytes"),
            F.lit(0).cast("long").alias("files"), F.lit(None).cast("timestamp").alias("modified"),
        )
    meta = F.col("_metadata")
    files = spark.read.parquet(f"{path}/version={version}").select(
        meta["file_path"].alias("file"), meta["file_size"].alias("size"),
        meta["file_modification_time"].alias("modified"),
    )
    return files.distinct().agg(
        F.lit(True).alias("exists"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count("*").alias("files"), F.max("modified").alias("modified"),
    )


def upsert(reference: DataFrame, changes: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Apply keyed edits: rows of ``changes`` replace or join the rows of the same ``row_id``,
    rows of ``deleted`` go. Only the changes are cleaned and computed again."""
    changes = C.add_computed_columns(C.clean_reference(changes.drop(*COMPUTED)))
    touched = changes.select("row_id")
    if deleted is not None:
        touched = touched.unionByName(deleted.select("row_id"))
    kept = C.add_computed_columns(reference).join(touched.distinct(), "row_id", "left_anti")
    columns = ["row_id", *REFERENCE_COLUMNS, *COMPUTED]
    return kept.select(*columns).unionByName(changes.select(*columns))
