"""Reading reference and input tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clean as C
from ..schema import REFERENCE_COLUMNS, REFERENCE_HEADERS
from ..session import stage
from .xlsx import read_xlsx

# one row of about a hundred bytes per split
SPLITS_TO_BROADCAST = 500_000


def read_table(
    spark: SparkSession, path: str, file_format: str | None = None, **options
) -> DataFrame:
    """Read one table; text formats come in as strings, never with inferred types.

    The format follows the file ending unless given: parquet, csv, json, orc or xlsx.
    """
    if file_format is None:
        ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
        file_format = ending if ending in ("csv", "json", "orc", "xlsx") else "parquet"
    if file_format == "xlsx":
        return read_xlsx(spark, path, **options)
    if file_format == "csv":
        options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', **options}
    if file_format == "json":
        options = {"primitivesAsString": True, **options}
    return spark.read.options(**options).format(file_format).load(path)


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row positions in source order: 0, 1, 2 ... over files by path, then rows by place.

    A column of that name is kept as it is. Parquet files know the place of each row, whatever splits they
    are read in; a row's number is that place plus the rows of the files before. Formats without such a
    place, and tables that do not come from files, are written once to the shared folder together with
    split and place, and that copy is numbered: splits differ from read to read, a written copy does not.
    """
    if name in df.columns:
        return df
    try:
        source = F.col("_metadata")
        placed = df.withColumns({"_path": source["file_path"], "_place": source["row_index"]})
        groups = placed.groupBy("_path").agg((F.max("_place") + 1).alias("_rows"), F.lit(0).cast("long").alias("_first"))
        keys = ["_path"]
    except AnalysisException:
        place = F.monotonically_increasing_id()
        try:
            source = F.col("_metadata")
            placed = df.withColumns({"_path": source["file_path"], "_start": source["file_block_start"], "_place": place})
        except AnalysisException:
            number = F.spark_partition_id().cast("long")
            placed = df.withColumns({"_path": F.lit(""), "_start": number, "_place": place})
        placed = stage(placed, "numbered")
        keys = ["_path", "_start"]
        groups = placed.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = stage(running_sums(groups, keys), "splits")
    if before.count() <= SPLITS_TO_BROADCAST:
        before = F.broadcast(before)
    missing = F.raise_error(F.lit("a file changed while its rows were numbered")).cast("long")
    position = F.coalesce(F.col("_before") + F.col("_place") - F.col("_first"), missing)
    return placed.join(before, keys, "left").withColumn(name, position).drop(*keys, "_place", "_first", "_before")


def running_sums(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` with ``_before``, the sum of ``_rows`` over all groups before by ``keys``.

    Groups are dealt to ranges of the keys; a range sums its own, and one row per range is summed over all."""
    ranged = groups.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    all_before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_rows").alias("_total"))
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(all_before), F.lit(0)))
    own_before = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("_rows").over(own_before), F.lit(0))
    joined = ranged.withColumn("_inner", inner).join(totals, "_range")
    return joined.select(*keys, "_first", (F.col("_offset") + F.col("_inner")).alias("_before"))


def load_reference(df: DataFrame) -> DataFrame:
    """A raw reference table checked, numbered, cleaned and with computed columns."""
    df = C.use_headers(df, REFERENCE_HEADERS)
    C.require_columns(df, REFERENCE_COLUMNS)
    return C.add_computed_columns(C.clean_reference(with_row_ids(df)))


def load_inputs(df: DataFrame, compat_positional: bool = False) -> DataFrame:
    """A raw input table with its columns recognised, numbered and cleaned."""
    return C.clean_inputs(with_row_ids(df, "input_id"), compat_positional)
