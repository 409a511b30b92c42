"""Reference and input tables derived from the trade tables, over all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BAND = "CASE WHEN p_size <= 25 THEN 'Small' ELSE 'Big' END"
WORDS = "split(p_name, ' ')"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reference(spark: SparkSession, folder: str) -> DataFrame:
    """Two reference rows per part, its name and its size; the key is type, size band, attribute."""
    part = table(spark, folder, "part")
    key = ["p_type AS category", f"{BAND} AS sub_category"]
    names = part.selectExpr(
        "2 * p_partkey AS row_id", *key, "'Name' AS attribute_name", "p_name AS preset_value"
    )
    sizes = part.selectExpr(
        "2 * p_partkey + 1 AS row_id", *key, "'Size' AS attribute_name",
        "concat(p_size, 'mm') AS preset_value",
    )
    return names.unionByName(sizes)


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Three inputs per part and one per supplier.

    Names in four spellings, sizes with another unit spelling, labels under an attribute the
    reference does not have (only the whole table can match them), supplier names that match
    nothing.
    """
    part = table(spark, folder, "part")
    key = ["p_type AS category", f"{BAND} AS sub_category"]
    names = part.selectExpr(
        "3 * p_partkey AS input_id", *key, "'Name' AS attribute_name",
        """CASE p_partkey % 4
             WHEN 0 THEN p_name
             WHEN 1 THEN upper(p_name)
             WHEN 2 THEN replace(p_name, ' ', ', ')
             ELSE left(p_name, length(p_name) - 1)
           END AS input_value""",
    )
    sizes = part.selectExpr(
        "3 * p_partkey + 1 AS input_id", *key, "'Size' AS attribute_name",
        "concat(p_size, ' MM') AS input_value",
    )
    labels = part.selectExpr(
        "3 * p_partkey + 2 AS input_id", *key, "'Label' AS attribute_name",
        f"""CASE p_partkey % 4
              WHEN 0 THEN concat({WORDS}[1], ' ', {WORDS}[0])
              WHEN 1 THEN concat({WORDS}[1], '-', {WORDS}[0])
              WHEN 2 THEN concat(p_name, ' ', p_brand)
              ELSE concat(left({WORDS}[0], 3), ' ', {WORDS}[1])
            END AS input_value""",
    )
    suppliers = table(spark, folder, "supplier").selectExpr(
        "-1 - s_suppkey AS input_id", "'SUPPLIER' AS category",
        "concat('N', s_nationkey) AS sub_category", "'Name' AS attribute_name",
        "s_name AS input_value",
    )
    return names.unionByName(sizes).unionByName(labels).unionByName(suppliers)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Value pairs ``(a, b)``: every part's label against two spellings of its own label and
    against the label of the next part. Linear in the parts."""
    part = table(spark, folder, "part").selectExpr(
        "p_partkey", "concat(p_name, ' ', p_size, 'mm') AS a",
        f"""CASE p_partkey % 5
              WHEN 0 THEN concat(p_name, ', ', p_size, ' mm')
              WHEN 1 THEN concat({WORDS}[1], ' ', {WORDS}[0], ' ', p_size + 1, 'cm')
              WHEN 2 THEN concat(p_name, '-', lower(p_type))
              WHEN 3 THEN concat(lower(p_type), ' ', p_name, '.')
              ELSE concat(p_size * 2, '.5 v ', {WORDS}[0])
            END AS b""",
    )
    following = part.selectExpr("p_partkey - 1 AS p_partkey", "a AS b")
    near = part.select("p_partkey", "a").join(following, "p_partkey")
    return part.select("p_partkey", "a", "b").unionByName(near)


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Customer names as a reference; the key is segment and nation."""
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS row_id", "c_mktsegment AS category", "concat('N', c_nationkey) AS sub_category",
        "'Account' AS attribute_name", "c_name AS preset_value",
    )


def account_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """One input per order: its customer's account as an order form might spell it."""
    customer = table(spark, folder, "customer").selectExpr(
        "c_custkey AS o_custkey", "c_mktsegment", "c_nationkey"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return orders.join(customer, "o_custkey").selectExpr(
        "o_orderkey AS input_id", "c_mktsegment AS category",
        "concat('N', c_nationkey) AS sub_category", "'Account' AS attribute_name",
        """CASE o_orderkey % 3
             WHEN 0 THEN concat('CUSTOMER ', lpad(o_custkey, 9, '0'))
             WHEN 1 THEN concat('Cust. ', lpad(o_custkey, 9, '0'))
             ELSE concat('Customer#', lpad(o_custkey, 9, '0'))
           END AS input_value""",
    )


def raw_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as a raw table: nulls, blanks and padding in keys and values."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS row_id",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '  ' ELSE concat(' ', p_type) END AS `Category`",
        "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS `Sub-Category`",
        "CASE WHEN p_partkey % 20 = 0 THEN '' ELSE 'Name ' END AS `Attribute Name`",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('\\t', upper(p_name), ' ± ', p_size, ' °C,') WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(p_name, ' /  ', p_size, 'kΩ') END AS `Preset values`",
    )
