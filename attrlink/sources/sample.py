"""Sample rows drawn from fixed pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The pools of the sample generator.
POOLS = {
    "category": ["Switches", "Connectors", "Sensors", "Resistors", "Capacitors"],
    "sub_category": ["Push Button", "Terminal Block", "Temperature", "Carbon Film", "Ceramic"],
    "attribute_name": ["Brand", "Voltage", "Current", "Resistance", "Capacitance"],
    "input_value": [
        "EAO, 02", "24V", "1A", "10kΩ", "100µF", "IDEC, AL6", "12V", "2A", "1kΩ", "47µF",
    ],
}


def draw(df: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """One sample row per id; each field is drawn by a hash of id, field and seed, so the rows do
    not depend on partitions or reruns."""

    def pick(name, pool):
        digest = F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.lit(name), F.lit(str(seed))))
        place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(pool)
        return F.element_at(F.array(*(F.lit(v) for v in pool)), (place + 1).cast("int"))

    return df.select(
        F.col(id_column).alias("input_id"), *(pick(n, p).alias(n) for n, p in POOLS.items())
    )


def sample_inputs(spark: SparkSession, n: int = 10, seed: int = 42) -> DataFrame:
    return draw(spark.range(n), "id", seed)
