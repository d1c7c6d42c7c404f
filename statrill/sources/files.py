"""Tables that series come from, other than those at hand: CSV files and a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header line, by a stated schema, so that they are read once; what does not fit it is null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", dateFormat="yyyy-MM-dd")


def sample(spark: SparkSession, n: int = 48) -> DataFrame:
    """month, value: a steady series of months that shifts after two thirds of them, for trying things out."""
    i = F.col("id")
    value = 10 + F.sin(i * 2.4) + F.when(3 * i >= 2 * n, 4.0).otherwise(0.0)
    return spark.range(n).select(F.add_months(F.lit("2023-01-01").cast("date"), i.cast("int")).alias("month"), F.round(value, 2).alias("value"))
