"""Windows over event streams, the same for a table and for a stream. These are additions, not counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    return df.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, width: str, step: str, *keys: str) -> DataFrame:
    return df.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
