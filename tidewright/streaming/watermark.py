"""Late rows: a row is late if its event time is before the watermark that held when its batch began."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import DataError, SpecError

#: The inner column of event times; no file or stream has a column of this name.
EVENT_TIME = "\x00event_time"
POLICIES = ("drop", "quarantine", "append")


def lateness(text: str) -> timedelta:
    """The time part of an ISO-8601 duration: PT1H30M, PT10S; days are refused."""
    m = re.fullmatch(r"P(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m:
        raise SpecError(f"not a duration of hours, minutes and seconds: {text}")
    return timedelta(hours=int(m[1] or 0), minutes=int(m[2] or 0), seconds=float(m[3] or 0))


def with_event_time(df: DataFrame, field: str, zoneless_is_utc: bool = False) -> DataFrame:
    """``EVENT_TIME`` as an instant; times without a zone are refused unless said to be UTC."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.TimestampType):
        return df.withColumn(EVENT_TIME, F.col(f"`{field}`"))
    if isinstance(kind, T.TimestampNTZType):
        if not zoneless_is_utc:
            raise DataError(f"{field} has no time zone")
        return df.withColumn(EVENT_TIME, F.to_utc_timestamp(F.col(f"`{field}`").cast("timestamp"), F.current_timezone()))
    if isinstance(kind, T.StringType):
        c = F.col(f"`{field}`")
        zoned = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        if not zoneless_is_utc and not df.filter(c.isNotNull() & ~zoned).isEmpty():
            raise DataError(f"{field} has times without a zone")
        return df.withColumn(EVENT_TIME, F.to_timestamp(F.when(zoned, c).otherwise(F.concat(c, F.lit("Z")))))
    raise DataError(f"{field} is no time")


def parted(df: DataFrame, watermark, policy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(rows to load, rows set aside) of a batch with ``EVENT_TIME``; the first batch (no watermark) has no late rows."""
    if policy not in POLICIES:
        raise SpecError(f"unknown policy {policy}")
    late = F.lit(False) if watermark is None else F.coalesce(F.col(f"`{EVENT_TIME}`") < F.lit(watermark), F.lit(False))
    if policy == "append":
        return df, df.limit(0)
    return df.filter(~late), df.filter(late)


def advanced(df: DataFrame, watermark, allowed: timedelta):
    """The watermark after the batch: all rows count, late ones too; it never goes back."""
    top = df.agg(F.max(F.col(f"`{EVENT_TIME}`"))).first()[0]
    if top is None:
        return watermark
    return max(top - allowed, watermark) if watermark is not None else top - allowed
