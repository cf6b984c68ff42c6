"""Time-zone expressions over zone-less UTC timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.fixed_values import ZONE


def in_zone(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def zone_day(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(in_zone(ts, zone), "yyyy-MM-dd")


def zone_datetime(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(in_zone(ts, zone), "dd/MM/yyyy, HH:mm:ss")


def zone_date(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(in_zone(ts, zone), "dd/MM/yyyy")


def ntz(moment: dt.datetime) -> Column:
    """Literal zone-less timestamp."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))
