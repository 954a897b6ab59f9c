"""Date text conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_from_dates(check: Column | str, birth: Column | str) -> Column:
    """Difference of the years of two ``Y-m-d`` texts."""
    year = lambda c: F.get(F.split(_col(c), "-"), F.lit(0)).try_cast("int")
    return year(check) - year(birth)


def compact_date(c: Column | str) -> Column:
    """``Y-m-d`` with or without leading zeros to ``yyyymmdd``."""
    return F.date_format(F.to_date(_col(c), "y-M-d"), "yyyyMMdd")


def utc_to_local(c: Column | str, zone: str = "US/Pacific", source: str = "yyyy-MM-dd HH:mm:ss",
                 target: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC time text in the wall time of another zone, independent of the session zone."""
    naive = F.to_timestamp_ntz(_col(c), F.lit(source))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), naive), target)


def slash_date(c: Column | str) -> Column:
    """A date as ``Y/m/d`` text."""
    return F.date_format(_col(c), "yyyy/MM/dd")
