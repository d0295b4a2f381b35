"""Times as column expressions; timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column) -> Column:
    """At UTC-3."""
    return F.from_utc_timestamp(ts, "-03:00")


def iso_local(ts: Column) -> Column:
    return F.concat(F.date_format(local(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-03:00"))


def short_local(ts: Column) -> Column:
    return F.coalesce(F.date_format(local(ts), "dd/MM HH:mm:ss"), F.lit("—"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts).cast("string")


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))
