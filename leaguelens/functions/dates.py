"""Dates and times; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"


def effective_date(override: str | None = None) -> Column:
    """The given day, else today."""
    return F.lit(override).cast("date") if override else F.current_date()


def lenient_date(x: Column) -> Column:
    """The day of a text that starts with one."""
    text = x.cast("string")
    return F.when(text.rlike(_DAY), F.trim(text).try_cast("date"))


def lenient_utc(x: Column) -> Column:
    """A time with its day, in UTC where no zone is given; a time of day alone is null, not today."""
    text = F.trim(x.cast("string"))
    zoned = text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(text.rlike(_DAY), F.when(zoned, text).otherwise(F.concat(text, F.when(F.length(text) > 10, "Z").otherwise(" 00:00:00Z"))).try_cast("timestamp"))


def iso_utc(x: Column) -> Column:
    """A timestamp as text such as 2024-01-31T12:00:00+00:00, to the microsecond where it has any."""
    utc = F.to_utc_timestamp(x, F.current_timezone())
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))
