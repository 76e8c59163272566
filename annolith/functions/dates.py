"""Dates: Portuguese labels, ISO text to and from UTC, display in the application's time zone. All built-ins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolith.settings import APP_TIMEZONE, MONTHS


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month)


def date_label(moment: Column) -> Column:
    """'14 de julho de 2023'."""
    return F.concat(F.dayofmonth(moment).cast("string"), F.lit(" de "), month_name(F.month(moment)), F.lit(" de "), F.year(moment).cast("string"))


def label_of(day: date) -> str:
    return f"{day.day} de {MONTHS[day.month - 1]} de {day.year}"


def parse_iso(text: Column) -> Column:
    """Timestamp of ISO text: a trailing Z, an offset, or none (then UTC); null where it is not ISO."""
    clean = F.trim(text)
    shape = clean.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    bare = clean.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = clean.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    whole = F.when(bare, F.concat(clean, F.lit("T00:00:00Z"))).when(zoned, clean).otherwise(F.concat(clean, F.lit("Z")))
    whole = F.regexp_replace(whole, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})$", "$1:00$2")
    return F.when(shape, F.try_to_timestamp(whole))


def to_iso(moment: Column) -> Column:
    """UTC ISO text of a timestamp, microseconds only where there are any. The session's time zone is UTC."""
    seconds = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.concat(seconds, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def display(text: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """ISO text as local time of the application, '-' where there is none."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(parse_iso(text), APP_TIMEZONE), pattern), F.lit("-"))


def local_day(moment: Column) -> Column:
    """The application's day at a moment."""
    return F.to_date(F.from_utc_timestamp(moment, APP_TIMEZONE))


def or_earliest(moment: Column) -> Column:
    """The date, or a sentinel before all dates."""
    return F.coalesce(moment, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
