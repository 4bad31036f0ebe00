"""Dates that may be a year alone, ages in completed years, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """yyyy-MM-dd, d/M/yyyy (also with . or -) or a year from 1880 to 2100, as yyyy-MM-dd or yyyy; null for any other text and impossible dates."""
    t = F.trim(F.regexp_replace(c, r"^[^\d]*", ""))
    slashed = F.regexp_replace(t, "[.-]", "/")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    day_first = F.when(slashed.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(slashed, "d/M/yyyy"))
    year = F.when(t.rlike(r"^\d{4}$"), t.try_cast("int"))
    full = F.date_format(F.coalesce(iso, day_first), "yyyy-MM-dd")
    return F.coalesce(full, F.when(year.between(1880, 2100), year.cast("string")))


def age_on(dob: Column, on: Column) -> Column:
    """Completed years on a day (both yyyy-MM-dd, dob perhaps yyyy: as of 31 December); null before birth."""
    d = F.when(F.length(dob) == 4, F.concat(dob, F.lit("-12-31"))).otherwise(dob)
    years = F.substring(on, 1, 4).cast("int") - F.substring(d, 1, 4).cast("int") - (F.substring(on, 6, 5) < F.substring(d, 6, 5)).cast("int")
    return F.when(years >= 0, years)


def india_day(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "yyyy-MM-dd")
