"""Calendar periods: right-edge labels for series and string labels for panels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = {"D": "D", "W": "W", "M": "M", "ME": "M", "Q": "Q", "QE": "Q", "Y": "Y", "A": "Y", "YE": "Y"}


def normalize_frequency(freq: str) -> str:
    found = FREQUENCIES.get(freq.strip().upper())
    if found is None:
        raise ValueError(f"Unsupported frequency: {freq!r}.")
    return found


def period_end(day: Column, freq: str) -> Column:
    """Last day of the period that holds ``day`` (weeks end on Sunday)."""
    f = normalize_frequency(freq)
    if f == "D":
        return day.cast("date")
    if f == "W":
        return F.date_add(F.date_trunc("week", day).cast("date"), 6)
    if f == "M":
        return F.last_day(day)
    if f == "Q":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return F.make_date(F.year(day), F.lit(12), F.lit(31))


def period_start(day: Column, freq: str) -> Column:
    f = normalize_frequency(freq)
    if f == "D":
        return day.cast("date")
    return F.trunc(day, {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}[f])


def period_label(day: Column, freq: str) -> Column:
    """Panel label: ``2024-05-15``, ``2024-05-13/2024-05-19``, ``2024-05``, ``2024Q2``, ``2024``."""
    f = normalize_frequency(freq)
    if f == "D":
        return F.date_format(day, "yyyy-MM-dd")
    if f == "W":
        return F.concat_ws("/", F.date_format(period_start(day, f), "yyyy-MM-dd"), F.date_format(period_end(day, f), "yyyy-MM-dd"))
    if f == "M":
        return F.date_format(day, "yyyy-MM")
    if f == "Q":
        return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    return F.year(day).cast("string")
