"""Normalisers as Column expressions: everything stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BOROUGH_ALIASES, LATITUDE_RANGE, LONGITUDE_RANGE


def collapse_space(c: Column) -> Column:
    """Trim and collapse runs of (Unicode) white space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def borough(c: Column) -> Column:
    """Canonical borough for known aliases, else the upper-cased value."""
    s = collapse_space(c)
    return F.coalesce(F.element_at(_literal_map(BOROUGH_ALIASES), F.lower(s)), F.upper(s))


def known_borough(c: Column) -> Column:
    """Canonical borough, null for a value that is no alias of one."""
    return F.element_at(_literal_map(BOROUGH_ALIASES), F.lower(collapse_space(c)))


def normalize_borough_name(value: str) -> str:
    """Driver-side strict form: raises for unknown names."""
    found = BOROUGH_ALIASES.get(" ".join(value.split()).casefold())
    if found is None:
        raise ValueError(f"Unknown borough: {value!r}.")
    return found


def community_district(c: Column) -> Column:
    """``BORO 0N`` for ``N BORO`` and ``BORO N``; other values only space-collapsed."""
    s = collapse_space(c)
    number_first = F.regexp_extract(s, r"^([0-9]{1,2}) +(.+)$", 1)
    boro_last = F.regexp_extract(s, r"^([0-9]{1,2}) +(.+)$", 2)
    boro_first = F.regexp_extract(s, r"^(.+) +([0-9]{1,2})$", 1)
    number_last = F.regexp_extract(s, r"^(.+) +([0-9]{1,2})$", 2)
    number = F.when(number_first != "", number_first).otherwise(number_last)
    name = known_borough(F.when(number_first != "", boro_last).otherwise(boro_first))
    label = F.concat_ws(" ", name, F.lpad(number.try_cast("int").cast("string"), 2, "0"))
    return F.when(name.isNotNull() & (number != ""), label).otherwise(s)


def optional_text(c: Column) -> Column:
    """Space-collapsed text, null when nothing is left."""
    return F.nullif(collapse_space(c), F.lit(""))


def iso_date(c: Column) -> Column:
    """Date of an ISO date or date-time; a trailing ``Z`` is ignored; null if unreadable."""
    s = F.regexp_replace(F.trim(c), "Z$", "")
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}($|[T ])"), F.try_to_timestamp(F.regexp_replace(s, "T", " ")).cast("date"))


def coordinate(c: Column) -> Column:
    """Finite double or null."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def coordinate_pair(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """``(latitude, longitude, error)``: both null for a missing or (0, 0) pair."""
    a, b = coordinate(lat), coordinate(lon)
    absent = (a.isNull() & b.isNull()) | F.coalesce((a == 0) & (b == 0), F.lit(False))
    error = (
        F.when(absent, F.lit(None).cast("string"))
        .when(a.isNull() | b.isNull(), "latitude and longitude must come together")
        .when(~a.between(*LATITUDE_RANGE), "latitude out of range")
        .when(~b.between(*LONGITUDE_RANGE), "longitude out of range")
    )
    sound = ~absent & error.isNull()
    return F.when(sound, a), F.when(sound, b), error


def topic_text(c: Column) -> Column:
    """Lower case, every run outside a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def topic_label(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("unspecified"))


def matches_keyword(text: Column, keyword: str) -> Column:
    """Whole word for a single word, substring for several words."""
    keyword = keyword.lower()
    if " " in keyword:
        return F.contains(text, F.lit(keyword))
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {keyword} "))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
