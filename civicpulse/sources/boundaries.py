"""Boundary layers: GeoJSON files to a DataFrame of polygons, and value normalisers."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import BOUNDARY_LAYERS, BOROUGH_ALIASES

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
BOUNDARY_SCHEMA = T.StructType([
    T.StructField("geography", T.StringType()), T.StructField("geography_value", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry_type", T.StringType()),
    # polygons -> rings (the first is the shell) -> points
    T.StructField("polygons", T.ArrayType(T.ArrayType(T.ArrayType(POINT)))),
])

LAYER_ALIASES = {
    "borough": "borough", "boroughs": "borough", "community_district": "community_district",
    "community_districts": "community_district", "cd": "community_district", "council_district": "council_district",
    "council_districts": "council_district", "council": "council_district", "nta": "neighborhood_tabulation_area",
    "neighborhood_tabulation_area": "neighborhood_tabulation_area", "census_tract": "census_tract",
    "census_tracts": "census_tract", "tract": "census_tract", "zcta": "zcta", "zip": "zcta", "zipcode": "zcta", "modzcta": "zcta",
}
#: borough digit of a tract label -> county code
_COUNTY = {"1": "061", "2": "005", "3": "047", "4": "081", "5": "085"}


def normalize_boundary_layer(layer: str) -> str:
    found = LAYER_ALIASES.get(re.sub(r"[\s-]+", "_", layer.strip().lower()))
    if found is None:
        raise ValueError(f"Unsupported boundary layer: {layer!r}; one of {', '.join(BOUNDARY_LAYERS)}.")
    return found


def normalize_boundary_value(layer: str, value: str) -> str:
    """Canonical value of a layer: digits of a district or zip, upper-case area codes, 11-digit tracts."""
    layer, value = normalize_boundary_layer(layer), " ".join(str(value).split())
    digits = re.sub(r"[^0-9]", "", value)
    if layer == "borough":
        return BOROUGH_ALIASES.get(value.casefold(), value.upper())
    if layer in ("council_district", "zcta") and digits:
        return str(int(digits)) if layer == "council_district" else digits.zfill(5)
    if layer == "census_tract" and len(digits) == 7 and digits[0] in _COUNTY:
        return f"36{_COUNTY[digits[0]]}{digits[1:]}"
    if layer == "community_district":
        m = re.fullmatch(r"(?:([0-9]{1,2}) (.+)|(.+) ([0-9]{1,2}))", value)
        name = BOROUGH_ALIASES.get((m[2] or m[3]).casefold()) if m else None
        return f"{name} {int(m[1] or m[4]):02d}" if m and name else value.upper()
    return value.upper()


def normalize_boundary_values(layer: str, values) -> list[str]:
    return [normalize_boundary_value(layer, v) for v in ([values] if isinstance(values, str) else values)]


def load_boundaries(spark: SparkSession, path: str, layer: str | None = None, values=None) -> DataFrame:
    """Features of a GeoJSON collection; ``layer`` and ``values`` select by normalised names."""
    nested = "array<array<array<double>>>"
    text = spark.read.text(str(path), wholetext=True)
    shape = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    feature = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    kind = F.col("f.geometry.type")
    polygons = (
        F.when(kind == "Polygon", F.array(F.from_json("f.geometry.coordinates", nested)))
        .when(kind == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{nested}>"))
    )
    as_points = F.transform(polygons, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.named_struct(F.lit("lon"), p[0], F.lit("lat"), p[1]))))
    df = feature.select(
        F.col("f.properties.geography").alias("geography"), F.col("f.properties.geography_value").alias("geography_value"),
        F.map_filter("f.properties", lambda k, _: ~k.isin("geography", "geography_value")).alias("properties"),
        kind.alias("geometry_type"), as_points.alias("polygons"),
    )
    if layer is not None:
        df = df.where(F.col("geography") == normalize_boundary_layer(layer))
        if values is not None:
            df = df.where(F.col("geography_value").isin(normalize_boundary_values(layer, values)))
    elif values is not None:
        raise ValueError("values need a layer.")
    return df


def resolve_boundaries(spark: SparkSession, source: str | None = None, layer: str | None = None, folder: str | None = None) -> DataFrame:
    """A path or, below ``folder``, the file ``<layer>.geojson``; exactly one of source and layer."""
    if (source is None) == (layer is None):
        raise ValueError("Give either a source or a layer.")
    if source is not None and (Path(source).exists() or "://" in source):
        return load_boundaries(spark, source)
    if folder is None:
        raise FileNotFoundError(f"No boundary file for {source or layer!r}; give the folder that holds the layers.")
    name = normalize_boundary_layer(source or layer)
    return load_boundaries(spark, f"{folder}/{name}.geojson")


def list_boundary_layers(boundaries: DataFrame) -> DataFrame:
    return boundaries.select("geography").distinct().orderBy("geography")


def list_boundary_values(boundaries: DataFrame, layer: str) -> DataFrame:
    return boundaries.where(F.col("geography") == normalize_boundary_layer(layer)).select("geography_value").distinct().orderBy("geography_value")
