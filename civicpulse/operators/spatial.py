"""Spatial joins, centroids, areas, distance weights and Moran statistics as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import haversine
from ..sources.boundaries import normalize_boundary_layer

CELL = 0.01  # degrees of the join grid


def _edges(polygon: Column) -> Column:
    """Edges ``(x1, y1, x2, y2)`` of all rings of a polygon."""

    def ring_edges(ring: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ring) - 2),
            lambda i: F.named_struct(
                F.lit("x1"), F.get(ring, i)["lon"], F.lit("y1"), F.get(ring, i)["lat"],
                F.lit("x2"), F.get(ring, i + 1)["lon"], F.lit("y2"), F.get(ring, i + 1)["lat"],
            ),
        )

    return F.flatten(F.transform(F.filter(polygon, lambda r: F.size(r) > 2), ring_edges))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    spans = (e["y1"] > y) != (e["y2"] > y)
    at = e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
    return spans & (x < at)


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
    in_box = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    return (F.abs(cross) <= 1e-15) & in_box


def within(parts: Column, x: Column, y: Column) -> Column:
    """Strictly inside one of the polygons given by their edges; holes count as outside."""

    def inside(edges: Column) -> Column:
        hits = F.aggregate(edges, F.lit(0), lambda n, e: n + _crosses(e, x, y).cast("int"))
        return (hits % 2 == 1) & ~F.exists(edges, lambda e: _on_edge(e, x, y))

    return F.exists(parts, inside)


def _shells(polygons: str) -> Column:
    return F.flatten(F.transform(polygons, lambda p: p[0]))


def with_bbox(boundaries: DataFrame) -> DataFrame:
    points = _shells("polygons")
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return boundaries.withColumns(
        {"min_lon": F.array_min(lon), "max_lon": F.array_max(lon), "min_lat": F.array_min(lat), "max_lat": F.array_max(lat)}
    )


def boundary_cells(boundaries: DataFrame, cell: float = CELL) -> DataFrame:
    """Grid cells ``(cx, cy, candidates)`` with the boundaries whose box covers them.

    A cell holds of a boundary's edges only those that a ray to the right from a point
    of the cell can meet: those that reach into its row and not only left of it.
    """
    steps = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    # one row of the grid after the other: a boundary's edges are spread over its rows before its columns
    bands = with_bbox(boundaries).select(
        "geography", "geography_value", "properties", F.transform("polygons", _edges).alias("parts"), "min_lon", "max_lon",
        F.explode(steps("min_lat", "max_lat")).alias("cy"),
    )
    # a hair wider than the row, for points that division puts on its rim
    bottom, top = (F.col("cy") - 1e-6) * cell, (F.col("cy") + 1 + 1e-6) * cell

    def in_band(e: Column) -> Column:
        return (F.least(e["y1"], e["y2"]) <= top) & (F.greatest(e["y1"], e["y2"]) >= bottom)

    bands = bands.withColumn("parts", F.transform("parts", lambda edges: F.filter(edges, in_band)))
    cells = bands.select("*", F.explode(steps("min_lon", "max_lon")).alias("cx"))
    left = (F.col("cx") - 1e-6) * cell
    ahead = F.transform("parts", lambda edges: F.filter(edges, lambda e: F.greatest(e["x1"], e["x2"]) >= left))
    cells = cells.withColumn("parts", F.filter(ahead, lambda edges: F.size(edges) > 0)).where(F.size("parts") > 0)
    return cells.groupBy("cx", "cy").agg(F.collect_list(F.struct("geography", "geography_value", "properties", "parts")).alias("candidates"))


def spatial_join(requests: DataFrame, boundaries: DataFrame, cell: float = CELL) -> DataFrame:
    """Left spatial join of request points, predicate within.

    Requests meet the boundaries of their grid cell in one equi-join on unique
    cells, are refined by ray casting and exploded: unmatched requests stay,
    overlapping boundaries give a row each, points on an edge match nothing.
    Adds ``boundary_geography``, ``boundary_geography_value``, ``boundary_properties``.
    """
    x, y = F.col("longitude"), F.col("latitude")
    rows = requests.withColumns({"_cx": F.floor(x / cell), "_cy": F.floor(y / cell)})
    cells = boundary_cells(boundaries, cell)
    out = rows.join(cells, (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy")), "left")
    hits = F.filter(F.coalesce("candidates", F.array()), lambda b: within(b["parts"], x, y))
    out = out.select(*requests.columns, F.explode_outer(hits).alias("_b"))
    return out.select(
        *requests.columns, F.col("_b.geography").alias("boundary_geography"), F.col("_b.geography_value").alias("boundary_geography_value"),
        F.col("_b.properties").alias("boundary_properties"),
    )


def enrich_requests(requests: DataFrame, boundaries: DataFrame, layer: str | None = None) -> DataFrame:
    """Requests that have a point with the attributes of the boundary they lie in (null outside all)."""
    if layer is not None:
        boundaries = boundaries.where(F.col("geography") == normalize_boundary_layer(layer))
    placed = requests.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return spatial_join(placed, boundaries)


def location_check(requests: DataFrame, boundaries: DataFrame, geography: str = "community_district") -> DataFrame:
    """Per boundary: requests whose stated value agrees, differs, and the total inside."""
    joined = spatial_join(requests, boundaries).where(F.col("boundary_geography_value").isNotNull())
    same = (F.col(geography) == F.col("boundary_geography_value")).cast("long")
    counts = joined.groupBy(F.col("boundary_geography_value").alias("geography_value")).agg(
        F.count("*").alias("n_inside"), F.sum(F.coalesce(same, F.lit(0))).alias("n_agree")
    )
    out = boundaries.select("geography_value").distinct().join(counts, "geography_value", "left").na.fill(0, ["n_inside", "n_agree"])
    return out.withColumn("n_differ", F.col("n_inside") - F.col("n_agree"))


def summaries_on_boundaries(boundaries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Boundaries with their summaries, null where there are none."""
    return boundaries.join(summaries, ["geography", "geography_value"], "left")


def two_views(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    return first.withColumn("view", F.lit(names[0])).unionByName(second.withColumn("view", F.lit(names[1])))


def clip_to_bbox(boundaries: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Boundaries that meet the box, their rings clipped to it (Sutherland-Hodgman as folds)."""
    out = with_bbox(boundaries).where(
        (F.col("min_lon") < max_lon) & (F.col("max_lon") > min_lon) & (F.col("min_lat") < max_lat) & (F.col("max_lat") > min_lat)
    )

    def clip(ring: Column, axis: str, limit: float, above: bool) -> Column:
        keep = (lambda p: p[axis] >= limit) if above else (lambda p: p[axis] <= limit)

        def step(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, i + 1)
            t = (F.lit(limit) - a[axis]) / (b[axis] - a[axis])
            cut = F.named_struct(F.lit("lon"), a["lon"] + t * (b["lon"] - a["lon"]), F.lit("lat"), a["lat"] + t * (b["lat"] - a["lat"]))
            nothing = F.array().cast("array<struct<lon:double,lat:double>>")
            return F.concat(F.when(keep(a) != keep(b), F.array(cut)).otherwise(nothing), F.when(keep(b), F.array(b)).otherwise(nothing))

        open_ring = F.flatten(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), step))
        return F.when(F.size(open_ring) > 0, F.concat(open_ring, F.slice(open_ring, 1, 1))).otherwise(open_ring)

    def clip_polygons(axis: str, limit: float, above: bool) -> Column:
        rings = F.transform("polygons", lambda p: F.filter(F.transform(p, lambda r: clip(r, axis, limit, above)), lambda r: F.size(r) > 3))
        return F.filter(rings, lambda p: F.size(p) > 0)

    for axis, limit, above in (("lon", min_lon, True), ("lon", max_lon, False), ("lat", min_lat, True), ("lat", max_lat, False)):
        out = out.withColumn("polygons", clip_polygons(axis, limit, above))
    return out.where(F.size("polygons") > 0).select(boundaries.columns)


def centroids(boundaries: DataFrame) -> DataFrame:
    """Mean of all vertices of the first polygon's shell, the closing one included."""
    ring = F.col("polygons")[0][0]
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return boundaries.select(F.col("geography_value").alias("unit_id"), mean("lat").alias("latitude"), mean("lon").alias("longitude"))


def areas(boundaries: DataFrame) -> DataFrame:
    """Area in square degrees (shoelace; holes taken off)."""

    def ring_area(ring: Column) -> Column:
        cross = lambda i: F.get(ring, i)["lon"] * F.get(ring, i + 1)["lat"] - F.get(ring, i + 1)["lon"] * F.get(ring, i)["lat"]
        return F.abs(F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, i: s + cross(i))) / 2

    def polygon_area(polygon: Column) -> Column:
        return F.aggregate(F.transform(polygon, lambda r, k: F.when(k == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda s, a: s + a)

    total = F.aggregate(F.transform("polygons", polygon_area), F.lit(0.0), lambda s, a: s + a)
    return boundaries.select("geography_value", total.alias("area"))


def density(counts: DataFrame, boundaries: DataFrame) -> DataFrame:
    out = areas(boundaries).join(counts, "geography_value", "left").na.fill(0, ["n"])
    return out.withColumn("density", F.col("n") / (F.col("area") + 1e-9))


def distance_weights(units: DataFrame, threshold: float = 2000.0, row_standardize: bool = False, radius: float = 6_371_000.0) -> DataFrame:
    """Inverse-distance edges ``(unit_a, unit_b, w)`` of units nearer than ``threshold``.

    ``units(unit_id, latitude, longitude)``.  Units meet in the cells of a grid as
    wide as the threshold and in the neighbouring ones, not all with all.
    """
    step = math.degrees(threshold / radius)
    widest = units.agg(F.max(F.abs("latitude")).alias("m")).first()["m"] or 0.0
    lon_step = step / max(math.cos(math.radians(min(widest + step, 89.0))), 0.01)
    a = units.select(F.col("unit_id").alias("unit_a"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"),
                     F.floor(F.col("latitude") / step).alias("gy"), F.floor(F.col("longitude") / lon_step).alias("gx"))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    b = units.select(F.col("unit_id").alias("unit_b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"), F.explode(near).alias("dy"))
    b = b.select("*", F.explode(near).alias("dx"))
    b = b.select("unit_b", "lat_b", "lon_b", (F.floor(F.col("lat_b") / step) + F.col("dy")).alias("gy"), (F.floor(F.col("lon_b") / lon_step) + F.col("dx")).alias("gx"))
    d = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), radius)
    out = a.join(b, ["gy", "gx"]).where(F.col("unit_a") != F.col("unit_b")).withColumn("d", d)
    out = out.where((F.col("d") > 0) & (F.col("d") <= threshold)).select("unit_a", "unit_b", (1 / F.col("d")).alias("w"))
    if row_standardize:
        out = out.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("unit_a")))
    return out


#: entries of a weight table that an estimator on the driver takes
WEIGHT_LIMIT = 5_000_000


def weights_to_dict(weights: DataFrame) -> dict[str, dict[str, float]]:
    """Driver-side adjacency of a weight table of at most ``WEIGHT_LIMIT`` entries."""
    out: dict[str, dict[str, float]] = {}
    rows = weights.limit(WEIGHT_LIMIT + 1).collect()
    if len(rows) > WEIGHT_LIMIT:
        raise ValueError(f"The weights have more than {WEIGHT_LIMIT} entries.")
    for r in rows:
        out.setdefault(r["unit_a"], {})[r["unit_b"]] = r["w"]
    return out


def _standardized(weights: DataFrame) -> DataFrame:
    return weights.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("unit_a")))


def morans_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Moran's I and its expectation: ``values(unit_id, value)``, row-standardised weights."""
    stats = values.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    v = values.join(F.broadcast(stats)).select("unit_id", (F.col("value") - F.col("mean")).alias("z"))  # one row of moments
    edges = _standardized(weights).join(v.select(F.col("unit_id").alias("unit_a"), F.col("z").alias("za")), "unit_a")
    edges = edges.join(v.select(F.col("unit_id").alias("unit_b"), F.col("z").alias("zb")), "unit_b")
    sums = edges.agg(F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("num"), F.sum("w").alias("s0"))
    return sums.join(stats).select((F.col("num") / F.col("s0") / F.col("var")).alias("statistic"), (-1 / (F.col("n") - 1)).alias("expected"))


def local_morans_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Local statistic and quadrant (HH, LH, LL, HL) per unit."""
    stats = values.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    v = values.join(F.broadcast(stats)).select("unit_id", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"), "n")
    edges = _standardized(weights).join(v.select(F.col("unit_id").alias("unit_b"), F.col("z").alias("zb")), "unit_b")
    lag = edges.groupBy(F.col("unit_a").alias("unit_id")).agg(F.sum(F.col("w") * F.col("zb")).alias("lag"))
    out = v.join(lag, "unit_id", "left").na.fill(0.0, ["lag"])
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), "HH").when((F.col("z") <= 0) & (F.col("lag") > 0), "LH").when(
        (F.col("z") <= 0) & (F.col("lag") <= 0), "LL").otherwise("HL")
    return out.select("unit_id", ((F.col("n") - 1) / F.col("n") * F.col("z") * F.col("lag")).alias("local_statistic"), quadrant.alias("quadrant"))


def distance_bands(units: DataFrame, lat: float, lon: float, inside: list[str], width_km: float = 0.5, reach_km: float = 15.0) -> DataFrame:
    """Counts of units per signed distance band from a point, negative inside the given set."""
    km = haversine(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)) / 1000
    signed = F.when(F.col("unit_id").isin(inside), -km).otherwise(km)
    rows = units.select(signed.alias("d")).where((F.col("d") >= -reach_km) & (F.col("d") < reach_km))
    return rows.groupBy(F.floor((F.col("d") + reach_km) / width_km).alias("band")).agg(F.count("*").alias("n"))
