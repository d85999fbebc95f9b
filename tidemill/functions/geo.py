"""Regions, distances and cells on the earth.

Points are ``{"lat": Column, "lon": Column}`` or constants; a region is a point,
a circle (with radius), a box (minLat, maxLat, minLon, maxLon) or a polygon
(points); a line is text ``lon lat, lon lat``. Point and circle distances and
boxes stay in generated code.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.stream import TIME, TableStream, col
from . import cells

#: Mean radius of the earth by unit (fixed values).
RADIUS = {"km": 6371.01, "m": 6371010.0, "mile": 3958.761}
units = {"distance": "km"}


def _radius(unit: str | None) -> float:
    return RADIUS[unit or units["distance"]]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2, unit: str | None = None) -> Column:
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return F.asin(F.least(F.sqrt(h), F.lit(1.0))) * 2 * _radius(unit)


def st_distance(region: dict, point: dict, unit: str | None = None) -> Column:
    """Least distance from a region to a point; 0 inside."""
    lat, lon = _c(point["lat"]), _c(point["lon"])
    if "radius" in region:
        return F.greatest(haversine(region["lat"], region["lon"], lat, lon, unit) - region["radius"], F.lit(0.0))
    if "minLat" in region:
        return _box_distance(region, lat, lon, unit)
    if "points" in region:
        points, radius = [(p["lat"], p["lon"]) for p in region["points"]], _radius(unit)

        @F.pandas_udf("double")
        def away(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(polygon_distance(points, a.to_numpy(float), b.to_numpy(float)) * radius)

        return away(lat, lon)
    return haversine(region["lat"], region["lon"], lat, lon, unit)


def _in_longitudes(region: dict, lon: Column) -> Column:
    """Whether a box, which may reach over the antimeridian, has a longitude."""
    if region["minLon"] <= region["maxLon"]:
        return lon.between(region["minLon"], region["maxLon"])
    return (lon >= region["minLon"]) | (lon <= region["maxLon"])


def _box_distance(region: dict, lat: Column, lon: Column, unit: str | None) -> Column:
    """North or south of a box the way is along the meridian; else it ends on the
    nearer of the box's two meridian edges, at its foot or at a corner."""
    low, high = float(region["minLat"]), float(region["maxLat"])
    straight = F.radians(F.greatest(lat - high, F.lit(low) - lat, F.lit(0.0))) * _radius(unit)

    def edge(at: float) -> Column:
        turn = F.radians(lon - at)
        foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(turn)))
        near = F.greatest(F.least(foot, F.lit(high)), F.lit(low))
        ahead = (F.cos(turn) > 0) & (near == foot)
        corner = F.least(haversine(low, at, lat, lon, unit), haversine(high, at, lat, lon, unit))
        return F.when(ahead, haversine(foot, at, lat, lon, unit)).otherwise(corner)

    return F.when(_in_longitudes(region, lon), straight).otherwise(F.least(edge(float(region["minLon"])), edge(float(region["maxLon"]))))


def _xyz(lat, lon) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], -1)


def polygon_distance(points: list[tuple[float, float]], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Angle to a polygon: 0 inside (the edges wind around the point)."""
    p, v = _xyz(lat, lon), _xyz(*np.array(points, dtype=float).T)
    wind, near = np.zeros(len(p)), np.full(len(p), np.inf)
    for a, b in zip(v, np.roll(v, -1, 0)):
        n = np.cross(a, b)
        at, bt = a - (p @ a)[:, None] * p, b - (p @ b)[:, None] * p
        wind += np.arctan2((np.cross(at, bt) * p).sum(1), (at * bt).sum(1))
        size = np.linalg.norm(n)
        ends = np.minimum(np.arccos(np.clip(p @ a, -1, 1)), np.arccos(np.clip(p @ b, -1, 1)))
        if size > 1e-15:
            n = n / size
            foot = p - (p @ n)[:, None] * n
            between = (np.cross(a, foot) @ n >= 0) & (np.cross(foot, b) @ n >= 0)
            ends = np.where(between, np.abs(np.arcsin(np.clip(p @ n, -1, 1))), ends)
        near = np.minimum(near, ends)
    return np.where(np.abs(wind) > math.pi, 0.0, near)


def st_contains(region: dict, geometry: dict, unit: str | None = None) -> Column:
    """A point in a region, or all points of a line."""
    if "linestring" in geometry:
        inside = lambda p: st_contains(region, {"lat": p["lat"], "lon": p["lon"]}, unit)
        return F.forall(line_points(geometry["linestring"]), inside)
    if "minLat" in region:
        return _c(geometry["lat"]).between(region["minLat"], region["maxLat"]) & _in_longitudes(region, _c(geometry["lon"]))
    return st_distance(region, geometry, unit) <= 0


def st_dwithin(region: dict, geometry: dict, distance: float, unit: str | None = None) -> Column:
    return st_distance(region, geometry, unit) <= distance


def st_intersects(region: dict, geometry: dict, unit: str | None = None) -> Column:
    return st_distance(region, geometry, unit) <= 0


def line_points(text: Column) -> Column:
    """The points of a line's text."""
    pair = lambda s: F.struct(F.split(F.trim(s), r"\s+")[1].cast("double").alias("lat"), F.split(F.trim(s), r"\s+")[0].cast("double").alias("lon"))
    return F.transform(F.split(text, ","), pair)


def st_length(geometry: dict, unit: str | None = None) -> Column:
    """Length of a line; a point has none."""
    if "linestring" not in geometry:
        return F.lit(0.0)
    p = line_points(geometry["linestring"])
    legs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: haversine(F.element_at(p, i)["lat"], F.element_at(p, i)["lon"], F.coalesce(F.try_element_at(p, i + 1), F.element_at(p, i))["lat"], F.coalesce(F.try_element_at(p, i + 1), F.element_at(p, i))["lon"], unit))
    return F.aggregate(legs, F.lit(0.0), lambda a, x: a + x)


def st_line_string(s: TableStream) -> TableStream:
    """Each table's points, in order, as one line's text."""
    order = F.struct(*(col(o) if isinstance(o, str) else o for o in s.order))
    text = F.concat(col("lon").cast("string"), F.lit(" "), col("lat").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    out = s.df.groupBy(*map(col, s.key)).agg(F.array_join(F.transform(rows, lambda x: x["t"]), ", ").alias("st_linestring"))
    return s.to(out, order=(), empty=None)


def s2_cell_token(level: int, lat: Column | None = None, lon: Column | None = None, token: Column | None = None) -> Column:
    """Token of the cell of a point, or of a token's parent, at a level."""
    if token is not None:

        @F.pandas_udf("string")
        def up(t: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else cells.token(cells.parent(cells.from_token(x), level)) for x in t])

        return up(token)

    @F.pandas_udf("string")
    def make(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.to_numpy(float), b.to_numpy(float)
        ok = ~(np.isnan(a) | np.isnan(b))
        ids = cells.cell_id(np.where(ok, a, 0), np.where(ok, b, 0), level)
        return pd.Series([cells.token(i) if k else None for i, k in zip(ids.tolist(), ok.tolist())])

    return make(lat.cast("double"), lon.cast("double"))


def s2_cell_lat_lon(token: Column) -> Column:
    @F.pandas_udf("lat double, lon double")
    def middle(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else cells.centre(cells.from_token(x)) for x in t], columns=["lat", "lon"])

    return middle(token)


def get_level(token: Column) -> Column:
    @F.pandas_udf("long")
    def level(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else cells.level_of(cells.from_token(x)) for x in t])

    return level(token)


def _angle(region: dict, lat: float, lon: float, unit: str | None) -> float:
    """Distance from a region to a point in radians, on the driver."""

    def between(a, b, c, d):
        return float(np.arccos(np.clip(_xyz(a, b) @ _xyz(c, d), -1, 1)))

    if "radius" in region:
        return max(between(region["lat"], region["lon"], lat, lon) - region["radius"] / _radius(unit), 0.0)
    if "minLat" in region:
        west, east, low, high = (region[k] for k in ("minLon", "maxLon", "minLat", "maxLat"))
        if west <= lon <= east or (west > east and (lon >= west or lon <= east)):
            return math.radians(max(lat - high, low - lat, 0.0))
        out = []
        for at in (west, east):
            turn = math.radians(lon - at)
            foot = math.degrees(math.atan2(math.sin(math.radians(lat)), math.cos(math.radians(lat)) * math.cos(turn)))
            ends = [foot] if math.cos(turn) > 0 and low <= foot <= high else [low, high]
            out += [between(x, at, lat, lon) for x in ends]
        return min(out)
    if "points" in region:
        return float(polygon_distance([(p["lat"], p["lon"]) for p in region["points"]], np.array([lat]), np.array([lon]))[0])
    return between(region["lat"], region["lon"], lat, lon)


def get_grid(region: dict, min_size: int = 24, max_size: int = -1, level: int = -1, max_level: int = -1, unit: str | None = None) -> dict:
    """Tokens of the cells that cover a region: at one level, or at the first
    level (up to ``max_level``) with at least ``min_size`` of them."""
    found, at = cells.faces(), 0
    while True:
        kept = []
        for c in found:
            lat, lon = cells.centre(c)
            reach = max(float(np.arccos(np.clip(_xyz(lat, lon) @ _xyz(*p), -1, 1))) for p in cells.corners(c))
            if _angle(region, lat, lon, unit) <= reach:
                kept.append(c)
        if max_size > 0 and len(kept) > max_size and at > 0 and level < 0:
            return {"level": at - 1, "set": last}
        last = [cells.token(c) for c in kept]
        if at == (level if level >= 0 else cells.LEVELS) or (level < 0 and (len(kept) >= min_size or at == max_level)):
            return {"level": at, "set": last}
        found, at = [d for c in kept for d in cells.children(c)], at + 1


def to_rows(s: TableStream) -> TableStream:
    """Fields to columns, one row per time."""
    from ..operators.shape import pivot

    return pivot(s, [TIME], ["_field"])


def shape_data(s: TableStream, latitude: str, longitude: str, level: int) -> TableStream:
    """Pivoted points with lat, lon and their cell's token, which joins the key."""
    wide = to_rows(s)
    df = wide.df.withColumnRenamed(latitude, "lat").withColumnRenamed(longitude, "lon")
    df = df.withColumn("s2_cell_id", s2_cell_token(level, col("lat"), col("lon")))
    return wide.to(df, key=(*wide.key, "s2_cell_id"))


def grid_filter(s: TableStream, region: dict, min_size: int = 24, max_size: int = -1, level: int = -1, s2cell_level: int = -1, unit: str | None = None) -> TableStream:
    """Coarse: rows whose cell is one of the region's cover. A constant list, so
    it prunes partitions and row groups by ``s2_cell_id``."""
    deep = s2cell_level
    if deep < 0:
        first = s.df.select("s2_cell_id").where("s2_cell_id is not null").first()
        deep = cells.level_of(cells.from_token(first[0])) if first else cells.LEVELS
    grid = get_grid(region, min_size, max_size, level, deep, unit)
    if grid["level"] == deep:
        return s.to(s.df.where(col("s2_cell_id").isin(grid["set"])))
    return s.to(s.df.where(s2_cell_token(grid["level"], token=col("s2_cell_id")).isin(grid["set"])))


def strict_filter(s: TableStream, region: dict, unit: str | None = None) -> TableStream:
    return s.to(s.df.where(st_contains(region, {"lat": col("lat"), "lon": col("lon")}, unit)))


def filter_rows(s: TableStream, region: dict, strict: bool = True, **kw) -> TableStream:
    coarse = grid_filter(s, region, **kw)
    return strict_filter(coarse, region, kw.get("unit")) if strict else coarse


def group_by_area(s: TableStream, new_column: str, level: int) -> TableStream:
    out = s.df.withColumn(new_column, s2_cell_token(level, token=col("s2_cell_id")))
    return s.to(out, key=(new_column,), empty=None)


def as_tracks(s: TableStream, group_by=("id", "tid"), order_by=(TIME,)) -> TableStream:
    return s.to(key=tuple(c for c in group_by if c in s.columns), order=tuple(order_by), empty=None)


def total_distance(s: TableStream, output: str = "_value", unit: str | None = None) -> TableStream:
    """Sum of the distances between consecutive points of each table."""
    w = s.rows()
    leg = haversine(F.lag("lat").over(w), F.lag("lon").over(w), col("lat"), col("lon"), unit)
    out = s.df.withColumn("__leg", leg).groupBy(*map(col, s.key)).agg(F.coalesce(F.sum("__leg"), F.lit(0.0)).alias(output))
    return s.to(out, order=(), empty=None)
