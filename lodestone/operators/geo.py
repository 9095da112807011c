"""Geographic predicates as Column expressions; joins of points with regions are in ``spatial``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.spatial import EARTH_M


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def box(df: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """Points in a box, edges included; a box with west > east lies over the date line. Reaches the scan."""
    c = F.col(lon)
    across = c.between(west, east) if west <= east else (c >= west) | (c <= east)
    return df.where(F.col(lat).between(south, north) & across)


def distance(df: DataFrame, lat: str, lon: str, at: tuple[float, float], metres: float) -> DataFrame:
    """Points within a distance; a latitude band (and a box away from the poles) goes to the scan first."""
    dlat = math.degrees(metres / EARTH_M) * 1.000001
    df = df.where(F.col(lat).between(max(-90, at[0] - dlat), min(90, at[0] + dlat)))
    reach = math.cos(math.radians(min(89.9, abs(at[0]) + dlat)))
    dlon = math.degrees(metres / EARTH_M) / reach * 1.001
    if dlon < 180 and abs(at[0]) + dlat < 89 and -180 <= at[1] - dlon and at[1] + dlon <= 180:
        df = df.where(F.col(lon).between(at[1] - dlon, at[1] + dlon))
    return df.where(haversine(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1])) <= metres)


def nearest(df: DataFrame, key: str, lat: str, lon: str, at: tuple[float, float], n: int) -> DataFrame:
    """(key, metres) of the n nearest points, ties by key."""
    ok = df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    d = F.round(haversine(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1])), 3)
    return ok.select(key, d.alias("metres")).orderBy("metres", key).limit(n)


def in_rings(lat: Column, lon: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over the edges of a constant polygon, as one expression."""
    crossings = F.lit(0)
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            if y1 != y2:
                hit = ((lat < y1) != (lat < y2)) & (lon < F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1)))
                crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def polygon(df: DataFrame, lat: str, lon: str, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Points inside; the bounding box goes to the scan first."""
    ys, xs = zip(*[p for r in rings for p in r])
    df = df.where(F.col(lat).between(min(ys), max(ys)) & F.col(lon).between(min(xs), max(xs)))
    return df.where(in_rings(F.col(lat), F.col(lon), rings))


def regular_polygon(at: tuple[float, float], metres: float, sides: int) -> list[tuple[float, float]]:
    """Corners at a great-circle distance from a centre, evenly turned."""
    a, b, d = math.radians(at[0]), math.radians(at[1]), metres / EARTH_M
    out = []
    for i in range(sides):
        t = 2 * math.pi * i / sides
        lat = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(t))
        lon = b + math.atan2(math.sin(t) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(lat))
        out.append((math.degrees(lat), (math.degrees(lon) + 540) % 360 - 180))
    return out


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _inside(p, ring) -> bool:
    hit = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (p[0] < y1) != (p[0] < y2) and p[1] < x1 + (p[0] - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def relation(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> str:
    """WITHIN, CONTAINS, INTERSECTS or DISJOINT of two simple rings, a towards b."""
    edges = lambda r: list(zip(r, r[1:] + r[:1]))
    for p, q in edges(a):
        for r, s in edges(b):
            if _cross(p, q, r) * _cross(p, q, s) < 0 and _cross(r, s, p) * _cross(r, s, q) < 0:
                return "INTERSECTS"
    if all(_inside(p, b) for p in a):
        return "WITHIN"
    if all(_inside(p, a) for p in b):
        return "CONTAINS"
    return "INTERSECTS" if any(_inside(p, b) for p in a) or any(_inside(p, a) for p in b) else "DISJOINT"


def shape_relations(shapes: DataFrame, key: str, ring: str, query: list[tuple[float, float]]) -> DataFrame:
    """(key, relation) of every shape towards a query polygon; rings of fewer than 3 points give none."""
    kind = shapes.schema[key].dataType.simpleString()

    def work(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for k, r in zip(f["k"], f["r"]):
                pts = [(p["latitude"], p["longitude"]) for p in r] if r is not None else []
                pts = pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts
                if len(pts) > 2:
                    rows.append((k, relation(pts, query)))
            yield pd.DataFrame(rows, columns=[key, "relation"])

    return shapes.select(F.col(key).alias("k"), F.col(ring).alias("r")).mapInPandas(work, f"{key} {kind}, relation string")
