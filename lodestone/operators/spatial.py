"""Points near places or inside regions.

A bounded sample of the points decides a quadtree whose leaves hold about equally many points.
Every region is replicated to each leaf that its bounding box meets; the copies in a leaf are
bulk-loaded into a packed R-tree (sort-tile-recursive). A point is looked up in the one leaf that
holds it, candidates are refined exactly, and a pair counts only in the leaf of its reference
point (the point itself), so that replication never gives a pair twice.

Regions whose measured size stays below ``BROADCAST_BYTES`` travel to the points, which then
need no shuffle; otherwise both sides are shuffled by leaf. The points of a leaf with many are dealt
over salts, the regions of a leaf with many over pieces, and every salt meets every piece in a task
of its own. ``near_points`` gives the points near other points in that way.

Defined results: a null, NaN or infinite coordinate, a latitude outside -90..90 or a longitude
outside -180..180 matches nothing; so does a region without usable geometry. Empty tables give
an empty result. Distances are great-circle distances; polygons are plane, by the even-odd rule
over all rings, which need not be closed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
DEPTH = 24
SAMPLE_ROWS = 20_000
LEAF_ROWS = 250
NODE = 8
#: Serialised regions up to this size are broadcast; beyond it they are shuffled by leaf.
BROADCAST_BYTES = 8 << 20
#: Rows of points that one task takes of one leaf in the shuffled way.
GROUP_ROWS = 200_000
#: Regions that one task takes of one leaf in the shuffled way.
PIECE_ROWS = 20_000

REGION_SCHEMA = "place_id string, lat double, lon double, radius_m double, rings array<array<struct<latitude:double,longitude:double>>>"


def regions(stands: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Circles and polygons in one table of ``REGION_SCHEMA``."""
    out = []
    if stands is not None:
        out.append(stands.selectExpr("place_id", "latitude lat", "longitude lon", "radius_m", "cast(null as array<array<struct<latitude:double,longitude:double>>>) rings"))
    if zones is not None:
        out.append(zones.selectExpr("place_id", "cast(null as double) lat", "cast(null as double) lon", "cast(null as double) radius_m", "rings"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def morton(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Position of valid points along the Z-curve, ``DEPTH`` bits an axis."""
    top = (1 << DEPTH) - 1
    y = np.minimum((lat + 90.0) / 180.0 * (1 << DEPTH), top)
    x = np.minimum((lon + 180.0) / 360.0 * (1 << DEPTH), top)
    return (_spread(y.astype(np.uint64)) << np.uint64(1)) | _spread(x.astype(np.uint64))


def valid(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (lat >= -90) & (lat <= 90) & (lon >= -180) & (lon <= 180)


@dataclass
class Quadtree:
    """Leaves in order of the Z-curve: first code, and box (south, west, north, east)."""

    start: np.ndarray
    box: np.ndarray
    share: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @staticmethod
    def fit(lat: np.ndarray, lon: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Quadtree:
        codes = np.sort(morton(lat, lon)) if len(lat) else np.zeros(0, np.uint64)
        start, box, share = [], [], []

        def split(code: int, depth: int, s: float, w: float, n: float, e: float) -> None:
            width = 1 << (2 * (DEPTH - depth))
            a, b = np.searchsorted(codes, np.uint64(code)), np.searchsorted(codes, np.uint64(code + width))
            if b - a <= leaf_rows or depth == DEPTH:
                start.append(code)
                box.append((s, w, n, e))
                share.append((b - a) / max(1, len(codes)))
                return
            y, x, q = (s + n) / 2, (w + e) / 2, width // 4
            for k, quarter in enumerate(((s, w, y, x), (s, x, y, e), (y, w, n, x), (y, x, n, e))):
                split(code + k * q, depth + 1, *quarter)

        split(0, 0, -90.0, -180.0, 90.0, 180.0)
        return Quadtree(np.array(start, np.uint64), np.array(box), np.array(share))

    def leaf(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, morton(lat, lon), side="right") - 1

    def meeting(self, box: tuple[float, float, float, float]) -> np.ndarray:
        s, w, n, e = box
        b = self.box
        return np.flatnonzero((b[:, 0] <= n) & (b[:, 2] >= s) & (b[:, 1] <= e) & (b[:, 3] >= w))


def boxes_of(region: dict) -> list[tuple[float, float, float, float]]:
    """Bounding boxes (south, west, north, east) of a region; two where a circle crosses the date line."""
    if region["rings"] is not None:
        pts = [(p["latitude"], p["longitude"]) for ring in region["rings"] if ring is not None for p in ring if p is not None and p["latitude"] is not None and p["longitude"] is not None]
        if not pts or not np.isfinite(pts).all():
            return []
        lat, lon = zip(*pts)
        return [(min(lat), min(lon), max(lat), max(lon))]
    lat, lon, r = region["lat"], region["lon"], region["radius_m"]
    if lat is None or lon is None or r is None or not (math.isfinite(lat) and math.isfinite(lon) and r >= 0) or abs(lat) > 90:
        return []
    angle = min(r / EARTH_M * (1 + 1e-9) + 1e-12, math.pi)
    dlat = math.degrees(angle)
    s, n = lat - dlat, lat + dlat
    if s <= -90 or n >= 90:
        return [(max(s, -90.0), -180.0, min(n, 90.0), 180.0)]
    dlon = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
    w, e = lon - dlon, lon + dlon
    if e - w >= 360:
        return [(s, -180.0, n, 180.0)]
    if w < -180:
        return [(s, -180.0, n, e), (s, w + 360, n, 180.0)]
    if e > 180:
        return [(s, w, n, 180.0), (s, -180.0, n, e - 360)]
    return [(s, w, n, e)]


class RTree:
    """Packed R-tree over boxes; built once by sort-tile-recursive, probed with many points at once."""

    def __init__(self, boxes: np.ndarray, ids: np.ndarray):
        order = np.arange(len(boxes))
        if len(boxes) > NODE:
            centre = (boxes[:, :2] + boxes[:, 2:]) / 2
            slices = math.ceil(math.sqrt(math.ceil(len(boxes) / NODE)))
            by_lon = np.argsort(centre[:, 1], kind="stable")
            size = math.ceil(len(boxes) / slices / NODE) * NODE
            order = np.concatenate([part[np.argsort(centre[part, 0], kind="stable")] for part in (by_lon[i : i + size] for i in range(0, len(by_lon), size))])
        self.ids, self.levels = ids[order], [boxes[order]]
        while len(self.levels[-1]) > NODE:
            low = self.levels[-1]
            at = np.arange(0, len(low), NODE)
            self.levels.append(np.column_stack([np.minimum.reduceat(low[:, :2], at), np.maximum.reduceat(low[:, 2:], at)]))

    def probe(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, id) of every box that holds a point."""
        point = np.repeat(np.arange(len(lat)), len(self.levels[-1]))
        node = np.tile(np.arange(len(self.levels[-1])), len(lat))
        for depth in range(len(self.levels) - 1, -1, -1):
            b = self.levels[depth][node]
            keep = (lat[point] >= b[:, 0]) & (lon[point] >= b[:, 1]) & (lat[point] <= b[:, 2]) & (lon[point] <= b[:, 3])
            point, node = point[keep], node[keep]
            if depth:
                child = node[:, None] * NODE + np.arange(NODE)
                inside = child < len(self.levels[depth - 1])
                point, node = np.repeat(point, NODE)[inside.ravel()], child.ravel()[inside.ravel()]
        return point, self.ids[node]


class Matcher:
    """Per-leaf R-trees over regions and the exact tests."""

    def __init__(self, rows: list[dict], tree: Quadtree, only: int | None = None):
        self.tree, self.only = tree, only
        self.place = np.array([r["place_id"] for r in rows], dtype=object)
        self.edges: list[np.ndarray | None] = []
        circles = np.full((len(rows), 3), np.nan)
        per_leaf: dict[int, list[tuple[tuple, int]]] = {}
        for i, r in enumerate(rows):
            boxes = boxes_of(r)
            if r["rings"] is None:
                if boxes:
                    circles[i] = r["lat"], r["lon"], r["radius_m"]
                self.edges.append(None)
            else:
                self.edges.append(_edges(r["rings"]))
            for box in boxes:
                for leaf in tree.meeting(box) if only is None else [only]:
                    per_leaf.setdefault(int(leaf), []).append((box, i))
        self.circle = circles
        self.rtree = {k: RTree(np.array([b for b, _ in v]), np.array([i for _, i in v])) for k, v in per_leaf.items()}

    def pairs(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, region) pairs that hold exactly, each once."""
        ok = np.flatnonzero(valid(lat, lon))
        leaf = self.tree.leaf(lat[ok], lon[ok]) if len(ok) else np.zeros(0, int)
        order = np.argsort(leaf, kind="stable")
        ok, leaf = ok[order], leaf[order]
        cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True]) if len(leaf) else np.zeros(1, int)
        found_p, found_r = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            # the reference point of a pair is the point: only its own leaf may report the pair
            tree = self.rtree.get(int(leaf[a]))
            if tree is None or self.only is not None and leaf[a] != self.only:
                continue
            own = ok[a:b]
            p, r = tree.probe(lat[own], lon[own])
            found_p.append(own[p])
            found_r.append(r)
        if not found_p:
            return np.zeros(0, int), np.zeros(0, int)
        p, r = np.concatenate(found_p), np.concatenate(found_r)
        hold = np.zeros(len(p), bool)
        round_ = ~np.isnan(self.circle[r, 0])
        c = self.circle[r[round_]]
        hold[round_] = haversine_m(lat[p[round_]], lon[p[round_]], c[:, 0], c[:, 1]) <= c[:, 2]
        for region in np.unique(r[~round_]):
            mine = np.flatnonzero(r == region)
            hold[mine] = even_odd(lat[p[mine]], lon[p[mine]], self.edges[region])
        p, r = p[hold], r[hold]
        # a circle over the date line has two boxes that may share a border
        both = np.unique(np.column_stack([p, r]), axis=0) if len(p) else np.zeros((0, 2), int)
        return both[:, 0], both[:, 1]


def haversine_m(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _edges(rings) -> np.ndarray:
    """Edges (lat1, lon1, lat2, lon2) of all rings, closed where they are not."""
    out = []
    for ring in rings:
        pts = [(p["latitude"], p["longitude"]) for p in (ring if ring is not None else []) if p is not None and p["latitude"] is not None and p["longitude"] is not None]
        out += [(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1]) if a != b]
    return np.array(out).reshape(-1, 4)


def even_odd(lat: np.ndarray, lon: np.ndarray, edges: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(lat), bool)
    for y1, x1, y2, x2 in edges:
        if y1 != y2:
            crosses = (lat < y1) != (lat < y2)
            inside ^= crosses & (lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1))
    return inside


def _fit(layout: DataFrame) -> tuple[Quadtree, int]:
    """The quadtree of a sample of at most about ``SAMPLE_ROWS`` points, and the number of points."""
    n = layout.count()
    sample = layout.sample(False, min(1.0, SAMPLE_ROWS / max(1, n)), 7).limit(2 * SAMPLE_ROWS).toArrow()
    lat, lon = (sample.column(c).to_numpy().astype(float) for c in ("lat", "lon"))
    ok = valid(lat, lon)
    return Quadtree.fit(lat[ok], lon[ok], LEAF_ROWS), n


def near_points(points: DataFrame, queries: DataFrame, key: str, radius_m: float, layout: DataFrame | None = None) -> DataFrame:
    """(key, near): for each point of a stated query set the other points within ``radius_m``.

    Both have key, lat, lon; a point is no neighbour of its own key. The circles around the queries
    are the regions, and always go the partitioned way.
    """
    kind = queries.schema[key].dataType
    circles = queries.where(F.col(key).isNotNull()).selectExpr(f"cast(`{key}` as string) place_id", "cast(lat as double) lat", "cast(lon as double) lon", f"cast({float(radius_m)} as double) radius_m", "cast(null as array<array<struct<latitude:double,longitude:double>>>) rings")
    found = match_regions(points, circles, [key], layout, broadcast_bytes=-1)
    return found.select(F.col("place_id").cast(kind).alias(key), F.col(key).alias("near")).where(F.col(key) != F.col("near"))


def match_regions(points: DataFrame, regions: DataFrame, keys: list[str], layout: DataFrame | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """(keys..., place_id) for every region that holds a point.

    ``points``: keys, lat, lon. ``layout`` (lat, lon) may name a cheaper table with the same
    distribution for the sample; it decides where leaves are cut, never what is found.
    """
    points = points.select(*keys, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    tree, n = _fit((layout if layout is not None else points).select("lat", "lon"))
    cells = F.lit(0).cast("long") + F.coalesce(F.aggregate("rings", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(F.size(r), F.lit(0))), F.lit(1).cast("long"))
    volume = regions.agg(F.coalesce(F.sum(64 + 16 * cells), F.lit(0))).first()[0]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema if f.name in keys)
    if volume <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        rows = [r.asDict(recursive=True) for r in regions.select("place_id", "lat", "lon", "radius_m", "rings").collect()]
        shared = points.sparkSession.sparkContext.broadcast(Matcher(rows, tree))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for batch in batches:
                lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
                p, r = matcher.pairs(lat, lon)
                out = batch.select(keys).take(pa.array(p))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(matcher.place[r], pa.string())], names=[*keys, "place_id"])

        return points.mapInArrow(probe, f"{kinds}, place_id string")
    return _match_shuffled(points, regions, keys, tree, n, kinds)


def _match_shuffled(points: DataFrame, regions: DataFrame, keys: list[str], tree: Quadtree, n: int, kinds: str) -> DataFrame:
    """Both sides by leaf; salts and pieces as said above."""
    context = points.sparkSession.sparkContext
    shared = context.broadcast(tree)
    salts = np.maximum(1, np.ceil(tree.share * n / GROUP_ROWS)).astype(int) if len(tree.share) else np.ones(len(tree.start), int)

    def leaves(batch: pa.RecordBatch) -> np.ndarray:
        """(row, leaf) of a batch of regions."""
        at = [sorted({int(x) for box in boxes_of(r) for x in shared.value.meeting(box)}) for r in batch.to_pylist()]
        return np.array([(i, leaf) for i, own in enumerate(at) for leaf in own], np.int64).reshape(-1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, number = np.unique(leaves(batch)[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(number)], names=["leaf", "number"])

    own = regions.select("place_id", "lat", "lon", "radius_m", "rings")
    # a row a leaf, and the leaves are bounded by the sample
    pieces = np.ones(len(tree.start), int)
    for r in own.mapInArrow(count, "leaf long, number long").groupBy("leaf").agg(F.sum("number").alias("number")).collect():
        pieces[r["leaf"]] = max(1, -(-r["number"] // PIECE_ROWS))
    dealt = context.broadcast((salts, pieces))

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, pieces = dealt.value
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
            ok = np.flatnonzero(valid(lat, lon))
            leaf = shared.value.leaf(lat[ok], lon[ok]) if len(ok) else np.zeros(0, int)
            salt = (np.arange(len(ok)) * 2654435761 % (1 << 32)) % salts[leaf]
            times = pieces[leaf]
            who = np.repeat(np.arange(len(ok)), times)
            piece = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(ok[who])).columns, *[pa.array(x, pa.int64()) for x in (leaf[who], salt[who], piece)]], names=[*batch.schema.names, "__leaf", "__salt", "__piece"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts, pieces = dealt.value
        for batch in batches:
            at = leaves(batch)
            times = salts[at[:, 1]]
            who = np.repeat(np.arange(len(at)), times)
            salt = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            piece = (at[:, 0] * 2654435761 % (1 << 32)) % pieces[at[:, 1]]
            columns = [*batch.take(pa.array(at[who, 0])).columns, *[pa.array(x, pa.int64()) for x in (at[who, 1], salt, piece[who])]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__leaf", "__salt", "__piece"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        leaf = (left if left.num_rows else right).column("__leaf")[0].as_py()
        matcher = Matcher(right.select(["place_id", "lat", "lon", "radius_m", "rings"]).to_pylist(), shared.value, only=leaf)
        p, r = matcher.pairs(left.column("lat").to_numpy(), left.column("lon").to_numpy())
        return left.select(keys).take(pa.array(p)).append_column("place_id", pa.array(matcher.place[r], pa.string()))

    group = ["__leaf", "__salt", "__piece"]
    more = ", __leaf long, __salt long, __piece long"
    a = points.mapInArrow(to_leaf, f"{kinds}, lat double, lon double{more}")
    b = own.mapInArrow(replicate, f"{REGION_SCHEMA}{more}")
    return a.groupBy(*group).cogroup(b.groupBy(*group)).applyInArrow(probe, f"{kinds}, place_id string")
