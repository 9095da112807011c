"""The general problems against their plain versions, on small fixtures with every kind of odd row."""

import datetime as dt
import json
import random

import numpy as np
import plain
import pytest
from lodestone.operators import drift, instants, spatial, spikes

NAN, INF = float("nan"), float("inf")
T0 = dt.datetime(2020, 1, 1)


# ---- p6
def _feeds(spark):
    return spark.createDataFrame([("A", "America/New_York", "MDY"), ("B", "Europe/Berlin", "DMY"), ("C", None, "DMY"), ("D", "No/Where", "DMY"), ("E", "UTC", None)], "feed_id string, tz_name string, slash_order string")


def _texts(spark, rows):
    return spark.createDataFrame([("t", str(i), "f", feed, T0 + dt.timedelta(minutes=i), text) for i, (feed, text) in enumerate(rows)], "table_name string, row_key string, field_name string, feed_id string, received_at timestamp_ntz, text string")


TEXTS = [
    "2016-03-13T01:19:25", "2015-01-04T23:33:41+01:00[Europe/Berlin]", "20-Aug-2016 02:56:22.705", "  2015-03-07 19:01:26 EST  ", "1457850471", "1457850471123", "1457850471123456",
    "2015-01-05 01:05:51.138077+0100", "20160101T010203Z", "03/04/2015 05:06:07 PM", "13/04/2015 05:06", "04/13/2015 5:06", "Oct 29 2015  3:36PM", "Feb 30 2015 3:36PM", "Mon, 02 Jun 2008 08:14:50 +0200",
    "2016-11-06 01:30:00", "2016-03-13 02:30:00", "2016-10-30 02:30:00", "2016-03-27 02:30:00", "2016-02-30 01:00:00", "2016-02-01 24:00:00", "2016-02-01 10:60:00", "2016-02-01 10:10:60", "31-Xxx-2016 10:00:00",
    "unknown", "", "   ", None, "0", "06:30", "NULL", "2016-02-01 10:10:10 XYZ", "12/12/2015 12:00:00 AM", "12/12/2015 12:00:00 pm", "13/13/2015 10:00", "05-dec-2019 16:41:16", "12345678901",
]


def test_instants_match_the_plain_reading(spark):
    zones = {"A": ("America/New_York", "MDY"), "B": ("Europe/Berlin", "DMY"), "C": (None, "DMY"), "D": (None, "DMY")}
    rows = [(feed, t) for feed in zones for t in TEXTS]
    got = {int(r["row_key"]): r["utc_us"] for r in instants.resolve_instants(_texts(spark, rows), _feeds(spark)).collect()}
    want = {i: u for i, (feed, t) in enumerate(rows) if (u := plain.instant(t, *zones[feed])) is not None}
    assert got == want


def test_record_order_decides_without_declaration(spark):
    rows = [("E", f"{d:02d}/03/2015 10:00:00") for d in range(9, 29)]
    got = instants.resolve_instants(_texts(spark, rows), _feeds(spark)).collect()
    want = {i: plain.instant(t, "UTC", "DMY") for i, (_, t) in enumerate(rows)}
    assert {int(r["row_key"]): r["utc_us"] for r in got} == want


def _walk(rng, n, order):
    """A source's texts in record order: slash dates of one order among others, some late, and what they mean."""
    rows, at = [], dt.datetime(2015, 1, 1)
    for _ in range(n):
        at += dt.timedelta(hours=rng.uniform(1, 60))
        when = at.replace(microsecond=0) - (dt.timedelta(days=rng.uniform(20, 300)) if rng.random() < 0.3 else dt.timedelta(minutes=rng.uniform(0, 90)))
        when = when.replace(microsecond=0, second=0)
        form = rng.choice(["%d/%m/%Y %H:%M" if order == "DMY" else "%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M:%S"])
        rows.append((at, when.strftime(form), int(when.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)))
    return rows


@pytest.mark.parametrize("order", ["DMY", "MDY"])
def test_record_order_finds_an_undeclared_order(spark, order, monkeypatch):
    rows = _walk(random.Random(3), 400, order)
    texts = spark.createDataFrame([("t", str(i), "f", "E", at, text) for i, (at, text, _) in enumerate(rows)], "table_name string, row_key string, field_name string, feed_id string, received_at timestamp_ntz, text string")
    got = {int(r["row_key"]): r["utc_us"] for r in instants.resolve_instants(texts, _feeds(spark)).collect()}
    assert len(got) == len(rows) and sum(got[i] == r[2] for i, r in enumerate(rows)) >= 0.99 * len(rows)
    # the chain bears weight: without it the single records decide, and worse
    read = instants.with_interpretations(texts.join(_feeds(spark), "feed_id"), "text", "tz_name", "slash_order").orderBy("received_at")
    table = read.selectExpr("row_key", "cast(1 as long) as __seq", "unix_micros(cast(received_at as timestamp)) as received_us", "__cand", "__open").toArrow()

    def right(switch):
        monkeypatch.setattr(instants, "SWITCH", switch)
        part = instants.Stretch(table)
        ((_, a, b),) = part.runs()
        state = part.states(a, b, 0.0, 0.0)
        chosen = part.best[0].copy()
        chosen[part.telling] = np.where(state == 1, part.best[1][part.telling], part.best[0][part.telling])
        keys = table.column("row_key").to_pylist()
        return sum(part.us[c] == rows[int(keys[i])][2] for c, i in zip(chosen, part.live))

    assert right(0.0) < right(4.0)


def test_partitions_do_not_change_the_decoding():
    import numpy as np

    rng = np.random.default_rng(1)
    part = instants.Stretch.__new__(instants.Stretch)
    part.x = rng.normal(0, 3, 500)
    whole = part.states(0, 500, 0.0, 0.0)
    # by brute force: the path of least cost, of which x is the difference at each record
    cost = np.stack([part.x, np.zeros(500)], 1)
    best, back = cost[0].copy(), []
    for t in range(1, 500):
        step = np.array([[best[p] + instants.SWITCH * (p != s) for p in (0, 1)] for s in (0, 1)])
        back.append(step.argmin(1))
        best = step.min(1) + cost[t]
    path = [int(best.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert (whole == np.array(path[::-1])).all()
    for cuts in ([0, 1, 2, 250, 500], [0, 77, 78, 499, 500], list(range(0, 501, 4))):
        rows = [{"seq": 1, "pos": a, **dict(zip(("c", "low", "high", "back", "least", "most"), part.summary(a, b)))} for a, b in zip(cuts, cuts[1:])]
        borders = instants.chain(rows)
        pieces = [part.states(a, b, *borders[1, a]) for a, b in zip(cuts, cuts[1:])]
        assert (np.concatenate(pieces) == whole).all()


def test_a_repeated_half_hour(spark):
    feeds = spark.createDataFrame([("L", "Australia/Lord_Howe", "DMY")], "feed_id string, tz_name string, slash_order string")
    # clocks went back by 30 minutes at 02:00 on 5 April 2015
    got = [r["utc_us"] for r in instants.resolve_instants(_texts(spark, [("L", "2015-04-05 01:45:00")]), feeds).collect()]
    assert got == [int(dt.datetime(2015, 4, 4, 14, 45, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)]


def test_instants_of_nothing(spark):
    assert instants.resolve_instants(_texts(spark, [("A", "x")]).limit(0), _feeds(spark)).count() == 0
    assert instants.resolve_instants(_texts(spark, [("A", "2016-01-01 00:00:00")]), _feeds(spark).limit(0)).count() == 0


# ---- p4
FIELDS = ("trip_distance", "passenger_count", "pickup_latitude")


def _trips(seed, meters=6, most=80, big=0):
    rng, rows, trip = random.Random(seed), [], 0
    for m in range(meters):
        stuck = 0
        for s in range(rng.randint(1, most) if m or not big else big):
            trip += 1
            stuck = stuck - 1 if stuck else rng.choice([0] * 15 + [9, 7])
            d = 2.5 if stuck else round(rng.uniform(0.5, 4), 2)
            d = rng.choice([d] * 40 + [NAN, INF, -1.0, None, 500.0])
            p = rng.choice([1] * 30 + [2, 3, None, -1, 90])
            lat = rng.choice([round(40.7 + rng.gauss(0, 0.02), 6)] * 30 + [None, NAN, 91.0, 0.0, -40.7]) if not stuck else 40.75
            rows.append((trip, f"m{m}" if m != 3 else None, None if rng.random() < 0.02 else 2 * s, d, p, lat, "x"))
    rows += rows[: len(rows) // 10]
    rng.shuffle(rows)
    return rows


SCHEMA = "trip_id long, meter_id string, trip_seq long, trip_distance double, passenger_count int, pickup_latitude double, source string"


def _plain_spikes(rows):
    return plain.spikes([(r[0], r[1], r[2], dict(zip(FIELDS, r[3:6]))) for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_spikes_of_light_sources(spark, seed):
    rows = _trips(seed)
    got = [tuple(r) for r in spikes.find_spikes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_spikes(rows)


def test_spikes_of_heavy_sources_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(spikes, "LIGHT_ROWS", 60)
    monkeypatch.setattr(spikes, "BLOCK", 16)
    rows = _trips(5, meters=4, most=150, big=600)
    got = [tuple(r) for r in spikes.find_spikes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_spikes(rows)


def test_runs_over_block_borders(spark, monkeypatch):
    monkeypatch.setattr(spikes, "LIGHT_ROWS", 10)
    monkeypatch.setattr(spikes, "BLOCK", 8)
    rows = [(i, "m", i, 1.5 if 5 <= i < 30 or 36 <= i < 43 else 1.41 + (i % 7) / 50, 1, 40.0 + i / 1000, "x") for i in range(60)]
    got = {tuple(r) for r in spikes.find_spikes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _plain_spikes(rows) and len([1 for _, f in got if f == "trip_distance"]) == 25


def test_spikes_of_nothing(spark):
    assert spikes.find_spikes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spikes.find_spikes(spark.createDataFrame([(None, "m", 1, NAN, 1, 1.0, "x")], SCHEMA)).count() == 0


# ---- p5
SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
HOLE = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]


def _places(spark):
    stands = spark.createDataFrame([("S1", 1.0, 1.0, 50_000.0), ("S2", 0.0, 179.9, 60_000.0), ("S3", 89.9, 0.0, 50_000.0), ("S4", None, 1.0, 10.0), ("S5", 5.0, 5.0, 0.0)], "place_id string, latitude double, longitude double, radius_m double")
    rings = lambda *rs: [[{"latitude": y, "longitude": x} for y, x in r] for r in rs]
    zones = spark.createDataFrame([("Z1", rings(SQUARE, HOLE)), ("Z2", rings(HOLE)), ("Z3", []), ("Z4", None)], "place_id string, rings array<array<struct<latitude:double,longitude:double>>>")
    return stands, zones


def _points():
    rng = random.Random(3)
    pts = [(rng.uniform(-12, 12), rng.uniform(-12, 12)) for _ in range(400)] + [(rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179, 180)) for _ in range(60)]
    pts += [(rng.uniform(89, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(1.0, 1.0)] * 200
    pts += [(None, 1.0), (1.0, None), (NAN, 1.0), (1.0, INF), (91.0, 0.0), (0.0, 181.0), (90.0, 180.0)]
    return [(i, *p) for i, p in enumerate(pts)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_places_by_either_way(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(spatial, "GROUP_ROWS", 50)
    monkeypatch.setattr(spatial, "LEAF_ROWS", 20)
    stands, zones = _places(spark)
    pts = _points()
    got = [tuple(r) for r in spatial.match_regions(spark.createDataFrame(pts, "k long, lat double, lon double"), spatial.regions(stands, zones), ["k"]).collect()]
    want = plain.places(pts, [tuple(r) for r in stands.collect() if r["latitude"] is not None], [("Z1", [SQUARE, HOLE]), ("Z2", [HOLE])])
    assert len(got) == len(set(got)) and set(got) == want


def test_places_of_nothing(spark):
    stands, zones = _places(spark)
    none = spark.createDataFrame([], "k long, lat double, lon double")
    assert spatial.match_regions(none, spatial.regions(stands, zones), ["k"]).count() == 0
    one = spark.createDataFrame([(1, 1.0, 1.0)], "k long, lat double, lon double")
    assert spatial.match_regions(one, spatial.regions(stands.limit(0), zones.limit(0)), ["k"]).count() == 0


def test_rtree_finds_what_a_scan_finds():
    import numpy as np

    rng = np.random.default_rng(1)
    low = rng.uniform(-50, 50, (300, 2))
    boxes = np.column_stack([low, low + rng.uniform(0, 5, (300, 2))])
    p = rng.uniform(-50, 55, (500, 2))
    got = set(zip(*map(list, spatial.RTree(boxes, np.arange(300)).probe(p[:, 0], p[:, 1]))))
    want = {(i, j) for i in range(500) for j in range(300) if boxes[j, 0] <= p[i, 0] <= boxes[j, 2] and boxes[j, 1] <= p[i, 1] <= boxes[j, 3]}
    assert got == want


# ---- p2
RAW = "file_id long, suite_id string, file_seq int, written_at timestamp_ntz, record_no int, run_key string, payload string, fields string"


def _raw():
    def file(no, suite, seq, docs, keys=None):
        return [(no, suite, seq, T0, i, (keys or [f"r{i}" for i in range(len(docs))])[i], d if isinstance(d, str) or d is None else json.dumps(d), "x") for i, d in enumerate(docs)]

    rows = file(1, "s", 1, [{"a": 1, "b": 2, "C": True, "n": None}, {"a": 3, "b": 4, "C": False}])
    rows += file(2, "s", 3, ['{"a": 1.0, "bb": 2e0, "c": true, "n": 5}', {"a": 3, "bb": 4.0, "c": False}, '{"a": 1, "zz"'])
    rows += file(3, "s", 4, [{"a": "1", "bb": 9, "c": True, "n": "x"}, None, "[1]", "17"])
    rows += file(4, "s", 6, [{"a": "1", "q": 8, "c": [1], "n": "x"}])
    rows += file(5, "s", 7, ["broken", ""])
    rows += file(6, "s", 8, [{"a": "1", "q": {"x": 1}, "d": [1], "n": None}])
    rows += file(7, "t", 1, [{"x": 1}]) + file(8, "t", 2, [{}]) + file(9, "t", 3, [{"x": 1, "y": 1}])
    rows += file(10, "u", 1, [{"x": 1}, {"x": 2}], [None, None]) + file(11, "u", 2, [{"y": 1}, {"y": 2}], [None, None])
    return rows + rows[:3]


def test_drift_matches_the_plain_reading(spark):
    rows = _raw()
    got = [tuple(r) for r in drift.changes(spark.createDataFrame(rows, RAW)).collect()]
    want = plain.drift([(r[0], r[1], r[2], r[5], r[6]) for r in rows])
    assert len(got) == len(set(got)) and set(got) == want
    assert (2, "bb", "renamed") in want and (2, "c", "renamed") in want and (3, "a", "retyped") in want


def test_one_table_and_lifespans(spark):
    raw = spark.createDataFrame(_raw(), RAW)
    out = drift.one_table(raw)
    assert out.count() == 14 and {"a", "bb", "d"} <= set(out.columns)
    first = {r["record_no"]: r for r in out.where("file_id = 1").collect()}
    assert first[0]["bb"] == 2.0
    spans = {(r["suite_id"], r["field_name"], r["first_file"], r["last_file"]) for r in drift.lifespans(raw).collect()}
    assert ("t", "x", 7, 7) in spans and ("t", "x", 9, 9) in spans
    none = raw.limit(0)
    assert drift.changes(none).count() == 0 and drift.one_table(none).count() == 0


def test_one_table_keeps_every_value(spark):
    docs = [{"rev": "6f3a", "cpu_ms": 1.5, "cores": 2, "t_sec": 3.0, "big": 2**60 + 1, "m": True, "o": 1.0, "z": None}]
    docs += [{"rev": 19, "cpu_ms": "2.5 ms", "cores": "~12.394", "t_sec": {"value": 4, "unit": "ms"}, "big": "1", "m": "yes", "o": [1, 2], "z": 1}]
    docs += [{"rev": "12e9999", "cpu_ms": {"value": 3.5, "unit": "ms"}, "cores": [4], "t_sec": "5", "big": 2, "m": [False], "o": {"p": 1}, "z": 2}]
    rows = [(i + 1, "s", i + 1, T0, 0, "r", json.dumps(d), "x") for i, d in enumerate(docs)]
    out = drift.one_table(spark.createDataFrame(rows, RAW))
    got = {r["file_id"]: r.asDict() for r in out.collect()}
    for i, d in enumerate(docs):
        assert [k for k in d if (got[i + 1][k] is None) != (d[k] is None)] == []
    types = dict(out.dtypes)
    assert [k for k in docs[0] if types[k] == "double"] == ["cpu_ms", "cores", "z"] and "z_raw" not in types
    assert [got[i]["cpu_ms"] for i in (1, 2, 3)] == [1.5, 2.5, 3.5] and [got[i]["cores"] for i in (1, 2, 3)] == [2.0, 12.394, 4.0]
    assert got[2]["cores_raw"] == "~12.394" and got[2]["rev"] == "19" and got[1]["big"] == str(2**60 + 1)


def test_the_decomposition_decides_what_is_a_spike(monkeypatch):
    """Sources with a profile of their own and spikes of 13 to 40 scales: found whole, and not with noise for the low-rank part."""
    rng = np.random.default_rng(5)
    value, group, true = [], [], []
    for g in range(60):
        n = int(rng.integers(60, 400))
        profile = np.tile(rng.normal(0, 0.8, 8), n // 8 + 1)[:n] * rng.uniform(0.5, 1.5)
        v = profile + rng.normal(0, 0.7, n)
        at = rng.random(n) < 0.03
        v[at] += rng.choice([-1, 1], at.sum()) * rng.uniform(16, 40, at.sum())
        value.append(v)
        group.append(np.full(n, g))
    value, group = np.concatenate(value), np.concatenate(group)
    median = spikes.group_median(value, group, 60)[group]
    scale = spikes.group_median(np.abs(value - median), group, 60)[group]
    true = np.abs(value - median) > spikes.LIMIT * scale
    assert true.sum() > 100 and (spikes.spikes(value, group, median, scale) == true).all()
    monkeypatch.setattr(spikes, "robust_pca", lambda rows, group: np.random.default_rng(1).normal(0, 10, rows.shape))
    assert spikes.spikes(value, group, median, scale).sum() < 0.8 * true.sum()


def test_low_rank_and_sparse_parts_are_told_apart():
    rng = np.random.default_rng(2)
    low = rng.normal(size=(40, 1)) @ rng.normal(size=(1, 8)) * 2
    sparse = np.where(rng.random(low.shape) < 0.04, 30.0, 0.0)
    got = spikes.robust_pca(low + sparse, np.zeros(40, int))
    assert np.median(np.abs(got - low)) < 0.5 and np.abs(got - low)[sparse > 0].max() < 15


@pytest.mark.parametrize("piece", [3, 20_000])
def test_points_near_points(spark, monkeypatch, piece):
    monkeypatch.setattr(spatial, "PIECE_ROWS", piece)
    monkeypatch.setattr(spatial, "GROUP_ROWS", 40)
    monkeypatch.setattr(spatial, "LEAF_ROWS", 20)
    rng = np.random.default_rng(6)
    rows = [(i, float(40 + rng.normal(0, 0.01)), float(-74 + rng.normal(0, 0.01))) for i in range(300)] + [(i, 41.0, 179.9999 * (-1) ** i) for i in range(300, 310)]
    rows += [(400, None, 1.0), (401, NAN, 1.0), (402, 91.0, 1.0), (None, 40.0, -74.0)]
    points = spark.createDataFrame([(*r, "x") for r in rows], "id long, lat double, lon double, place_id string").drop("place_id")
    got = [tuple(r) for r in spatial.near_points(points, points.where("id % 3 = 0"), "id", 300.0).collect()]
    good = [r for r in rows if r[0] is not None and r[0] < 400]
    want = {(a[0], b[0]) for a in good if a[0] % 3 == 0 for b in good if a[0] != b[0] and spatial.haversine_m(a[1], a[2], b[1], b[2]) <= 300}
    got = [g for g in got if None not in g]
    assert len(got) == len(set(got)) and set(got) == want
