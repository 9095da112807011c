"""Plain, slow versions of the problems' definitions, for comparison in tests."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections import defaultdict
from zoneinfo import ZoneInfo

ABBR = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "CET": 1, "CEST": 2, "BST": 1, "GMT": 0, "UTC": 0, "Z": 0}
MON = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def instant(text, tz, order):
    """utc microseconds or None; datetime and zoneinfo instead of Spark's calendar."""
    t = (text or "").strip()
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}", t):
        return int(t) * {10: 10**6, 13: 1000, 16: 1}[len(t)]
    forms = [
        r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)[T ](?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)(?:\.(?P<f>\d+))? ?(?P<z>[A-Za-z]+|[+-]\d\d:?\d\d)?(?:\[.*\])?",
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)T(?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d)(?P<z>Z)",
        r"(?P<d>\d\d?)-(?P<mon>[A-Za-z]{3})-(?P<y>\d{4}) (?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)(?:\.(?P<f>\d+))?",
        r"(?P<mon>[A-Za-z]{3}) +(?P<d>\d\d?) (?P<y>\d{4}) +(?P<H>\d\d?):(?P<M>\d\d)(?P<ap>[AaPp][Mm])",
        r"(?P<a>\d\d?)/(?P<b>\d\d?)/(?P<y>\d{4}) (?P<H>\d\d?):(?P<M>\d\d)(?::(?P<S>\d\d))?(?: (?P<ap>[AaPp][Mm]))?",
        r"[A-Za-z]{3}, (?P<d>\d\d?) (?P<mon>[A-Za-z]{3}) (?P<y>\d{4}) (?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d) (?P<z>[+-]\d{4}|[A-Z]+)",
    ]
    for form in forms:
        if m := re.fullmatch(form, t):
            g = defaultdict(lambda: None, m.groupdict())
            break
    else:
        return None
    if g["a"]:
        g["m"], g["d"] = (g["a"], g["b"]) if order == "MDY" else (g["b"], g["a"])
    if g["mon"]:
        if g["mon"].lower() not in MON:
            return None
        g["m"] = MON.index(g["mon"].lower()) + 1
    hour = int(g["H"])
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"].upper() == "PM")
    try:
        local = dt.datetime(int(g["y"]), int(g["m"]), int(g["d"]), hour, int(g["M"]), int(g["S"] or 0), int((g["f"] or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None
    if z := g["z"]:
        if z[0] in "+-":
            k = z.replace(":", "")
            off = (1 if z[0] == "+" else -1) * dt.timedelta(hours=int(k[1:3]), minutes=int(k[3:5]))
        elif z.upper() in ABBR:
            off = dt.timedelta(hours=ABBR[z.upper()])
        else:
            return None
    elif tz:
        off = local.replace(tzinfo=ZoneInfo(tz), fold=0).utcoffset()
    else:
        return None
    return (local - off - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def _median(v):
    v = sorted(v)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def spikes(rows):
    """rows: (trip_id, meter_id, trip_seq, {field: value}); cases as (trip_id, field)."""
    rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    out = set()
    floors = {"trip_distance": 0.05, "passenger_count": 0.4, "pickup_latitude": 0.002}
    meters = defaultdict(list)
    for r in rows:
        meters[r[1]].append(r)
    for f, floor in floors.items():
        for trip, _, _, v in rows:
            x = v[f]
            if x is not None and (not math.isfinite(x) or (abs(x) > 90 if f == "pickup_latitude" else x < 0)):
                out.add((trip, f))
        for meter, own in meters.items():
            if meter is None:
                continue
            fin = [r[3][f] for r in own if r[3][f] is not None and math.isfinite(r[3][f])]
            if fin:
                med = _median(fin)
                scale = max(_median([abs(x - med) for x in fin]), floor)
                out |= {(r[0], f) for r in own if r[3][f] is not None and math.isfinite(r[3][f]) and abs(r[3][f] - med) > 12 * scale}
            if f != "passenger_count":
                run = []
                for r in [*sorted((r for r in own if r[2] is not None), key=lambda r: r[2]), (None, None, None, {f: None})]:
                    x = r[3][f]
                    if run and x is not None and x == run[-1][3][f]:
                        run.append(r)
                        continue
                    if len(run) >= 8:
                        out |= {(q[0], f) for q in run}
                    run = [r] if x is not None and math.isfinite(x) else []
    return out


def places(points, stands, zones):
    """points: (key, lat, lon); pairs (key, place_id)."""
    out = set()
    for key, lat, lon in points:
        if lat is None or lon is None or not (abs(lat) <= 90 and abs(lon) <= 180):
            continue
        for place, a, b, r in stands:
            h = math.sin(math.radians(a - lat) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(lat)) * math.sin(math.radians(b - lon) / 2) ** 2
            if 2 * 6371008.8 * math.asin(min(1, math.sqrt(h))) <= r:
                out.add((key, place))
        for place, rings in zones:
            inside = False
            for ring in rings:
                for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
                    if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                        inside = not inside
            if inside:
                out.add((key, place))
    return out


def drift(rows):
    """rows: (file_id, suite_id, file_seq, run_key, payload); changes as (file_id, field, kind)."""
    kinds = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
    files = defaultdict(lambda: defaultdict(dict))
    for file, suite, seq, run, payload in rows:
        try:
            doc = json.loads(payload)
        except (ValueError, TypeError):
            continue
        if isinstance(doc, dict):
            files[suite][(seq, file)].setdefault(run, []).append(doc)
    out = set()
    for own in files.values():
        order = sorted(own)
        for a, b in zip(order, order[1:]):
            seen = []
            for f in (a, b):
                types = defaultdict(set)
                for docs in own[f].values():
                    for doc in docs:
                        for k, v in doc.items():
                            types[k] |= set() if v is None else {kinds[type(v)]}
                seen.append(types)
            lost, new = set(seen[0]) - set(seen[1]), set(seen[1]) - set(seen[0])
            gone, come = set(), set()
            for x in lost:
                for y in new:
                    vals = [(p[x], q[y]) for run in own[a].keys() & own[b].keys() if run for p in own[a][run] for q in own[b][run] if p.get(x) is not None and q.get(y) is not None]
                    if vals and all(p == q and kinds[type(p)] == kinds[type(q)] for p, q in vals) and len({kinds[type(p)] for p, _ in vals}) == 1:
                        gone.add(x)
                        come.add(y)
            out |= {(b[1], y, "renamed") for y in come} | {(b[1], x, "removed") for x in lost - gone} | {(b[1], y, "added") for y in new - come}
            out |= {(b[1], k, "retyped") for k in set(seen[0]) & set(seen[1]) if seen[0][k] and seen[1][k] and seen[0][k] != seen[1][k]}
    return out
