"""Readers on small files."""

import json
import struct

import numpy as np
from lodestone.sources import readers


def test_line_docs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("FIELDS_HEADER_INDICATOR\tdoctitle\tdocdate\tbody\tfacet\nT\t02-JAN-2020 03:04:05.678\tsome body\tx|y\nU\tnever\t\t\n")
    r = readers.line_docs(spark, f"{tmp_path}/a.txt").orderBy("title").collect()
    assert r[0]["body"] == "some body" and str(r[0]["ts"]) == "2020-01-02 03:04:05.678000" and r[0]["facet"] == "x|y"
    assert r[1]["ts"] is None and r[1]["body"] is None


def test_binary_blocks(spark, tmp_path):
    rows = [("Title", "Body é", "label", 12, 1_600_000_000_000), ("", "", "", 0, 0)]
    (tmp_path / "b.bin").write_bytes(readers.encode_block(rows) + readers.encode_block(rows[:1]))
    got = [tuple(r) for r in readers.binary_line_docs(spark, str(tmp_path)).collect()]
    assert got == rows + rows[:1]


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "v.vec").write_bytes(x.tobytes() + b"\0\0")
    got = readers.vector_file(spark, str(tmp_path), 3, start=1).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == [1, 2, 3] and got[0]["vector"] == [3.0, 4.0, 5.0]
    for kind, dtype in (("byte", "<i1"), ("float16", "<f2")):
        path = tmp_path / kind
        path.mkdir()
        (path / "v").write_bytes(np.array([1, -2, 3, 4]).astype(dtype).tobytes())
        assert [r["vector"] for r in readers.vector_file(spark, str(path), 2, kind).orderBy("ordinal").collect()] == [[1.0, -2.0], [3.0, 4.0]]


def test_rides(spark, tmp_path):
    (tmp_path / "r").write_text("g:1,2.5,\ny:9,,3\nx:1\n")
    heads = {"g": ["vendor_id", "trip_distance", "trip_type"], "y": ["vendor_id", "surcharge", "passenger_count"]}
    got = {r["cab_color"]: r for r in readers.rides(spark, f"{tmp_path}/r", heads).collect()}
    assert got["g"]["trip_distance"] == 2.5 and got["g"]["trip_type"] is None and got["y"]["passenger_count"] == 3 and got["y"]["surcharge"] is None
    assert "green_vendor_id" in readers.rides(spark, f"{tmp_path}/r", heads, sparse=True).columns


def test_small_text_formats(spark, tmp_path):
    (tmp_path / "h").write_text("a,b,c\na,,c\n")
    assert readers.hierarchy(spark, f"{tmp_path}/h", ["x", "y", "z"]).count() == 1
    (tmp_path / "p").write_text("1,2.5,-3.5\n")
    assert tuple(readers.points(spark, f"{tmp_path}/p").first()) == (1, 2.5, -3.5)
    (tmp_path / "e").write_text("1.5 add 7 100\n2.0 refresh\nbroken\n")
    assert [tuple(r) for r in readers.index_events(spark, f"{tmp_path}/e").collect()] == [(1.5, "add", 7, 100), (2.0, "refresh", None, None)]
    (tmp_path / "t").write_text("word 1.0 2.0\nalone\n")
    assert readers.token_vectors(spark, f"{tmp_path}/t").first()["v"] == [1.0, 2.0]
    (tmp_path / "n").write_text("\t".join(["5", "Name", "", "", "1.5", "2.5"] + [""] * 8 + ["77", "", "3", "UTC", "1970-01-02"]) + "\n")
    r = readers.place_names(spark, f"{tmp_path}/n").first()
    assert r["population"] == 77 and r["elevation"] is None and r["modified"] == 86_400_000
    (tmp_path / "d").write_text("# x\nDISCID=0123abcd\nDTITLE=Band / Album\nTTITLE0=One\nTTITLE1=Two\n")
    assert tuple(readers.disc_metadata(spark, f"{tmp_path}/d").first()) == ("0123abcd", "Band", "Album", ["One", "Two"])
    (tmp_path / "m").write_text('<node id="5" lat="1.5" lon="2.5"/>\n<way id="1"/>\n')
    assert tuple(readers.map_nodes(spark, f"{tmp_path}/m").first()) == (5, 1.5, 2.5)


def test_logs(spark, tmp_path):
    (tmp_path / "r").write_text("TASK: cat=Term q=body:fox s=null hits=120+\n  3.5 msec\nTASK: cat=Or q=a b s=<x> hits=7 2.25 msec thread 3\n")
    a, b = readers.result_log(spark, f"{tmp_path}/r").orderBy("category").collect()
    assert (b["category"], b["hit_count"], b["is_lower_bound"]) == ("Term", 120, True) and (a["latency_ms"], a["thread"], a["query"]) == (2.25, 3, "a b")
    (tmp_path / "s").write_text("DWPT 0 [2020-01-02T03:04:05.000000Z; main]: flush postings as segment _1a numDocs=42\nnoise\n")
    r = readers.segment_log(spark, f"{tmp_path}/s").first()
    assert (r["component"], r["event"], r["segment"], r["docs"], r["thread"]) == ("DWPT", "flush", "_1a", 42, "main")


def test_pages_and_shapes(spark, tmp_path):
    page = "<page><title>{}</title><revision><timestamp>t</timestamp><contributor><username>u</username></contributor><text>{}</text></revision></page>"
    text = "== Head ==\n[[Category:Cats]] '''A''' [[x|cat]] {{box|{{in}}}} &lt;ref&gt;n&lt;/ref&gt;"
    (tmp_path / "w.xml").write_text("<mediawiki>" + page.format("Cat", text) + page.format("R", "#REDIRECT [[Cat]]") + "</mediawiki>")
    r = readers.wiki_pages(spark, f"{tmp_path}/w.xml").collect()
    assert len(r) == 1 and r[0]["categories"] == "Cats" and r[0]["text"] == "Head A cat" and r[0]["section_count"] == 1 and r[0]["ref_count"] == 1
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.json").write_text(json.dumps({"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 4], [5, 6]]], [[[7, 8], [9, 1], [2, 3]]]]}}))
    (tmp_path / "g/b.json").write_text("no json")
    got = readers.geojson(spark, f"{tmp_path}/g").orderBy("polygon_no").collect()
    assert len(got) == 2 and got[0]["rings"][0][0]["latitude"] == 2.0
    assert struct.calcsize("<iiiiq") == 24
