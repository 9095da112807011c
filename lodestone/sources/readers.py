"""Readers for line documents, vectors, rides, places, hierarchies, dumps and logs; and writers for some.

Text formats are read with an explicit schema and split by Spark; binary formats go through
``binaryFile`` and are decoded in Arrow batches, so a binary file is one task's work and should be
written in files of bounded size. Malformed lines give nulls or drop out as each reader says.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import wiki_text

MONTH_FIRST = "dd-MMM-yyyy HH:mm:ss"


def _fields(lines: DataFrame, sep: str, names: list[str]) -> DataFrame:
    parts = F.split("value", sep, -1)
    return lines.select(*[F.nullif(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(names)])


def line_docs(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """Tab-separated documents: title, date, body, optional random label and facet columns.

    A first line that begins with FIELDS_HEADER_INDICATOR (or FIELD_…) names the columns.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").rlike("^FIELDS?_HEADER_INDICATOR")).limit(1).collect()
    names = head[0][0].split("\t")[1:] if head else ["title", "date", "body", "random_label", *(extra or [])]
    names = [n.strip().lower().removeprefix("doc") if n.strip().lower() in ("doctitle", "docdate") else n.strip() for n in names]
    docs = _fields(lines.where(~F.col("value").rlike("^FIELDS?_HEADER_INDICATOR")), "\t", names)
    return docs.withColumn("ts", document_time(F.col("date"))) if "date" in names else docs


def document_time(date: Column) -> Column:
    """dd-MMM-yyyy HH:mm:ss with or without milliseconds; null for anything else."""
    cased = F.initcap(F.lower(F.replace(date, F.lit("-"), F.lit(" "))))
    form = "dd MMM yyyy HH:mm:ss"
    return F.coalesce(F.try_to_timestamp(cased, F.lit(form + ".SSS")), F.try_to_timestamp(cased, F.lit(form)))


def write_line_docs(docs: DataFrame, path: str) -> None:
    """title, date, body, random_label as tab-separated lines; tabs and breaks inside become spaces."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ")
    docs.select(F.concat_ws("\t", *[clean(c) for c in ("title", "date", "body", "random_label")]).alias("value")).write.text(path)


def encode_block(rows: list[tuple[str, str, str, int, int]]) -> bytes:
    """A block of binary documents: count and bytes, then each document's lengths, second of day, epoch ms and texts."""
    body = b""
    for title, text, label, second, ms in rows:
        parts = [x.encode() for x in (title, text, label)]
        body += struct.pack("<iiiiq", *map(len, parts), second, ms) + b"".join(parts)
    return struct.pack("<ii", len(rows), len(body)) + body


def decode_blocks(data: bytes) -> list[tuple[str, str, str, int, int]]:
    out, at = [], 0
    while at + 8 <= len(data):
        count, size = struct.unpack_from("<ii", data, at)
        at += 8
        end = at + size
        for _ in range(count):
            a, b, c, second, ms = struct.unpack_from("<iiiiq", data, at)
            at += 24
            texts = []
            for n in (a, b, c):
                texts.append(data[at : at + n].decode("utf-8", "replace"))
                at += n
            out.append((*texts, second, ms))
        at = end
    return out


def binary_line_docs(spark: SparkSession, path: str) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                yield pd.DataFrame(decode_blocks(bytes(data)), columns=["title", "body", "random_label", "second_of_day", "epoch_ms"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, "title string, body string, random_label string, second_of_day int, epoch_ms long")


VECTOR_TYPES = {"float32": "<f4", "byte": "<i1", "float16": "<f2"}


def vector_file(spark: SparkSession, path: str, dim: int, kind: str = "float32", start: int = 0) -> DataFrame:
    """(path, ordinal, vector) of header-less little-endian files; a rest shorter than a vector is left out."""
    dtype = np.dtype(VECTOR_TYPES[kind])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                flat = np.frombuffer(bytes(data)[: len(data) // dtype.itemsize * dtype.itemsize], dtype)
                x = flat[: len(flat) // dim * dim].reshape(-1, dim)[start:].astype(np.float32)
                for lo in range(0, len(x), 4096):
                    yield pd.DataFrame({"path": name, "ordinal": np.arange(start + lo, start + min(lo + 4096, len(x))), "vector": list(x[lo : lo + 4096])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, ordinal long, vector array<float>")


def token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, v): lines of a word and its numbers."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.size(parts) > 1).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, 1 << 20), lambda x: x.try_cast("float")).alias("v"))


def points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, lat double, lon double").csv(path)


# The ride columns of either colour and the columns of a place-name line.
RIDE_NUMBERS = ["trip_distance", "pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude", "fare_amount", "surcharge", "mta_tax", "extra", "ehail_fee", "improvement_surcharge", "tip_amount", "tolls_amount", "total_amount"]
PLACE_COLUMNS = ["id", "name", "ascii_name", "alternate_names", "latitude", "longitude", "feature_class", "feature_code", "country", "cc2", "admin1", "admin2", "admin3", "admin4", "population", "elevation", "dem", "timezone", "modified"]


def rides(spark: SparkSession, path: str, headers: dict[str, list[str]], sparse: bool = False) -> DataFrame:
    """Lines ``g:…`` and ``y:…`` of comma-separated rides, each colour under its header.

    Empty cells are null. ``sparse`` keeps the colours' columns apart by a prefix.
    """
    lines = spark.read.text(path)
    out = None
    for mark, names in headers.items():
        prefix = {"g": "green_", "y": "yellow_"}.get(mark, f"{mark}_") if sparse else ""
        own = lines.where(F.startswith("value", F.lit(f"{mark}:"))).withColumn("value", F.substring("value", len(mark) + 2, 1 << 30))
        own = _fields(own, ",", names)
        own = own.select(F.lit(mark).alias("cab_color"), *[(F.col(n).try_cast("double") if n in RIDE_NUMBERS else F.col(n).try_cast("int") if n == "passenger_count" else F.col(n)).alias(prefix + n) for n in names])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_rides(df: DataFrame, names: list[str], path: str) -> None:
    cells = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    df.select(F.concat(F.col("cab_color"), F.lit(":"), F.concat_ws(",", *cells)).alias("value")).write.text(path)


def hierarchy(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Comma-separated levels; rows with any level blank are dropped."""
    out = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    for n in names:
        out = out.where(F.length(n) > 0)
    return out


def place_names(spark: SparkSession, path: str) -> DataFrame:
    raw = _fields(spark.read.text(path), "\t", PLACE_COLUMNS)
    kinds = {"id": "int", "latitude": "double", "longitude": "double", "population": "long", "elevation": "long", "dem": "int"}
    typed = raw.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in PLACE_COLUMNS])
    return typed.withColumn("modified", F.unix_millis(F.try_to_timestamp("modified", F.lit("yyyy-MM-dd"))))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a wiki dump without redirects: title, timestamp, text, username, counts and categories."""
    schema = "title string, redirect string, revision struct<timestamp:string,contributor:struct<username:string>,text:string>"
    raw = spark.read.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").schema(schema).load(path)
    text = F.coalesce(F.col("revision.text"), F.lit(""))
    heads = lambda n: F.regexp_count(text, F.lit(rf"(?m)^={{{n}}}[^=].*?[^=]={{{n}}}\s*$"))
    cats = F.regexp_extract_all(text, F.lit(r"\[\[Category:([^\]|]+)"), F.lit(1))
    plain = wiki_text(text)
    return raw.where(~F.lower(text).rlike(r"^\s*#redirect")).select(
        "title", F.col("revision.timestamp").alias("timestamp"), plain.alias("text"), F.col("revision.contributor.username").alias("username"),
        F.length(plain).alias("character_count"), F.array_join(cats, "|").alias("categories"), F.regexp_count(text, F.lit(r"\[\[(?:File|Image):")).alias("image_count"),
        heads(2).alias("section_count"), heads(3).alias("sub_section_count"), heads(4).alias("sub_sub_section_count"), F.regexp_count(text, F.lit(r"<ref[ >]")).alias("ref_count"))


def combine_pages(titles: DataFrame, bodies: DataFrame) -> DataFrame:
    """Titles with bodies by title, without service pages and disambiguations."""
    service = r"^(?:Category|Template|Portal|Wikipedia|File|Help|Book|MediaWiki):|\(disambiguation\)$"
    return titles.where(~F.col("title").rlike(service)).join(bodies, "title")


def geojson_rings(text: str) -> list[list[list[tuple[float, float]]]]:
    """Polygons of rings of (lat, lon) from GeoJSON geometry, feature or collection."""
    doc = json.loads(text)
    if doc.get("type") == "FeatureCollection":
        return [p for f in doc["features"] for p in geojson_rings(json.dumps(f["geometry"]))]
    if doc.get("type") == "Feature":
        return geojson_rings(json.dumps(doc["geometry"]))
    if doc.get("type") == "GeometryCollection":
        return [p for g in doc["geometries"] for p in geojson_rings(json.dumps(g))]
    turn = lambda rings: [[(y, x) for x, y, *_ in ring] for ring in rings]
    if doc.get("type") == "Polygon":
        return [turn(doc["coordinates"])]
    if doc.get("type") == "MultiPolygon":
        return [turn(p) for p in doc["coordinates"]]
    return []


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(path, polygon_no, rings) of whole GeoJSON files; a file that is none gives no row."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, text in zip(f["path"], f["content"]):
                try:
                    polygons = geojson_rings(bytes(text).decode())
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue
                rows += [(name, i, [[{"latitude": float(y), "longitude": float(x)} for y, x in ring] for ring in p]) for i, p in enumerate(polygons)]
            yield pd.DataFrame(rows, columns=["path", "polygon_no", "rings"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, polygon_no int, rings array<array<struct<latitude:double,longitude:double>>>")


def map_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat, lon) of the nodes of a map dump in XML, by line."""
    line = F.col("value")
    pick = lambda name: F.regexp_extract(line, rf'\b{name}="([^"]*)"', 1)
    return spark.read.text(path).where(line.rlike(r"<node\b")).select(pick("id").try_cast("long").alias("id"), pick("lat").try_cast("double").alias("lat"), pick("lon").try_cast("double").alias("lon")).where("id is not null and lat is not null and lon is not null")


def index_events(spark: SparkSession, path: str) -> DataFrame:
    """``ts op docid [size]`` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].try_cast("double").alias("ts"), parts[1].alias("op"), F.get(parts, 2).try_cast("int").alias("docid"), F.get(parts, 3).try_cast("long").alias("size_bytes")).where("ts is not null")


def result_log(spark: SparkSession, path: str) -> DataFrame:
    """Task results of a search log: category, query, sort, hits (a lower bound with +), latency, thread."""
    v = F.col("value")
    pick = lambda pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
    hits = pick(r"\bhits=(\d+\+?)")
    return spark.read.text(path).where(v.rlike(r"^TASK: cat=")).select(
        pick(r"cat=(\S+)").alias("category"), pick(r" q=(.*?) s=").alias("query"), pick(r" s=(\S+)").alias("sort"), F.regexp_replace(hits, r"\+", "").try_cast("long").alias("hit_count"),
        F.endswith(hits, F.lit("+")).alias("is_lower_bound"), pick(r"\b([\d.]+) msec").try_cast("double").alias("latency_ms"), pick(r"\bthread (\d+)").try_cast("int").alias("thread"))


def segment_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of an index writer's log: component, number, time, thread, event, segment, docs and MB."""
    v = F.col("value")
    pick = lambda pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
    event = F.when(v.contains("flush postings as segment"), "flush").when(v.rlike(r"\bnow merge\b"), "merge start").when(v.rlike(r"\bmerge committed\b|\bcommitMerge\b"), "merge end").when(v.contains("commit: done"), "commit")
    return spark.read.text(path).where(v.rlike(r"^[A-Z]{2,5} \d+ \[")).select(
        pick(r"^([A-Z]+) ").alias("component"), pick(r"^[A-Z]+ (\d+)").try_cast("int").alias("number"), F.try_to_timestamp(pick(r"\[([^;\]]+)"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ts"),
        pick(r"; ([^\]]+)\]").alias("thread"), event.alias("event"), pick(r"\b(_[0-9a-z]+)\b").alias("segment"), pick(r"numDocs=(\d+)").try_cast("long").alias("docs"), pick(r"([\d.]+) MB").try_cast("double").alias("mb"))


def disc_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(disc_id, artist, album, tracks) of whole disc-database files."""
    raw = spark.read.text(path, wholetext=True)
    title = F.regexp_extract("value", r"(?m)^DTITLE=(.*)$", 1)
    parts = F.split(title, " / ", 2)
    return raw.select(F.regexp_extract("value", r"(?m)^DISCID=([0-9a-f]{8})", 1).alias("disc_id"), F.trim(parts[0]).alias("artist"), F.trim(F.get(parts, 1)).alias("album"), F.regexp_extract_all("value", F.lit(r"(?m)^TTITLE\d+=(.*)$"), F.lit(1)).alias("tracks")).where("disc_id != ''")


def normal_name(name: str) -> str:
    """A column's name in lower case, outer space off, other runs of odd characters as one underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def csv_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files with headers of their own spelling and order as one table of texts; what a file lacks is null."""
    out = None
    for path in paths:
        own = spark.read.option("header", True).csv(path)
        own = own.toDF(*[normal_name(c) for c in own.columns])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_vector_records(df: DataFrame, vector: str, order: str, path: str) -> None:
    """Little-endian float32 records in ``order``, as binary values, so that a collection of any size is split."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f4")
            dim = len(x) // max(1, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.reshape(-1, dim)] if dim else [], pa.binary())], names=["value"])

    ranged = df.repartitionByRange(order).sortWithinPartitions(order).select(vector)
    rows = ranged.mapInArrow(work, "value binary").withColumn("part", F.spark_partition_id())
    rows = rows.withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    rows.write.parquet(path)


def vector_records(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(ordinal, vector) of float32 records that ``write_vector_records`` wrote; any number, split as Spark likes."""
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    @F.pandas_udf("array<float>")
    def floats(column: pd.Series) -> pd.Series:
        return column.map(lambda b: np.frombuffer(b, "<f4"))

    return rows.join(before, "part").select((F.col("place") + F.col("before")).alias("ordinal"), floats("value").alias("vector")).where(F.size("vector") == dim)
