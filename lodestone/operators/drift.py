"""Schemas that drift between the files of a producer.

The fields of every record are exploded into a catalogue of (suite, file, field, type). Per
producer, field and type, ``lag`` over the file numbers finds the islands of successive files that
have it: the field's lifespans. Beginnings and endings of lifespans are the changes; a lost and a
new field whose values agree over the runs that both files hold are one field renamed. Renames
make an alias table, from which the casts of the one consistent table are generated.

Defined results: payloads that are null or no complete JSON object, and rows without file or
suite, are left out. A file whose payloads are all left out is not there. Repeated rows change
nothing. JSON null shows that a field is there but gives no type. An object that has a key twice
is no complete object. A field with values of several types in a file is retyped when the set of
types differs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import materialise

SCHEMA_NUMBER = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def records(raw: DataFrame) -> DataFrame:
    """suite_id, file_id, file_seq, record_no, run_key, fields (map of variants) of every valid payload."""
    payload = F.btrim(F.col("payload"), F.lit(" \t\r\n"))
    doc = F.when(F.startswith(payload, F.lit("{")) & F.endswith(payload, F.lit("}")), F.try_parse_json(payload))
    return (
        raw.where("file_id is not null and suite_id is not null")
        .select("suite_id", "file_id", F.col("file_seq").cast("long").alias("file_seq"), "record_no", "run_key", doc.alias("v"))
        .select("suite_id", "file_id", "file_seq", "record_no", "run_key", F.try_variant_get("v", "$", "map<string,variant>").alias("fields"))
        .where("fields is not null")
    )


def json_type(v: Column) -> Column:
    """number, string, boolean, array or object; null for JSON null."""
    s = F.schema_of_variant(v)
    number = F.lit(False)
    for name in SCHEMA_NUMBER:
        number = number | F.startswith(s, F.lit(name))
    return (
        F.when(number, "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(F.startswith(s, F.lit("ARRAY")), "array").when(F.startswith(s, F.lit("OBJECT")), "object")
    )


def by_value(v: Column) -> Column:
    """A text that is equal for equal values; numbers by value, however they are written."""
    s = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    as_double = F.try_variant_get(v, "$", "double")
    exact = F.startswith(s, F.lit("BIGINT")) & (F.abs(as_double) >= 2.0**53)
    return F.when((json_type(v) == "number") & ~exact, (as_double + F.lit(0.0)).cast("string")).otherwise(F.coalesce(text, F.to_json(v)))


def catalogue(raw: DataFrame) -> DataFrame:
    """(suite_id, file_id, file_no, field_name, json_type, n): a file's fields and their types.

    ``file_no`` counts the files of a suite that are there. Only sums per file and field leave the
    map side, so a file with a third of all rows is no heavier than another.
    """
    own = records(raw)
    flat = own.select("suite_id", "file_id", "file_seq", F.explode_outer("fields").alias("field_name", "v"))
    sums = flat.groupBy("suite_id", "file_id", "file_seq", "field_name", json_type(F.col("v")).alias("json_type")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("suite_id").orderBy("file_seq", "file_id")
    return sums.withColumn("file_no", F.dense_rank().over(order)).drop("file_seq")


def _read(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue and the log of changes, each worked out once and kept: rows by file and field, not by record."""
    cat = materialise(catalogue(raw))
    return cat, materialise(_log(cat))


def _fields(cat: DataFrame) -> DataFrame:
    return cat.where("field_name is not null").groupBy("suite_id", "file_id", "file_no", "field_name").agg(F.array_sort(F.collect_set("json_type")).alias("types"))


def _files(cat: DataFrame) -> DataFrame:
    files = cat.select("suite_id", "file_id", "file_no").distinct()
    w = Window.partitionBy("suite_id").orderBy("file_no")
    return files.withColumn("last_no", F.max("file_no").over(Window.partitionBy("suite_id"))).withColumn("before", F.lag("file_id").over(w))


def spans(cat: DataFrame) -> DataFrame:
    """Islands of successive files, by suite, field and type set: first_no, last_no."""
    w = Window.partitionBy("suite_id", "field_name").orderBy("file_no")
    begins = F.coalesce((F.lag("file_no").over(w) != F.col("file_no") - 1) | (F.lag("types").over(w) != F.col("types")), F.lit(True))
    return (
        _fields(cat).withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("suite_id", "field_name", "island").agg(F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no"), F.first("types").alias("types"))
        .drop("island")
    )


def lifespans(raw: DataFrame) -> DataFrame:
    """The catalogue of lifespans with the files in which each begins and ends."""
    cat = materialise(catalogue(raw))
    files = _files(cat)
    first = files.select("suite_id", F.col("file_no").alias("first_no"), F.col("file_id").alias("first_file"))
    last = files.select("suite_id", F.col("file_no").alias("last_no"), F.col("file_id").alias("last_file"))
    out = spans(cat).join(first, ["suite_id", "first_no"]).join(last, ["suite_id", "last_no"])
    return out.select("suite_id", "field_name", F.array_join("types", "|").alias("json_types"), "first_file", "last_file", (F.col("last_no") - F.col("first_no") + 1).alias("files"))


def _log(cat: DataFrame) -> DataFrame:
    """Beginnings and endings of lifespans: (suite_id, file_no, field_name, what) with what in added, removed, retyped."""
    w = Window.partitionBy("suite_id", "field_name").orderBy("first_no")
    s = spans(cat)
    s = s.withColumn("came", F.lag("last_no").over(w)).withColumn("came_types", F.lag("types").over(w)).withColumn("goes", F.lead("first_no").over(w))
    s = s.join(cat.groupBy("suite_id").agg(F.max("file_no").alias("newest")), "suite_id")
    follows = F.coalesce(F.col("came") == F.col("first_no") - 1, F.lit(False))
    followed = F.coalesce(F.col("goes") == F.col("last_no") + 1, F.lit(False))
    start = F.when(~follows, F.when(F.col("first_no") > 1, "added")).when((F.size("types") > 0) & (F.size("came_types") > 0), "retyped")
    events = F.array(
        F.struct(F.col("first_no").alias("file_no"), start.alias("what")),
        F.struct((F.col("last_no") + 1).alias("file_no"), F.when(~followed & (F.col("last_no") < F.col("newest")), "removed").alias("what")),
    )
    log = s.select("suite_id", "field_name", F.explode(events).alias("e")).select("suite_id", "field_name", "e.file_no", "e.what").where("what is not null")
    files = _files(cat)
    return log.join(files, ["suite_id", "file_no"]).select("suite_id", "file_no", "file_id", "before", "field_name", "what")


def _renames(raw: DataFrame, log: DataFrame) -> DataFrame:
    """(file_id, lost, new): pairs of fields whose values agree over all shared runs, at least one."""
    ask_new = log.where("what = 'added'").select("file_id", F.col("file_id").alias("at"), F.lit(True).alias("is_new"), "field_name")
    ask_lost = log.where("what = 'removed'").select(F.col("before").alias("file_id"), F.col("file_id").alias("at"), F.lit(False).alias("is_new"), "field_name")
    # one row a file: the fields it is asked for; the records then need no explode before the join
    asked = ask_new.unionByName(ask_lost).groupBy("file_id").agg(F.collect_list(F.struct("at", "is_new", "field_name")).alias("asked"))
    told = records(raw).where("run_key is not null").join(asked, "file_id").select("run_key", "fields", F.explode("asked").alias("a"))
    v = F.try_element_at("fields", F.col("a.field_name"))
    told = told.select("a.at", "a.is_new", "a.field_name", "run_key", json_type(v).alias("t"), by_value(v).alias("val")).where("t is not null")
    # several records of one run in a file agree or not among themselves; one row a run and value
    told = told.groupBy("at", "is_new", "field_name", "run_key").agg(F.count_distinct("t", "val").alias("versions"), F.first(F.struct("t", "val")).alias("is"))
    told = materialise(told)  # both sides start from it; the payloads are parsed once for it
    lost = told.where("not is_new").select("at", "run_key", F.col("field_name").alias("lost"), F.col("versions").alias("v1"), F.col("is").alias("x"))
    new = told.where("is_new").select("at", "run_key", F.col("field_name").alias("new"), F.col("versions").alias("v2"), F.col("is").alias("y"))
    same = (F.col("x") == F.col("y")) & (F.col("v1") == 1) & (F.col("v2") == 1)
    pairs = lost.join(new, ["at", "run_key"]).groupBy("at", "lost", "new").agg(F.min(same.cast("int")).alias("same"), F.count_distinct("x.t").alias("kinds"))
    return pairs.where("same = 1 and kinds = 1").select(F.col("at").alias("file_id"), "lost", "new")


def changes(raw: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind): added, removed, renamed (under the new name), retyped."""
    _, log = _read(raw)
    renamed = materialise(_renames(raw, log))
    gone = renamed.select("file_id", F.col("lost").alias("field_name"), F.lit("removed").alias("what"))
    come = renamed.select("file_id", F.col("new").alias("field_name"), F.lit("added").alias("what"))
    rest = log.select("file_id", "field_name", "what").join(gone.unionByName(come).distinct(), ["file_id", "field_name", "what"], "left_anti")
    out = rest.unionByName(renamed.select("file_id", F.col("new").alias("field_name"), F.lit("renamed").alias("what")).distinct())
    return out.select("file_id", "field_name", F.col("what").alias("change_kind"))


NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?"
#: The texts that say a number: plain or about, alone in an array; and those with the unit ms.
SAYS_NUMBER = rf"^\s*~?\s*({NUMBER})\s*$|^\[({NUMBER})\]$"
SAYS_MS = rf'^\s*~?\s*({NUMBER})\s*ms\s*$|^\{{"unit":"ms","value":({NUMBER})\}}$'
#: A name that ends in another unit contradicts ms.
OTHER_UNIT = re.compile(r"(?:^|[^a-z])(?:s|secs?|seconds?|us|ns|min|bytes|kb|mb|gb)$|[a-z](?:Sec|Mb|Gb|Kb)$", re.I)


def as_text(v: Column) -> Column:
    """The text of any value but JSON null; arrays and objects as JSON."""
    return F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def as_number(v: Column, units: bool) -> Column:
    """The finite double that a value says, null if it says none; whole numbers only where a double is exact."""
    text, double = as_text(v), F.try_variant_get(v, "$", "double")
    said = [F.nullif(F.regexp_extract(text, form, i), F.lit("")) for form in (SAYS_NUMBER, SAYS_MS)[: 1 + units] for i in (1, 2)]
    exact = ~F.startswith(F.schema_of_variant(v), F.lit("BIGINT")) | (F.abs(double) < 2.0**53)
    out = F.when(json_type(v) == "number", F.when(exact, double)).when(json_type(v) != "boolean", F.coalesce(*said).try_cast("double"))
    return F.when(F.abs(out) < float("inf"), out)


def _casts(raw: DataFrame) -> DataFrame:
    """By field_name over all its values: bad (no number), bad_ms (none with the unit ms either), other (not written as a JSON number)."""
    flat = records(raw).select(F.explode("fields").alias("field_name", "v")).where(~F.is_variant_null("v"))
    count = lambda c: F.sum(c.cast("long"))
    return flat.groupBy("field_name").agg(
        count(as_number(F.col("v"), False).isNull()).alias("bad"), count(as_number(F.col("v"), True).isNull()).alias("bad_ms"),
        count(F.coalesce(json_type(F.col("v")) != "number", F.lit(True))).alias("other"))


#: Names that a group of aliases goes by if it holds one of them.
PREFERRED = ("net_cpu_ms", "avg_cpu_core_count")
#: Field names are metadata; a catalogue with more distinct names than this is refused.
MAX_NAMES = 20_000


def aliases(raw: DataFrame) -> list[dict]:
    """The alias table: canonical, kind (double, boolean or string), units, raw and names, newest first.

    Names that ever stand in one file together are different fields and never merged. A group with
    numbers is double only if every value of all its rows says a number; ``units`` tells that ms may
    follow it, ``raw`` that some value is written otherwise than as a JSON number.
    """
    cat, log = _read(raw)
    named = cat.where("field_name is not null").groupBy("field_name").agg(
        F.max("file_no").alias("newest"), F.sum("n").alias("n"), F.array_sort(F.collect_set("json_type")).alias("types"))
    names = {r["field_name"]: r for r in named.limit(MAX_NAMES + 1).collect()}
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names")
    casts = {r["field_name"]: r for r in _casts(raw).collect()}
    edges = _renames(raw, log).groupBy("lost", "new").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "lost", "new").collect()
    # which names of one family of aliases ever stand in one file together; families are small
    family: dict[str, str] = {}

    def head(x: str) -> str:
        while family.setdefault(x, x) != x:
            x = family[x]
        return x

    for e in edges:
        family[head(e["new"])] = head(e["lost"])
    kin = raw.sparkSession.createDataFrame([(x, head(x)) for x in sorted(family)], "field_name string, family string")
    met = cat.select("file_id", "field_name").distinct().join(kin, "field_name").groupBy("file_id", "family").agg(F.array_sort(F.collect_set("field_name")).alias("f"))
    met = met.where(F.size("f") > 1).select("f").distinct().select(F.explode("f").alias("a"), "f").select("a", F.explode("f").alias("b")).where("a < b").distinct()
    apart = {frozenset((r["a"], r["b"])) for r in met.collect()}
    group = {n: {n} for n in names}
    for e in edges:
        a, b = group[e["lost"]], group[e["new"]]
        if a is not b and not any(frozenset((x, y)) in apart for x in a for y in b):
            a |= b
            for x in b:
                group[x] = a
    out, seen = [], set()
    for n in sorted(names):
        if n in seen:
            continue
        members = sorted(group[n], key=lambda x: (-names[x]["newest"], -names[x]["n"], x))
        seen |= set(members)
        canonical = next((p for p in PREFERRED if p in members), members[0])
        types = {t for m in members for t in names[m]["types"]}
        units = not any(OTHER_UNIT.search(m) for m in members)
        told = [casts[m] for m in members if m in casts]
        kind = "boolean" if types == {"boolean"} else "double" if "number" in types and not any(c["bad_ms" if units else "bad"] for c in told) else "string"
        out.append({"canonical": canonical, "kind": kind, "units": units, "raw": kind == "double" and any(c["other"] for c in told), "names": members})
    return sorted(out, key=lambda x: x["canonical"])


def one_table(raw: DataFrame) -> DataFrame:
    """All valid records once, under canonical names and types; no value but JSON null becomes null.

    A double column with values that are written otherwise (``'~1.5'``, ``'3 ms'``, ``[7]``) has
    their texts beside it, in a column whose name ends in ``_raw``. Names that differ only in case,
    or clash with the key columns, get a number at their end.
    """
    plan = aliases(raw)
    keys = ["suite_id", "file_id", "record_no", "run_key"]
    taken = set(keys)

    def free(wanted: str) -> str:
        name, n = wanted, 1
        while name.lower() in taken:
            n += 1
            name = f"{wanted}_{n}"
        taken.add(name.lower())
        return name

    names = [free(a["canonical"]) for a in plan]
    variants, columns = [], []
    for i, (a, name) in enumerate(zip(plan, names)):
        values = [F.try_element_at("fields", F.lit(x)) for x in a["names"]]
        variants.append(F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in values]).alias(f"v{i}"))
        v = F.col(f"v{i}")
        if a["kind"] == "double":
            columns.append(as_number(v, a["units"]).alias(name))
        else:
            columns.append(as_text(v).try_cast(a["kind"]).alias(name))
        if a["raw"]:
            columns.append(as_text(v).alias(free(f"{a['canonical']}_raw")))
    once = records(raw.where("record_no is not null").dropDuplicates(["file_id", "record_no"]))
    return once.select(*keys, *variants).select(*keys, *columns)
