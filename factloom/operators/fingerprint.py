"""The leaves of JSON records and their types, in the JVM: VARIANT values expanded level by level within
each record's row, so only (path, tag) pairs are shuffled.

Lists are entered once for each type of element, by the first of that type. A leaf is a value that is no
object or list, or an empty one (`$.a[*]` for an empty list). Its tag is that of the value on its path
when every list is entered at its first element; `null` where there is none. Whole numbers of any size
are `int` up to 64 bits. Records that are no JSON, or have a key twice, have no leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that are expanded at first, and doubled while some record has more.
LEVELS, MOST_LEVELS = 4, 256
#: Patterns of strings that have a tag of their own.
ISO_DATETIME = r"(?U)^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
EMAIL_LIKE = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _type(v: Column) -> Column:
    """str, bool, int, float, null, list or dict."""
    s = F.schema_of_variant(v)
    known = {"STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "VOID": "null"}
    out = F.when(s.startswith("OBJECT"), "dict").when(s.startswith("ARRAY"), "list")
    for k, t in known.items():
        out = out.when(s == k, t)
    return out.otherwise("float")


def _tag(v: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    t = _type(v)
    return F.when(t != "str", t).when(text.rlike(ISO_DATETIME), "iso_datetime").when(text.rlike(EMAIL_LIKE), "email_like").otherwise("str")


def _inner(x: Column) -> Column:
    """What an item (path, v, first) holds, as items."""
    entries = F.map_entries(_object(x["v"]))
    keyed = F.transform(entries, lambda e: F.struct(F.concat(x["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("v"), x["first"].alias("first")))
    values = _list(x["v"])
    kinds = F.transform(values, _type)
    each = F.transform(F.arrays_zip(values.alias("v"), kinds.alias("kind")), lambda y, i: F.struct(y["v"].alias("v"), y["kind"].alias("kind"), i.alias("i")))
    one = F.filter(each, lambda y: F.array_position(kinds, y["kind"]) == y["i"] + 1)
    listed = F.transform(one, lambda y: F.struct(F.concat(x["path"], F.lit("[*]")).alias("path"), y["v"].alias("v"), (x["first"] & (y["i"] == 0)).alias("first")))
    return F.coalesce(keyed, listed)


def _note(x: Column) -> Column:
    """An item's path and tag, and the leaf that it is (null: none)."""
    list_ = _list(x["v"])
    leaf = F.when(F.size(list_) == 0, F.concat(x["path"], F.lit("[*]"))).when(list_.isNull() & (F.coalesce(F.size(_object(x["v"])), F.lit(-1)) <= 0), x["path"])
    return F.struct(x["path"].alias("path"), x["first"].alias("first"), _tag(x["v"]).alias("tag"), leaf.alias("leaf"))


def _expanded(records: DataFrame, levels: int) -> DataFrame:
    """`notes` of all items down to so many levels, and the `items` below them."""
    top = F.struct(F.lit("$").alias("path"), F.try_parse_json("record").alias("v"), F.lit(True).alias("first"))
    d = records.where(F.try_parse_json("record").isNotNull()).select(F.array(top).alias("items"))
    d = d.withColumn("notes", F.transform("items", _note))
    for _ in range(levels):
        d = d.select("notes", F.flatten(F.filter(F.transform("items", _inner), lambda x: x.isNotNull())).alias("items"))
        d = d.select(F.concat("notes", F.transform("items", _note)).alias("notes"), "items")
    return d


def leaf_paths(records: DataFrame) -> DataFrame:
    """(path, tag) of every record's leaves; records: record."""
    levels = LEVELS
    while _expanded(records, levels).agg(F.max(F.size("items"))).first()[0] or 0:
        levels *= 2
        if levels > MOST_LEVELS:
            raise ValueError(f"records are nested in more than {MOST_LEVELS} levels")
    d = _expanded(records, levels)
    chain = F.map_from_entries(F.transform(F.filter("notes", lambda x: x["first"]), lambda x: F.struct(x["path"], x["tag"])))
    paths = F.array_distinct(F.filter(F.col("notes.leaf"), lambda p: p.isNotNull()))
    d = d.select(chain.alias("chain"), F.explode(paths).alias("path"))
    return d.select("path", F.coalesce(F.try_element_at("chain", "path"), F.lit("null")).alias("tag"))


def type_fingerprint(records: DataFrame) -> DataFrame:
    """Per path its one tag, or `mixed`."""
    return leaf_paths(records).groupBy("path").agg(F.when(F.min("tag") == F.max("tag"), F.min("tag")).otherwise(F.lit("mixed")).alias("tag"))
