"""Identities: people who share an address, a phone number, or a name and a place are one, also by way
of others. Groups are connected components, found by contracting stars; links are one for each
person and not for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import edge_id, normalized_email
from factloom.session import cut, discard

#: Digits of a phone number that count, from the end, and how many there must be.
PHONE_DIGITS, LEAST_DIGITS = 10, 7


def keys_of(people: DataFrame, email: str | None = "email", phone: str | None = "phone", named: tuple[str, str] | None = ("name", "place")) -> DataFrame:
    """(id, key) of people: normalised addresses, the last digits of phone numbers, and names (case
    and outer blanks aside) with places. Missing and blank values are no keys; a null id is nobody."""
    text = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    made: list[Column] = []
    if email:
        made.append(F.when(F.contains(F.col(email), F.lit("@")), F.concat(F.lit("email\0"), normalized_email(F.col(email)))))
    if phone:
        digits = F.regexp_replace(F.col(phone).cast("string"), r"\D", "")
        made.append(F.when(F.length(digits) >= LEAST_DIGITS, F.concat(F.lit("phone\0"), F.right(digits, F.lit(PHONE_DIGITS)))))
    if named:
        made.append(F.concat(F.lit("name\0"), text(named[0]), F.lit("\0"), text(named[1])))
    return people.where("id is not null").select("id", F.explode(F.filter(F.array(*made), lambda k: k.isNotNull())).alias("key"))


def components(links: DataFrame) -> DataFrame:
    """(id, least): the least id that each end of links (a, b) is connected with.

    Every round points each vertex at its least neighbour, follows the pointers to their ends by
    doubling, and joins the ends of the links anew: at most half of a component's vertices stay."""
    spark = links.sparkSession
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    left = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        both = left.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("w.a", "w.b")
        to = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("to")))
        kept = to
        while True:
            ends = to.select(F.col("id").alias("to"), F.col("to").alias("end"))
            doubled = cut(to.join(ends, "to").select("id", F.col("to").alias("old"), F.col("end").alias("to")))
            moved = doubled.where("old <> to").limit(1).count()
            discard(kept)
            kept, to = doubled, doubled.drop("old")
            if not moved:
                break
        rounds.append(to)
        new = left.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        left = cut(new.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return spark.createDataFrame([], f"id {links.schema['a'].dataType.simpleString()}, least {links.schema['a'].dataType.simpleString()}")
    out = rounds[0].select("id", F.col("to").alias("least"))
    for to in rounds[1:]:
        out = out.join(to.select(F.col("id").alias("least"), "to"), "least", "left").select("id", F.coalesce("to", "least").alias("least"))
    return out


def groups(keys: DataFrame) -> DataFrame:
    """(id, least, n) of everyone in (id, key): the least id of their group, and how many are in it. A
    key's people are linked with the least of them, so links are no more than rows."""
    keys = cut(keys.distinct())
    first = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    links = keys.join(first, "key").where("id <> a").select("a", F.col("id").alias("b"))
    out = keys.select("id").distinct().join(components(links), "id", "left").select("id", F.coalesce("least", "id").alias("least"))
    return out.join(out.groupBy("least").agg(F.count("*").alias("n")), "least").select("id", "least", "n")


def same_as(grouped: DataFrame) -> DataFrame:
    """The SAME_AS edges of groups (edge_id, a, b): from the least of each to the others."""
    return grouped.where("id <> least").select(edge_id(F.col("least"), F.lit("SAME_AS"), F.col("id")).alias("edge_id"), F.col("least").alias("a"), F.col("id").alias("b"))
