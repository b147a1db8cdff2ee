"""The conflict fold of histories of any length: cut into pieces in order, each of which becomes a map
from the state before it to the state after it, and the maps are applied in order.

A fact is weighed against the source of the fact before it, so within a piece all decisions but the
first fact's are known without the state: some facts would replace another value ("takers"), some
would be queued. What is not known is the value before, and of that only how it compares with the
piece's first takers and first queued facts matters. So a piece is its first fact and a dozen others
at most, found with windows and partial aggregates; nothing gathers a history in a row or a task.

`norm` has to be a function of `value`, as `merge.compared` is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import conflict

KEY = ["node_id", "attribute"]
_BY = ["confidence", "source_file", "source_record_id"]
_ORDER = ["seq", "value", "norm", *_BY]
STATE = f"struct<value:string,norm:string,confidence:string,source_file:string,source_record_id:string,open:{conflict.OPEN}>"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _weighed(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """Facts by piece, with what would become of each but its piece's first."""
    rows = facts.repartitionByRange(*([] if parts is None else [parts]), *KEY, *_ORDER).withColumn("piece", F.spark_partition_id())
    if parts is not None:
        rows = rows.repartition(parts, "node_id", "piece")  # else the session's number of tasks shares all pieces
    w = W.partitionBy(*KEY, "piece").orderBy(*_ORDER)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    last = lambda cond, *c: F.last(F.when(cond, F.struct(*c)), ignorenulls=True).over(before)
    first = lambda cond, *c: F.first(F.when(cond, F.struct(*c)), ignorenulls=True).over(before)
    rows = rows.withColumn("by", F.lag(F.struct(*_BY)).over(w))
    other = F.when(F.col("norm").isNull(), F.lit("")).alias("norm")  # any norm that is not this one's
    rows = rows.withColumn("d", conflict.decide(F.struct(other, "by.*"), F.struct("norm", *_BY)))
    known = F.col("by").isNotNull()
    rows = rows.withColumns({"taker": known & F.col("d.winner").eqNullSafe("incoming"), "tied": known & F.col("d.winner").isNull()})
    rows = rows.withColumn("taken", last(F.col("taker"), "norm"))
    differs = lambda c: F.col(c).isNotNull() & ~F.col(f"{c}.norm").eqNullSafe(F.col("norm"))
    rows = rows.withColumn("start", F.col("taker") & (F.col("taken").isNull() | differs("taken")))
    rows = rows.withColumns({"islands": F.count_if("start").over(before), "now": last(F.col("start"), "value"), "open": F.col("tied") & F.col("taken").isNull(), "queued": F.col("tied") & differs("taken")})
    event = F.struct(*_ORDER[1:], "by", F.col("d.verdict").alias("verdict"), F.col("d.reason").alias("reason"), "now", "islands")
    rows = rows.withColumn("event", F.when(F.col("tied"), event))
    rows = rows.withColumns({"open_first": first(F.col("open"), "norm"), "open_last": F.last(F.when(F.col("open"), F.col("event")), ignorenulls=True).over(before)})
    return rows.withColumns({"open_other": F.col("open") & differs("open_first"), "open_turn": F.col("open") & differs("open_last")})


def maps(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each key and piece: the map that the piece is."""
    at = F.struct(*_ORDER)
    low = lambda cond, x: F.min_by(F.when(cond, x), F.when(cond, at))
    high = lambda cond, x: F.max_by(F.when(cond, x), F.when(cond, at))
    c, taken = F.col, F.struct("value", "norm")
    return _weighed(facts, parts).groupBy(*KEY, "piece").agg(
        F.count("*").alias("n"), F.min_by(F.struct(*_ORDER[1:]), at).alias("head"), F.max_by(F.struct(*_BY), at).alias("tail"),
        low(c("taker"), taken).alias("taker"), high(c("taker"), F.struct("norm")).alias("norm"), high(c("start"), taken).alias("start"), F.count_if("start").alias("starts"),
        low(c("open"), c("event")).alias("open_first"), low(c("open_other"), c("event")).alias("open_second"),
        high(c("open"), c("event")).alias("open_last"), high(c("open_turn"), c("open_last")).alias("open_before"),
        low(c("queued"), c("event")).alias("queued_first"), high(c("queued"), c("event")).alias("queued_last"),
    )


def _applied(s: Column, p: Column) -> Column:
    """The state after a piece's rest, from the state after its first fact."""
    side = lambda value, by: F.struct(value.alias("value"), *[by[b].alias(b) for b in _BY])
    unlike = lambda x: x.isNotNull() & ~x["norm"].eqNullSafe(s["norm"])
    takes = p["taker"].isNotNull()
    island = F.when(p["taker"]["norm"].eqNullSafe(s["norm"]), s["value"]).otherwise(p["taker"]["value"])
    value = F.when(~takes, s["value"]).when(p["starts"] == 1, island).otherwise(p["start"]["value"])
    norm = F.when(takes, p["norm"]["norm"]).otherwise(s["norm"])
    a, b, q = p["open_first"], p["open_second"], p["queued_first"]
    existing = F.when(unlike(a), side(s["value"], a["by"])).when(unlike(b), side(s["value"], b["by"]))
    existing = existing.when(q.isNotNull(), side(F.when(q["islands"] == 1, island).otherwise(q["now"]["value"]), q["by"]))
    late = F.when(p["queued_last"].isNotNull(), p["queued_last"]).when(unlike(p["open_last"]), p["open_last"]).when(unlike(p["open_before"]), p["open_before"])

    def opened(e: Column) -> Column:
        new = F.struct(F.coalesce(s["open"]["existing"], existing).alias("existing"), side(e["value"], e).alias("incoming"), e["verdict"].alias("verdict"), e["reason"].alias("reason"))
        return F.when(e.isNotNull(), new).otherwise(s["open"])

    return F.struct(value.alias("value"), norm.alias("norm"), *[p["tail"][b].alias(b) for b in _BY], _let(late, opened).alias("open")).cast(STATE)


def fold(facts: DataFrame, state: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """What `conflict.fold` gives in its mode "reference". A key's pieces are as many as the range
    partitions (`parts`, if given) that it fills."""
    own = {"confidence": F.coalesce("confidence", F.lit("exact")), **{c: F.coalesce(c, F.lit(conflict.UNATTRIBUTED)) for c in _BY[1:]}}
    made = maps(facts.select(*KEY, *_ORDER).withColumns(own), parts)
    fields = [c for c in made.columns if c not in KEY]
    rows = made.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"), F.sum("n").alias("n"))
    start, before = F.lit(None).cast(STATE), F.lit(0).cast("long")
    if state is not None:
        held = F.struct("value", "norm", *_BY, "open").cast(STATE)
        rows = rows.join(state.select(*KEY, held.alias("held"), F.col("n_facts").alias("n_held")), KEY, "left")
        start, before = F.col("held"), F.coalesce("n_held", before)

    def step(s: Column, p: Column) -> Column:
        head = F.when(s.isNull(), conflict.fresh(p["head"]).cast(STATE)).otherwise(conflict.step(s, p["head"]).cast(STATE))
        return _let(head, lambda x: _applied(x, p))

    folded = rows.withColumn("s", F.aggregate("pieces", start, step))
    return folded.select(*KEY, "s.*", (F.col("n") + before).cast("long").alias("n_facts"))
