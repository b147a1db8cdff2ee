"""Exact quantiles of columns of any size: the ranks that are asked for are narrowed down by counting,
never by gathering values.

Each round splits the range in which a rank lies into BINS, counts its values (partial counts before
any shuffle) and goes on in the one bin that holds the rank, between the least and the greatest value
that was seen in it. A range of one value is that value; one of at most FEW rows is ranked outright.
Ranges shrink four-thousandfold a round where values are spread, and by a value at least where not.

Null and NaN values are left out; infinite ones count as the greatest and least finite numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import cut

BINS, FEW = 4096, 50_000
_MOST = 1.7976931348623157e308


def order_statistics(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(g, rank, x): the values of rows (g, x) that stand at the ranks (g, rank), which count from 1 to
    the number of g's rows. g is any column that compares, such as a struct."""
    rows = rows.where("x is not null and not isnan(x)").select("g", F.greatest(F.least("x", F.lit(_MOST)), F.lit(-_MOST)).alias("x"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    todo = cut(ranks.join(sizes, "g").where("rank between 1 and n").select("g", "rank", "lo", "hi", "n", F.lit(0).cast("long").alias("before")))
    done = []
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("n") > FEW)
        done.append(todo.where(~wide))
        todo = todo.where(wide)
        if not todo.limit(1).count():
            break
        ranges = todo.select("g", "lo", "hi").distinct()
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, so that no range overflows
        # the last bin is that of the greatest value alone, so that every round narrows the range
        bin_ = F.when(F.col("x") == F.col("hi"), BINS).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        inside = rows.join(ranges, "g").where("x between lo and hi")
        bins = inside.groupBy("g", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("k"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = F.sum("k").over(W.partitionBy("g", "lo", "hi").orderBy("bin"))  # BINS rows a range
        bins = bins.withColumn("upto", upto)
        hit = (F.col("rank") - F.col("before") <= F.col("upto")) & (F.col("rank") - F.col("before") > F.col("upto") - F.col("k"))
        todo = todo.join(bins, ["g", "lo", "hi"]).where(hit).select("g", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("k").alias("n"), (F.col("before") + F.col("upto") - F.col("k")).alias("before"))
        todo = cut(todo)
    found = cut(_union(done))
    flat = found.where("lo = hi").select("g", "rank", F.col("lo").alias("x"))
    open_ = found.where("lo < hi")
    place = F.row_number().over(W.partitionBy("g", "lo", "hi").orderBy("x"))  # FEW rows a range
    some = rows.join(open_.select("g", "lo", "hi").distinct(), "g").where("x between lo and hi").withColumn("place", place)
    return flat.unionByName(some.join(open_.select("g", "lo", "hi", "rank", "before"), ["g", "lo", "hi"]).where("place = rank - before").select("g", "rank", "x"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def quantiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None, exclusive: bool = False) -> DataFrame:
    """(by..., q, value): quantiles by linear interpolation between neighbours, at position
    1 + (n - 1) q, or (n + 1) q with `exclusive` (which goes beyond the outermost pair of values where
    that position does). A group without values has no row; of one value each quantile is that value."""
    if not at or not all(0 <= q <= 1 for q in at):
        raise ValueError("quantiles are from 0 to 1")
    by = by or []
    rows = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).cast("double").alias("x"))
    n = rows.where("x is not null and not isnan(x)").groupBy("g").agg(F.count("*").alias("n"))
    asked = n.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    place = (F.col("n") + 1) * F.col("q") if exclusive else 1 + (F.col("n") - 1) * F.col("q")
    low = F.greatest(F.least(F.floor(place), F.col("n") - 1), F.lit(1)).cast("long")
    asked = asked.withColumns({"low": low, "part": F.when(F.col("n") > 1, place - low).otherwise(0.0)})
    asked = cut(asked.withColumn("high", F.least(F.col("low") + 1, "n")))
    ranks = asked.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    x = cut(order_statistics(rows, ranks))
    a, b = x.select("g", F.col("rank").alias("low"), F.col("x").alias("a")), x.select("g", F.col("rank").alias("high"), F.col("x").alias("b"))
    out = asked.join(a, ["g", "low"]).join(b, ["g", "high"])
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], "q", (F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("value"))
