"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key, -ln(u) / weight, where u is a hash of its id and a seed
and weight its quality. A source whose target exceeds its size first takes whole epochs of all
its documents; the rest is filled by documents in the order of their keys until their sizes,
summed as a prefix, come to the rest of the target (the document at the edge is taken if more
than half of it fits).

The prefix sum never orders a source in one task: sizes are first summed by cells of the key
(log-spaced), then only the cell at a source's edge is divided linearly into finer cells, and
only the documents of one fine cell are ordered exactly. Sums by cell combine before shuffling,
so a source with a third of all rows costs as much as any other.

Defined results: null text has size 0 and takes 0; null sources form one source, last in order;
rows repeated with the same id and weight get the same key and are taken or left together; a
source of size 0 takes 0; a target is its source's, as a double; an empty table gives no rows.
Quality weights that are null, zero, negative or not finite count as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 128  # log-spaced cells for each factor e of the key
FINE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality(text: Column, size: Column) -> Column:
    """A stand-in for a quality score: texts whose words are of ordinary length weigh most."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)) / F.lit(6.0))


def targets(sized: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """One row per source: source_size and target. Sources in code point order (null last) take
    `weights` in turn; `share` times all sizes is dealt by weight, no source above `cap` times
    its size, what is above going to the others by weight."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = W.partitionBy(F.lit(1))
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    # fill as water: sources by most/weight; those below the common level are full
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    per = per.withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    per = per.withColumn("bound", F.col("level") * F.col("weight") <= F.col("most"))
    level = F.min(F.when(F.col("bound"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(every)["level"]
    return per.withColumn("common", level).select(
        "source", "source_size", F.least(F.col("most"), F.coalesce(F.col("common") * F.col("weight"), F.col("most"))).alias("target"))


def _keyed(id_: Column, text: Column, size: Column, weight: Column | None, seed: int) -> Column:
    """The exponential key of a document."""
    w = quality(text, size) if weight is None else weight.cast("double")
    ok = w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < F.lit(float("inf")))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_.cast("string")), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.when(ok, w).otherwise(F.lit(1.0))


_CELL = lambda: F.floor(F.log("k") * CELLS).cast("long")


def _fine() -> Column:
    """The fine cell of a key within the coarse cell c1."""
    low, high = F.exp(F.col("c1") / CELLS), F.exp((F.col("c1") + 1) / CELLS)
    return F.floor((F.col("k") - low) / (high - low) * FINE).cast("long")


def plan(sized: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """One row per source: gs, source_size, target, epochs, and where its last documents are:
    coarse cell c1, fine cell c2 and the greatest key taken in that (null: none)."""
    goal = targets(sized, weights, share, cap)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    small = lambda d: F.broadcast(d) if _few(d) else d

    def edge(cells: DataFrame, budget: DataFrame) -> DataFrame:
        """The cell of each source in which the rest of its target ends, and the sum before it."""
        run = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
        c = cells.withColumn("upto", F.sum("size").over(run))
        j = c.join(budget, same(c, budget)).where((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0)).select(c["source"], "cell", (F.col("upto") - F.col("size")).alias("before"))
        return j.groupBy("source").agg(F.min_by(F.struct("cell", "before"), "cell").alias("e")).select("source", F.col("e.cell").alias("cell"), F.col("e.before").alias("before"))

    rows = sized.withColumn("cell", _CELL())
    coarse = cut(edge(rows.groupBy("source", "cell").agg(F.sum("size").alias("size")), goal))
    c = coarse.select(F.col("source").alias("s1"), F.col("cell").alias("c1"), F.col("before").alias("b1"))
    inside = rows.join(small(c), rows["source"].eqNullSafe(c["s1"]) & (rows["cell"] == c["c1"])).withColumn("cell", _fine()).select("source", "id", "size", "k", "cell")
    budget = goal.join(coarse, same(goal, coarse)).select(goal["source"], (F.col("rest") - F.col("before")).alias("rest"))
    fine = cut(edge(inside.groupBy("source", "cell").agg(F.sum("size").alias("size")), budget))
    f = fine.join(budget, same(fine, budget)).select(fine["source"].alias("s2"), F.col("cell").alias("c2"), (F.col("rest") - F.col("before")).alias("r2"))
    run = W.partitionBy("source").orderBy("k", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    at = inside.join(small(f), inside["source"].eqNullSafe(f["s2"]) & (inside["cell"] == f["c2"])).withColumn("upto", F.sum("size").over(run))
    last = at.where(F.col("upto") - F.col("size") / 2.0 <= F.col("r2")).groupBy("source").agg(F.max("k").alias("most")).withColumnRenamed("source", "s3")
    f = f.drop("r2")
    g = goal.select(F.col("source").alias("gs"), "source_size", "target", "epochs")
    g = g.join(c.drop("b1"), F.col("gs").eqNullSafe(F.col("s1")), "left").join(f, F.col("gs").eqNullSafe(F.col("s2")), "left").join(last, F.col("gs").eqNullSafe(F.col("s3")), "left")
    return cut(g.drop("s1", "s2", "s3"))


def _times() -> Column:
    """How often a row with key k is taken, given its source's plan."""
    taken = (F.when(F.col("c1").isNull() | (_CELL() > F.col("c1")), F.lit(False)).when(_CELL() < F.col("c1"), F.lit(True))
             .when(F.col("c2").isNull() | (_fine() > F.col("c2")), F.lit(False)).when(_fine() < F.col("c2"), F.lit(True)).otherwise(F.coalesce(F.col("k") <= F.col("most"), F.lit(False))))
    return F.col("epochs") + taken.cast("long")


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, seed: int = 17, key: str = "doc_id",
          source: str = "source", text: str = "text", weight: Column | None = None) -> DataFrame:
    """Per row: key, size, source, source_size, target and taken (words, repeats counted)."""
    sized = _sized(docs, seed, key, source, text, weight)
    per = plan(sized, weights, share, cap)
    d = sized.join(F.broadcast(per) if _few(per) else per, sized["source"].eqNullSafe(per["gs"]))
    return d.select(F.col("id").alias(key), "size", "source", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def _sized(docs: DataFrame, seed: int, key: str, source: str, text: str, weight: Column | None) -> DataFrame:
    """A narrow row for each text, so that the texts are read once."""
    size = word_count(F.col(text))
    return cut(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"), _keyed(F.col(key), F.col(text), size, weight, seed).alias("k")))


def mixture(docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, seed: int = 17, key: str = "doc_id",
            source: str = "source", text: str = "text", weight: Column | None = None) -> DataFrame:
    """The rows of the mix with the columns of `docs`: each as often as it is taken. Documents
    without words are taken with the epochs of their source. No text is shuffled."""
    per = plan(_sized(docs, seed, key, source, text, weight), weights, share, cap).select(F.col("gs").alias("_gs"), F.struct("epochs", "c1", "c2", "most").alias("_plan"))
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source).alias("_source"), _keyed(F.col(key), F.col(text), word_count(F.col(text)), weight, seed).alias("k"))
    d = d.join(F.broadcast(per) if _few(per) else per, d["_source"].eqNullSafe(per["_gs"])).select("_row", "k", "_plan.*")
    d = d.withColumn("_n", _times().cast("int")).where("_n > 0")
    return d.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).select("_row.*")


def _few(per_source: DataFrame, most: int = 100_000) -> bool:
    """Whether there are few enough sources to broadcast their rows."""
    return per_source.limit(most + 1).count() <= most
