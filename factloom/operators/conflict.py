"""Resolution of disagreeing facts: an ordered fold over each (node, attribute).

A facts table has node_id, attribute, seq (a total order), value (JSON text), norm (the form that
is compared), confidence, source_file and source_record_id. Losing facts count as provenance
too: the confidence and source a value is defended with are those of the fact before, whichever
side won then. ``mode="owner"`` defends it with the fact that supplied it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.registry import HUMAN_EDITS, METHODS, RUNGS, UNATTRIBUTED
from factloom.session import cut

#: Facts of one key up to which they are folded in one row, and so many longer histories are broadcast at most.
HOT_FACTS, BROADCAST_KEYS = 10_000, 100_000
#: Facts of one task, at most, where the session has fewer tasks: they are sorted in memory.
TASK_FACTS = 100_000

SIDE = "struct<value:string,confidence:string,source_file:string,source_record_id:string>"
DECISION = "struct<verdict:string,winner:string,reason:string>"
OPEN = f"struct<existing:{SIDE},incoming:{SIDE},verdict:string,reason:string>"


def rung(confidence: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RUNGS.items() for x in kv]), confidence)


def decide(e: Column, i: Column) -> Column:
    """struct(verdict, winner, reason) for two sides with norm, confidence, source_file and
    source_record_id; winner is null where a person or a model has to decide."""
    out = lambda v, w, r: F.struct(F.lit(v).alias("verdict"), F.lit(w).cast("string").alias("winner"), F.lit(r).alias("reason"))
    human = lambda s: s["confidence"] == "human"
    same = (e["source_file"] == i["source_file"]) & (e["source_record_id"] == i["source_record_id"]) & (e["source_file"] != UNATTRIBUTED)
    return (
        F.when(e["norm"].eqNullSafe(i["norm"]), out("auto_merge", "existing", "equal_after_normalize"))
        .when(same, out("auto_pick", "incoming", "same_source_updated"))
        .when(human(e) & ~human(i), out("auto_pick", "existing", "human_overrides"))
        .when(human(i) & ~human(e), out("auto_pick", "incoming", "human_overrides"))
        .when(rung(e["confidence"]) > rung(i["confidence"]), out("auto_pick", "existing", "higher_confidence_wins"))
        .when(rung(i["confidence"]) > rung(e["confidence"]), out("auto_pick", "incoming", "higher_confidence_wins"))
        .when(e["confidence"] == "inferred", out("llm_triage", None, "both_inferred"))
        .otherwise(out("escalate", None, "tied_at_confident_rung"))
    )


def reconcile(facts: DataFrame, mode: str = "reference") -> DataFrame:
    """Per (node_id, attribute): the stored value, the number of facts, and the open conflict
    (existing and incoming side, verdict, reason; null if none)."""
    return fold(facts, mode=mode).select("node_id", "attribute", "value", "n_facts", "open")


def _side(s: Column, value: Column) -> Column:
    return F.struct(value.alias("value"), s["confidence"].alias("confidence"), s["source_file"].alias("source_file"), s["source_record_id"].alias("source_record_id"))


def _state(value: Column, norm: Column, by: Column, open_: Column) -> Column:
    return F.struct(value.alias("value"), norm.alias("norm"), by["confidence"].alias("confidence"), by["source_file"].alias("source_file"), by["source_record_id"].alias("source_record_id"), open_.alias("open"))


def fresh(f: Column) -> Column:
    """The state after a key's first fact."""
    return _state(f["value"], f["norm"], f, F.lit(None).cast(OPEN))


def step(s: Column, f: Column, mode: str = "reference") -> Column:
    """The state after one more fact."""
    d = decide(s, f)
    equal = s["value"].eqNullSafe(f["value"])
    takes = ~equal & d["winner"].eqNullSafe(F.lit("incoming"))
    queued = ~equal & d["winner"].isNull()
    first = F.coalesce(s["open"]["existing"], _side(s, s["value"]))
    open_ = F.when(queued, F.struct(first.alias("existing"), _side(f, f["value"]).alias("incoming"), d["verdict"].alias("verdict"), d["reason"].alias("reason"))).otherwise(s["open"])
    value, norm = F.when(takes, f["value"]).otherwise(s["value"]), F.when(takes, f["norm"]).otherwise(s["norm"])
    if mode == "reference":
        return _state(value, norm, f, open_)
    keep = lambda c: F.when(takes | equal, f[c]).otherwise(s[c]).alias(c)
    return F.struct(value.alias("value"), norm.alias("norm"), keep("confidence"), keep("source_file"), keep("source_record_id"), open_.alias("open"))


def fold(facts: DataFrame, state: DataFrame | None = None, mode: str = "reference") -> DataFrame:
    """The state of every (node_id, attribute) that has facts: value, norm, the confidence and source
    it is defended with, n_facts and the open conflict. With an earlier `state` the facts come after
    its own, which is the same as folding all of them, so history is not read again.

    Keys of more than HOT_FACTS facts, which are counted first, are folded in pieces over many tasks
    (`fold_pieces`), the others as a row each. In mode "owner" every key is a row: what a value is
    defended with then depends on all facts before, and its history has to fit."""
    if mode not in ("reference", "owner"):
        raise ValueError("mode is 'reference' or 'owner'")
    if mode == "owner":
        return _fold_rows(facts, state, mode)
    from factloom.operators import fold_pieces

    key = ["node_id", "attribute"]
    many = F.col("count") > HOT_FACTS
    # a row for each hot key, and one for all others
    counted = cut(facts.groupBy(*key).count().groupBy(many.alias("hot"), *[F.when(many, F.col(c)).alias(c) for c in key]).agg(F.sum("count").alias("n")))
    hot = counted.where("hot").select(*key)
    n = hot.limit(BROADCAST_KEYS + 1).count()
    sizes = {r["hot"]: r["n"] for r in counted.groupBy("hot").agg(F.sum("n").alias("n")).collect()}
    usual = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = {k: -(-v // TASK_FACTS) for k, v in sizes.items() if v > usual * TASK_FACTS}
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    rows = facts.join(hot, key, "left_anti") if n else facts
    folded = _fold_rows(rows.repartition(parts[False], "node_id") if False in parts else rows, state, mode)
    return folded.unionByName(fold_pieces.fold(facts.join(hot, key, "left_semi"), state, parts.get(True))) if n else folded


def _fold_rows(facts: DataFrame, state: DataFrame | None, mode: str) -> DataFrame:
    key = ["node_id", "attribute"]
    fact = F.struct("seq", "value", "norm", F.coalesce("confidence", F.lit("exact")).alias("confidence"), F.coalesce("source_file", F.lit(UNATTRIBUTED)).alias("source_file"), F.coalesce("source_record_id", F.lit(UNATTRIBUTED)).alias("source_record_id"))
    rows = facts.groupBy(*key).agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    begin = fresh(F.col("facts")[0])
    later, before = F.slice("facts", F.lit(2), F.size("facts")), F.lit(0).cast("long")
    if state is not None:
        held = F.struct("value", "norm", "confidence", "source_file", "source_record_id", "open")
        rows = rows.join(state.select(*key, held.alias("held"), F.col("n_facts").alias("n_held")), key, "left")
        known = F.col("held").isNotNull()
        begin, later, before = F.when(known, F.col("held")).otherwise(begin), F.when(known, F.col("facts")).otherwise(later), F.coalesce("n_held", before)
    folded = rows.withColumn("s", F.aggregate(later, begin, lambda s, f: step(s, f, mode)))
    return folded.select(*key, "s.*", (F.size("facts") + before).cast("long").alias("n_facts"))


def queue(reconciled: DataFrame) -> DataFrame:
    """The open conflicts, at most one for each node and attribute."""
    o = reconciled.where("open is not null")
    cols = [F.col(f"open.{s}.{c}").alias(f"{s}_{c}") for s in ("existing", "incoming") for c in ("value", "confidence", "source_file", "source_record_id")]
    return o.select("node_id", "attribute", *cols, F.col("open.verdict").alias("verdict"), F.col("open.reason").alias("reason"), F.lit("open").alias("status"))


def conflicts(q: DataFrame, status: str = "open", node_id: str | None = None, attribute: str | None = None) -> DataFrame:
    q = q.where(F.col("status") == status)
    if node_id is not None:
        q = q.where(F.col("node_id") == node_id)
    return q.where(F.col("attribute") == attribute) if attribute is not None else q


def latest_facts(facts: DataFrame) -> DataFrame:
    """The last fact of each (node, attribute)."""
    last = F.max(F.struct("seq", "value", "confidence", "source_file", "source_record_id")).alias("m")
    return facts.groupBy("node_id", "attribute").agg(last).select("node_id", "attribute", F.col("m.seq").alias("seq"), F.col("m.value").alias("value"), F.col("m.confidence").alias("confidence"), F.col("m.source_file").alias("source_file"))


def edit(attributes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Human edits (edit_id, node_id, attribute, value) over stored values (node_id, attribute,
    value): the new values, one HUMAN provenance row each, and the synthetic raw records."""
    last = edits.groupBy("node_id", "attribute").agg(F.max_by("value", "edit_id").alias("new"))
    values = attributes.join(last, ["node_id", "attribute"], "full_outer").select("node_id", "attribute", F.coalesce("new", "value").alias("value"), F.col("new").isNotNull().alias("edited"))
    provenance = edits.select("node_id", "attribute", F.col("value").alias("raw_value"), F.lit("human").alias("confidence"), F.lit("human").alias("extraction_method"), F.lit(HUMAN_EDITS).alias("source_file"), F.col("edit_id").cast("string").alias("source_record_id"), F.col("attribute").alias("source_field"))
    records = edits.groupBy("edit_id", "node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "value")))).alias("m")).select(F.lit(HUMAN_EDITS).alias("source_file"), F.col("edit_id").cast("string").alias("source_record_id"), F.to_json("m").alias("raw_record"))
    return values, provenance, records


def resolve(q: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conflicts closed by decisions (node_id, attribute, value): the new queue, and the edits to apply."""
    d = decisions.select("node_id", "attribute", F.col("value").alias("resolution"))
    out = q.join(d, ["node_id", "attribute"], "left").withColumn("status", F.when(F.col("resolution").isNotNull() & (F.col("status") == "open"), F.lit("resolved")).otherwise(F.col("status")))
    edits = decisions.join(q.where("status = 'open'").select("node_id", "attribute"), ["node_id", "attribute"], "left_semi")
    return out, edits


def unknown_decisions(q: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions without a conflict (KeyError for one) or on one that is closed (ValueError)."""
    s = q.select("node_id", "attribute", "status")
    return decisions.join(s, ["node_id", "attribute"], "left").where("status is null or status <> 'open'").withColumn("problem", F.when(F.col("status").isNull(), F.lit("unknown")).otherwise(F.lit("closed")))


def attach(nodes: DataFrame, provenance: DataFrame) -> DataFrame:
    """Nodes with their provenance: source files in order and the number of facts."""
    p = provenance.groupBy("node_id").agg(F.sort_array(F.collect_set("source_file")).alias("source_files"), F.count(F.lit(1)).alias("n_provenance"))
    return nodes.join(p, nodes["id"] == p["node_id"], "left").drop("node_id").withColumn("n_provenance", F.coalesce("n_provenance", F.lit(0)))


def shown_provenance(provenance: DataFrame) -> DataFrame:
    """One row for each (node, file, field, value): the last, at the first one's place."""
    key = ["node_id", "source_file", "source_field", "raw_value"]
    return provenance.groupBy(*key).agg(F.min("seq").alias("place"), F.max_by("confidence", "seq").alias("confidence"), F.max("seq").alias("seq"))


def citations(provenance: DataFrame) -> DataFrame:
    """The first row of each (file, record, field)."""
    key = ["source_file", "source_record_id", "source_field"]
    first = F.row_number().over(W.partitionBy(*key).orderBy("seq"))
    return provenance.withColumn("_n", first).where("_n = 1").drop("_n")


def cited(provenance: DataFrame) -> DataFrame:
    """What answers may cite: `citations` of rows whose method is one that citations have. Rows of
    another method are an error, as is a missing one."""
    known = F.coalesce(F.col("extraction_method").isin(list(METHODS)), F.lit(False))
    method = F.when(known, F.col("extraction_method")).otherwise(F.raise_error(F.concat(F.lit("no method of citations: "), F.coalesce("extraction_method", F.lit("null")))))
    return citations(provenance.withColumn("extraction_method", method))
