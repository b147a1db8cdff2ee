"""The graph as versioned Parquet tables: writes make a new version, one pointer names the current.

All tables of a write become visible at once, with a new pointer file of the next number; the
highest whole one counts. A pointer is never overwritten: a failed write leaves the old version
current. Of two writers at once the second takes the first one's tables over into its own pointer,
unless both changed one table; then it fails. `cleaned` removes what no pointer names.

A table is a list of parts. `add` writes one part more, so its cost is that of the new rows; in a
table with a key the latest part's row of each key counts. `delete` adds a part of conditions, which
hold for all earlier parts: a row that equals one of them in its columns is gone, a later one is not.
Every ``PARTS`` parts a table is written as one, without what is gone.

Parts of keyed tables are range-partitioned and sorted by their key, with Bloom filters on it, and the
range of each file is kept beside the part. `touched` opens only files that can hold one of few keys.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import cut

TABLES = (
    "nodes", "edges", "provenance", "source_records", "conflicts", "seen", "dead_letters", "specs", "runs", "extraction_cache", "attributes", "edge_attributes",
    "text_docs", "text_terms", "text_totals", "text_postings", "text_stale", "vec_centroids", "vec_lists", "vec_ids", "vec_stats", "vec_stale", "vectors",
)
#: Tables in which a later row of the same key replaces an earlier one.
KEYS = {"nodes": ["id"], "edges": ["id"], "attributes": ["node_id", "attribute"], "edge_attributes": ["edge_id", "attribute"], "source_records": ["source_file", "source_record_id"], "extraction_cache": ["block", "key"], "text_docs": ["id"], "vec_ids": ["id"], "vectors": ["id", "model"]}
#: Tables without a key whose rows are looked up by a column.
CLUSTERED = {"provenance": ["node_id"]}
#: So many parts a table has at most before it is written as one.
PARTS = 16


#: Keys, at most, that files are chosen by; beyond, a table is read and joined.
FEW_KEYS = 1000
#: Marks a part of conditions in a pointer.
_GONE = "!"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}" if folder else self.root)
        return [str(f.getPath().getName()) for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _pointers(self) -> list[str]:
        """The pointer files, the newest first."""
        return sorted((n for n in self._names("") if n.startswith("CURRENT-")), reverse=True)

    def _pointer(self, name: str) -> dict[str, str] | None:
        """The tables that a pointer names, None if its writer failed."""
        lines = [r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect()]
        return dict(line.split("\t") for line in lines[:-1]) if lines and lines[-1] == "end" else None

    def _current(self) -> dict[str, str]:
        return next((t for t in map(self._pointer, self._pointers()) if t is not None), {})

    def has(self, name: str) -> bool:
        return name in self._current()

    def read(self, name: str) -> DataFrame:
        return self._latest(name, self._current()[name].split(","))

    def touched(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The rows of a keyed table whose keys are in `keys`, None without such a table. Parts are
        filtered before their rows are compared, so only touched rows are shuffled; for few keys,
        only files whose range has one of them are opened."""
        now = self._current()
        return self._latest(name, now[name].split(","), keys.select(*KEYS[name]).distinct()) if name in now else None

    def matching(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of a clustered table that are about `keys`, found as in `touched`."""
        return self._latest(name, self._current()[name].split(","), keys.select(*CLUSTERED[name]).distinct())

    def _ranges(self, name: str, parts: list[str]) -> dict[str, list]:
        """By part its files with the least and greatest first key; a part without ranges is read whole."""
        kept = [f"{p}.ranges" for p in parts if self._fs.exists(self._path(f"{self.root}/{p}.ranges"))]
        out: dict[str, list] = {k.removesuffix(".ranges"): [] for k in kept}
        if kept:
            rows = self.spark.read.parquet(*[f"{self.root}/{k}" for k in kept]).select("part", "file", "low", "high").collect()
            for r in rows:
                out[r["part"]].append((r["file"], r["low"], r["high"]))
        return out

    def _latest(self, name: str, parts: list[str], keys: DataFrame | None = None) -> DataFrame:
        rows, gone = [(k, p) for k, p in enumerate(parts) if not p.startswith(_GONE)], [(k, p[1:]) for k, p in enumerate(parts) if p.startswith(_GONE)]
        only, files = (lambda d: d), {}
        by = KEYS.get(name) or CLUSTERED.get(name)
        if keys is not None:
            first = by[0]
            few = sorted({r[0] for r in keys.select(first).where(F.col(first).isNotNull()).limit(FEW_KEYS + 1).collect()})
            if len(few) <= FEW_KEYS:
                ranges = self._ranges(name, [p for _, p in rows])
                hit = lambda low, high: bisect_left(few, low) < bisect_right(few, high)
                files = {p: [f"{self.root}/{p}/{f}" for f, low, high in r if low is None or hit(low, high)] for p, r in ranges.items()}
                only = lambda d: d.where(F.col(first).isin(few)).join(F.broadcast(keys), by, "left_semi")
            else:
                only = lambda d: d.join(keys, by, "left_semi")
        each = []
        for k, p in rows:
            whole = self.spark.read.schema(self.spark.read.parquet(f"{self.root}/{p}").schema)
            d = whole.parquet(*files[p]) if files.get(p) else whole.parquet(f"{self.root}/{p}")
            each.append((d.limit(0) if p in files and not files[p] else only(d)).withColumn("_part", F.lit(k)))
        union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), each)
        conditions: dict[tuple, DataFrame] = {}
        for k, p in gone:
            d = self.spark.read.parquet(f"{self.root}/{p}").withColumn("_until", F.lit(k))
            cols = tuple(sorted(d.columns))
            conditions[cols] = conditions[cols].unionByName(d) if cols in conditions else d
        for cols, d in conditions.items():
            on = [c for c in cols if c != "_until"]
            d = d.groupBy(*on).agg(F.max("_until").alias("_until")).withColumnsRenamed({c: f"_c_{c}" for c in on})
            match = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_c_{c}") for c in on])
            union = union.join(d, match & (F.col("_part") < F.col("_until")), "left_anti")
        if name not in KEYS or len(rows) == 1:
            return union.drop("_part")
        rest = [c for c in union.columns if c not in (*KEYS[name], "_part")]
        if not rest:
            return union.select(*KEYS[name]).distinct()
        return union.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*rest), "_part").alias("_row")).select(*KEYS[name], "_row.*")

    def write(self, **tables: DataFrame) -> None:
        """Replace several tables at once."""
        self._commit(tables, replace=True)

    def add(self, **tables: DataFrame) -> None:
        """Add rows to several tables at once; those of a keyed table are one for each key."""
        self._commit(tables, replace=False)

    def append(self, name: str, df: DataFrame) -> None:
        self.add(**{name: df})

    def delete(self, **conditions: DataFrame | list[DataFrame]) -> None:
        """Rows of several tables that equal a row of the table's conditions, in its columns, are gone,
        all at once. Tables that are not there are left alone."""
        self._commit({}, replace=False, gone={n: d if isinstance(d, list) else [d] for n, d in conditions.items() if self.has(n)})

    def _written(self, name: str, part: str, df: DataFrame) -> None:
        keys = KEYS.get(name) or CLUSTERED.get(name)
        if not keys:
            df.write.parquet(f"{self.root}/{part}")
            return
        once = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{name}: several rows of one key in a part")))
        if name in KEYS:
            df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(once).drop("_n")
        sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        sorted_.write.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").parquet(f"{self.root}/{part}")
        stored = self.spark.read.parquet(f"{self.root}/{part}").select(keys[0], F.col("_metadata.file_name").alias("file"))
        stored.groupBy("file").agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")).withColumn("part", F.lit(part)).coalesce(1).write.parquet(f"{self.root}/{part}.ranges")

    def _commit(self, tables: dict[str, DataFrame], replace: bool, gone: dict[str, list[DataFrame]] | None = None) -> None:
        gone = gone or {}
        if unknown := (set(tables) | set(gone)) - set(TABLES):
            raise ValueError(f"unknown tables {sorted(unknown)}")
        version = uuid.uuid4().hex
        number = int(next(iter(self._pointers()), "CURRENT-0").split("-")[1]) + 1
        base = self._current()
        now = dict(base)
        for name, df in tables.items():
            new = f"{name}/{version}"
            self._written(name, new, df)
            now[name] = new if replace or name not in now else f"{now[name]},{new}"
        for name, conditions in gone.items():
            for k, df in enumerate(conditions):
                new = f"{name}/{version}-gone{k}"
                df.distinct().write.parquet(f"{self.root}/{new}")
                now[name] += f",{_GONE}{new}"
        for name in {*tables, *gone}:
            parts = now[name].split(",")
            if len(parts) > PARTS:
                whole = f"{name}/{version}-whole"
                self._written(name, whole, self._latest(name, parts))
                now[name] = whole
        self._point(number, now, base, {*tables, *gone})

    def _point(self, number: int, now: dict[str, str], base: dict[str, str], changed: set[str]) -> None:
        """Create the next pointer. If another writer has been faster, its tables are taken over and
        the next number tried; a table that both have changed is an error."""
        text = "".join([*(f"{k}\t{v}\n" for k, v in sorted(now.items())), "end\n"])
        path = self._path(f"{self.root}/CURRENT-{number:012d}")
        if self._fs.exists(path):
            theirs = self._pointer(f"CURRENT-{number:012d}")
            if theirs is not None:
                if both := sorted(t for t in changed if theirs.get(t) != base.get(t)):
                    raise FileExistsError(f"another writer has changed {', '.join(both)}: {path.getName()} exists")
                now, base = theirs | {t: now[t] for t in changed}, theirs
            return self._point(number + 1, now, base, changed)
        try:
            out = self._fs.create(path, False)
        except Exception:
            if self._fs.exists(path):
                return self._point(number, now, base, changed)
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def cleaned(self, keep: int = 1) -> list[str]:
        """Remove the parts that none of the newest `keep` whole pointers names, and the older pointers;
        gives the parts. Not while another writes: its parts have no pointer yet."""
        pointers = self._pointers()
        whole = [p for p in pointers if self._pointer(p) is not None][:keep]
        named = {x.removeprefix(_GONE) for p in whole for parts in self._pointer(p).values() for x in parts.split(",")}
        out = []
        for table in TABLES:
            for part in sorted({n.removesuffix(".ranges") for n in self._names(table)}):
                if f"{table}/{part}" not in named:
                    out.append(f"{table}/{part}")
                    for name in (part, f"{part}.ranges"):
                        self._fs.delete(self._path(f"{self.root}/{table}/{name}"), True)
        for p in pointers:
            if whole and p < whole[-1]:
                self._fs.delete(self._path(f"{self.root}/{p}"), False)
        return out


def delete_stored_nodes(store: Store, ids: DataFrame) -> None:
    """Nodes (id) with the edges at them, the provenance and attributes of both, and their conflicts,
    in one version; raw records stay. A node that is added again has none of its old facts."""
    ids = ids.select("id").distinct()
    node = ids.select(F.col("id").alias("node_id"))
    edges = None
    if store.has("edges"):
        e = store.read("edges").select("id", "src", "dst")
        at = lambda end: e.join(ids.select(F.col("id").alias(end)), end, "left_semi").select("id")
        edges = cut(at("src").union(at("dst")).distinct())
    gone: dict[str, list[DataFrame]] = {"nodes": [ids], "attributes": [node], "provenance": [node], "conflicts": [node]}
    if edges is not None:
        edge = edges.select(F.col("id").alias("edge_id"))
        gone |= {"edges": [edges], "edge_attributes": [edge]}
        gone["provenance"].append(edge)
    store.delete(**gone)


def delete_stored_edges(store: Store, ids: DataFrame) -> None:
    """Edges (id) with their provenance and attributes, in one version."""
    ids = ids.select("id").distinct()
    edge = ids.select(F.col("id").alias("edge_id"))
    store.delete(edges=ids, edge_attributes=edge, provenance=edge)


def raw_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Records by (source_file, source_record_id): new ones are added, known ones replaced only
    where the content hash differs (ingested_at then is the incoming one's)."""
    key = ["source_file", "source_record_id"]
    cols = ["raw_record", "content_hash", "ingested_at"]
    a, b = stored.select(*key, F.struct(*cols).alias("old")), incoming.select(*key, F.struct(*cols).alias("new"))
    j = a.join(b, key, "full_outer")
    keep = F.when(F.col("old").isNull() | (F.col("new").isNotNull() & (F.col("old.content_hash") != F.col("new.content_hash"))), F.col("new")).otherwise(F.col("old"))
    return j.select(*key, keep.alias("r")).select(*key, "r.*")


def merge_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes by id (id, type, created_at, updated_at, version); created_at stays, version counts merges."""
    one = F.when(F.min("type") == F.max("type"), F.min("type")).otherwise(F.raise_error(F.concat(F.lit("one id, two types: "), F.first("id"))))
    i = incoming.groupBy("id").agg(one.alias("t"), F.min("updated_at").alias("c"), F.max("updated_at").alias("u"), F.count(F.lit(1)).alias("k"))
    j = stored.join(i, "id", "full_outer")
    same = F.when(F.col("type").isNull() | F.col("t").isNull() | (F.col("type") == F.col("t")), F.coalesce("type", "t")).otherwise(F.raise_error(F.concat(F.lit("one id, two types: "), F.col("id"))))
    return j.select("id", same.alias("type"), F.coalesce("created_at", "c").alias("created_at"), F.coalesce("u", "updated_at").alias("updated_at"), (F.coalesce("version", F.lit(0)) + F.coalesce("k", F.lit(0))).cast("long").alias("version"))


def merge_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges by id: attributes and valid_to of the last (by seq), valid_from of the first; versions add up."""
    last = F.max_by(F.struct("src", "dst", "relation_type", "attributes", "valid_to"), "seq").alias("l")
    i = incoming.groupBy("id").agg(last, F.min_by("valid_from", "seq").alias("f"), F.count(F.lit(1)).alias("k"))
    j = stored.join(i, "id", "full_outer")
    newest = [F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(c)).alias(c) for c in ("src", "dst", "relation_type", "attributes", "valid_to")]
    return j.select("id", *newest, F.when(F.col("version").isNotNull(), F.col("valid_from")).otherwise(F.col("f")).alias("valid_from"), (F.coalesce("version", F.lit(0)) + F.coalesce("k", F.lit(0))).cast("long").alias("version"))


def delete_nodes(ids: DataFrame, nodes: DataFrame, edges: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the nodes, the edges at them and the provenance of both; raw records stay."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    p = provenance.join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti")
    lost = edges.join(kept.select("id"), "id", "left_anti").select(F.col("id").alias("edge_id"))
    return nodes.join(gone, "id", "left_anti"), kept, p.join(lost, "edge_id", "left_anti")


def delete_edges(ids: DataFrame, edges: DataFrame, provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    return edges.join(gone, "id", "left_anti"), provenance.join(gone.withColumnRenamed("id", "edge_id"), "edge_id", "left_anti")


def patch(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Attribute maps overlaid by (id, attributes) patches without provenance; version + 1."""
    p = patches.select("id", F.col("attributes").alias("_p"))
    over = F.map_zip_with("attributes", "_p", lambda k, a, b: F.coalesce(b, a))
    j = nodes.join(p, "id", "left")
    return j.withColumn("version", F.col("version") + F.col("_p").isNotNull().cast("long")).withColumn("attributes", F.when(F.col("_p").isNull(), F.col("attributes")).otherwise(over)).drop("_p")


def problems(provenance: DataFrame, records: DataFrame) -> DataFrame:
    """Provenance rows that break the rules: both or neither of node and edge, an unknown
    confidence or method, or no raw record."""
    from factloom.registry import METHODS, RUNGS

    key = ["source_file", "source_record_id"]
    known = records.select(*key).distinct().withColumn("_raw", F.lit(True))
    why = F.when(F.col("node_id").isNull() == F.col("edge_id").isNull(), "owner").when(~F.coalesce(F.col("confidence").isin(list(RUNGS)), F.lit(False)), "confidence").when(~F.coalesce(F.col("extraction_method").isin(list(METHODS)), F.lit(False)), "method").when(F.col("_raw").isNull(), "record")
    return provenance.join(known, key, "left").withColumn("problem", why).drop("_raw").where("problem is not null")


def migrated(provenance: DataFrame) -> DataFrame:
    """Legacy rows with a number as confidence: the category by method; a model's number is kept
    as its own score."""
    by = F.element_at(F.create_map(*[F.lit(x) for kv in {"direct_mapping": "exact", "rule_based": "exact", "synthetic": "exact", "human": "human", "llm_extraction": "inferred"}.items() for x in kv]), F.col("extraction_method"))
    checked = F.coalesce(by, F.raise_error(F.concat(F.lit("unknown method "), F.coalesce("extraction_method", F.lit("null")))))
    return provenance.withColumn("model_self_score", F.when(F.col("extraction_method") == "llm_extraction", F.col("confidence").cast("double"))).withColumn("confidence", checked)


def active_specs(specs: DataFrame) -> DataFrame:
    """The highest active version of each tenant and file pattern."""
    a = specs.where("status = 'active'")
    return a.groupBy("tenant", "file_pattern").agg(F.max_by(F.struct(*[c for c in a.columns if c not in ("tenant", "file_pattern")]), "spec_version").alias("s")).select("tenant", "file_pattern", "s.*")


def sole_specs(specs: DataFrame) -> DataFrame:
    """The active spec of each file pattern, where records come without a tenant: a pattern for which
    several tenants have one is an error."""
    a = active_specs(specs)
    one = a.groupBy("file_pattern").agg(F.array_sort(F.collect_set("tenant")).alias("tenants"))
    why = F.concat(F.lit("several tenants have an active spec for "), "file_pattern", F.lit(": "), F.array_join("tenants", ", "))
    sole = F.when(F.size("tenants") == 1, F.get("tenants", 0)).otherwise(F.raise_error(why))
    return a.join(one.select("file_pattern", sole.alias("tenant")), ["file_pattern", "tenant"])
