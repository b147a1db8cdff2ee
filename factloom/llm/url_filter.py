"""URL filters by a temporal list join.

A filter list is a table of dated entries (pattern, kind, action, day): kind ``host`` names a
host with all hosts below it, kind ``prefix`` a host and the start of a path; action ``add``
starts an entry, ``remove`` ends it. The entries of a pattern become validity intervals: each
lasts from its day to the next entry of the pattern. Captures get the candidate patterns of
their URL (the host's suffixes, and its path's prefixes of the lengths the list has) and an as-of join picks for
each candidate the entry that was last at the fetch time; a capture is blocked if one of those
entries is an ``add``.

As the intervals of one pattern do not overlap, the as-of join is an equi-join on the pattern
with the time inside the interval: at most one row for each candidate. Lists are broadcast up to
``SMALL`` intervals, counted beforehand, and joined by shuffling beyond; there adaptive
execution splits a hot host.

Defined results: a null or hostless URL, or a null fetch time, matches nothing; entries with a
null pattern, day or action are void; several entries of a pattern at one time: the last in code
point order of the action holds (``remove`` after ``add``); hosts, those of prefixes too, compare in lower case without port and user;
a prefix may end anywhere (`example.com/ads` blocks `/adserver`, a host alone what starts with it);
entries act from their time on, inclusive; repeated captures are evaluated each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALL = 100_000


def host(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(name, F.lit(""))


def path(url: Column) -> Column:
    """The path of a URL, `/` at least."""
    return F.concat(F.lit("/"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1))


def candidates(url: Column, lengths: list[int] | None = None) -> Column:
    """All patterns that could block a URL: `host:` and its suffixes at dots, `prefix:` host and
    the path's prefixes, of every length or so that host and prefix have one of `lengths` characters."""
    h = host(url)
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    whole = F.concat(h, path(url))
    sizes = F.sequence(F.lit(1), F.char_length(whole)) if lengths is None else F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: (n <= F.char_length(whole)))
    prefixes = F.transform(sizes, lambda n: F.concat(F.lit("prefix:"), F.substring(whole, F.lit(1), n)))
    return F.when(h.isNotNull(), F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) of entries (pattern, kind, action, at)."""
    e = entries.where("pattern is not null and kind is not null and action in ('add', 'remove') and at is not null")
    e = e.select(F.concat_ws(":", F.lower("kind"), F.when(F.lower("kind") == "host", F.lower("pattern")).otherwise(F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.expr("substring(pattern, char_length(substring_index(pattern, '/', 1)) + 1)")))).alias("pattern"), "action", "at")
    e = e.groupBy("pattern", "at").agg(F.max("action").alias("action"))
    return e.select("pattern", "action", F.col("at").alias("since"), F.lead("at").over(W.partitionBy("pattern").orderBy("at")).alias("until"))


def filtered(captures: DataFrame, entries: DataFrame, key: str, url: str, at: str) -> DataFrame:
    """Per capture row: key, url, at, host, n_matches, matched (the least blocking pattern) and blocked."""
    spans = intervals(entries)
    if spans.limit(SMALL + 1).count() <= SMALL:
        spans = F.broadcast(spans)
    # one number for each length that a prefix in the list has
    lengths = [x[0] for x in spans.where("pattern like 'prefix:%'").select(F.char_length("pattern") - len("prefix:")).distinct().orderBy(F.lit(1)).collect()]
    c = captures.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(at).alias("at"), host(F.col(url)).alias("host"))
    c = c.withColumn("row", F.monotonically_increasing_id())
    tried = c.select("row", "k", "url", "at", "host", F.explode_outer(candidates(F.col("url"), lengths)).alias("tried"))
    on = (F.col("tried") == F.col("pattern")) & (F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))) & (F.col("action") == "add")
    hits = tried.join(spans, on, "left")
    out = hits.groupBy("row", "k", "url", "at", "host").agg(F.count("pattern").alias("n_matches"), F.min("pattern").alias("matched"))
    return out.select(F.col("k").alias(key), "url", F.col("at").alias(at), "host", "n_matches", "matched", (F.col("n_matches") > 0).alias("blocked"))
