"""Scalar functions of the engine: transformers, previews, ids and tokens.

Everything that Spark's own functions can say exactly is a Column expression. Pandas UDFs are
left for what they cannot: Unicode normalisation, case folding, canonical JSON and ISO texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.registry import PREVIEW_KEYS

BLANKS = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Without white space (Unicode's too) at both ends."""
    return F.regexp_replace(c, BLANKS, "")


def blank_to_null(c: Column) -> Column:
    return F.when(stripped(c) != "", c)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefolded(s: pd.Series) -> pd.Series:
    """Stripped and case-folded: the form in which values are compared."""
    return s.map(lambda x: x.strip().casefold(), na_action="ignore")


def normalized_email(c: Column) -> Column:
    folded = F.lower(stripped(c))
    # ASCII is its own NFC, so only other texts leave the JVM
    return F.when(folded.rlike(r"^\p{ASCII}*$"), folded).otherwise(nfc(folded))


_SPACED = re.compile(r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})")


def iso_text(value: str | None) -> str | None:
    """ISO 8601 text of a date text. An ISO text keeps its offset, or has none; a text that starts
    like `YYYY-MM-DD HH:MM:SS` and goes on otherwise is taken for UTC (a zone's name is not
    applied); None for all others."""
    if value is None:
        return None
    v = value.strip()
    try:
        return datetime.fromisoformat(v).isoformat()
    except ValueError:
        m = _SPACED.match(v)
    try:
        return datetime.fromisoformat(f"{m[1]}T{m[2]}").replace(tzinfo=timezone.utc).isoformat() if m else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def iso_datetime(s: pd.Series) -> pd.Series:
    return s.map(iso_text, na_action="ignore")


def canonical(text: str) -> str:
    """JSON with sorted keys and no spaces; other scripts stay as they are."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Null where a text is not JSON."""

    def tried(x: str) -> str | None:
        try:
            return canonical(x)
        except ValueError:
            return None

    return s.map(tried, na_action="ignore")


def content_hash(json_text: Column) -> Column:
    return F.sha2(canonical_json(json_text).cast("binary"), 256)


#: name -> (Column -> Column); a null result of a value that was there means the value is bad.
TRANSFORMERS: dict[str, Callable[[Column], Column]] = {
    "lowercase": F.lower,
    "strip": stripped,
    "normalize_email": normalized_email,
    "coalesce_empty_to_null": blank_to_null,
    "parse_iso_datetime": iso_datetime,
}
#: Transformers whose null result means "absent", not "bad".
NULLING = {"coalesce_empty_to_null"}


def register_transformer(name: str, make: Callable[[Column], Column], nulling: bool = False) -> None:
    if name in TRANSFORMERS:
        raise ValueError(f"transformer {name!r} is registered already")
    TRANSFORMERS[name] = make
    if nulling:
        NULLING.add(name)


def get_transformer(name: str) -> Callable[[Column], Column]:
    if name not in TRANSFORMERS:
        raise KeyError(f"unknown transformer {name!r}; known: {', '.join(sorted(TRANSFORMERS))}")
    return TRANSFORMERS[name]


def transformed(c: Column, names: list[str]) -> Column:
    for n in names:
        c = get_transformer(n)(c)
    return c


def edge_id(src: Column, relation: Column, dst: Column, valid_from: Column | None = None) -> Column:
    """Deterministic; the fourth part is empty without a date, its bar stays."""
    last = F.lit("") if valid_from is None else F.coalesce(valid_from, F.lit(""))
    return F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws("|", src, relation, dst, last), 256), 1, 24))


def bare_edge_id(src: Column, relation: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge_"), F.substring(F.sha2(F.concat_ws("|", src, relation, dst), 256), 1, 24))


def org_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"org:{kind}:"), F.translate(F.lower(name), " ", "_"))


def hash_bucket(c: Column, buckets: int = 5) -> Column:
    """sha256 as a number modulo 5 (or 3, 15): 16 is 1 there, so the sum of hex digits will do."""
    if 15 % buckets:
        raise ValueError("buckets must divide 15")
    digits = F.filter(F.split(F.sha2(c, 256), ""), lambda d: d != "")
    return (F.aggregate(digits, F.lit(0), lambda s, d: s + F.conv(d, 16, 10).cast("int")) % buckets).cast("int")


def preview(attributes: Column, width: int = 200) -> Column:
    """The first preview attribute that is a string and not blank, else the JSON of all."""
    text = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), F.element_at(attributes, k), F.lit("}")), "$.v")
    string = lambda k: F.when(F.element_at(attributes, k).startswith('"') & (stripped(text(k)) != ""), stripped(text(k)))
    return F.substring(F.coalesce(*[string(k) for k in PREVIEW_KEYS], attributes_json(attributes)), 1, width)


def attributes_json(attributes: Column) -> Column:
    """One JSON object of a map whose values are JSON texts, keys in order."""
    entries = F.array_sort(F.map_entries(attributes))
    quoted = lambda k: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(k, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def json_text(c: Column) -> Column:
    """A column as JSON text."""
    one = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(one, F.lit(6), F.char_length(one) - 6)


def display_name(attributes: Column, id_: Column) -> Column:
    value = lambda k: blank_to_null(F.get_json_object(F.concat(F.lit('{"v":'), F.element_at(attributes, k), F.lit("}")), "$.v"))
    return F.coalesce(*[value(k) for k in ("name", "subject", "title", "email")], id_)


def embedding_text(type_: Column, attributes: Column) -> Column:
    """`type | k: v | …`, keys in order; null and empty values are left out."""
    raw = lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v)
    used = F.filter(F.array_sort(F.map_entries(attributes)), lambda e: e["value"].isNotNull() & ~e["value"].isin("null", '""'))
    return F.array_join(F.concat(F.array(type_), F.transform(used, lambda e: F.concat(e["key"], F.lit(": "), raw(e["value"])))), " | ")


#: Patterns of id-like tokens, in order.
ID_PATTERNS = (
    r"\bemp_\d+\b",
    r"\b(?:CLNT|CUST|VEND|ORG)-\d+\b",
    r"\b[A-Z][0-9A-Z]{9}\b",
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"(?i)\b(?:ticket|conv|conversation|order|sale|product)[-_:][\w-]+\b",
)


def id_tokens(text: Column, patterns: tuple[str, ...] = ID_PATTERNS) -> Column:
    """Id-like tokens, pattern by pattern, each once, in order."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])))


#: Fixed value: how an answer cites a node.
CITED_NODE = r"\[node:([A-Za-z0-9_:\-./]+)\]"


def cited_nodes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITED_NODE), F.lit(1)))


#: Fixed value: inline ids of messages.
MESSAGE_ID = r"\b(?:emp|cust|customer|prod|product|ticket|order|sale)_[A-Za-z0-9]+\b"


def light_entities(text: Column) -> Column:
    """Inline ids each once without regard to case, the first spelling kept."""
    found = F.regexp_extract_all(text, F.lit(MESSAGE_ID), F.lit(0))
    lowered = F.transform(found, F.lower)
    return F.filter(found, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def action_items(text: Column) -> Column:
    """Bullets below the heading `## Decisions / Action items`, up to the next heading."""
    # every part from its heading on; the first that is asked for, without its first line
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=##\s)")
    mine = F.filter(parts, lambda x: x.rlike(r"(?i)^\n?##\s*Decisions\s*/\s*Action items\s*(\n|$)"))
    below = F.split(F.regexp_replace(F.get(mine, 0), r"^\n", ""), "\n")
    lines = F.slice(below, F.lit(2), F.size(below))
    bullets = F.filter(lines, lambda x: x.rlike(r"^\s*[*-]\s+\S"))
    return F.coalesce(F.transform(bullets, lambda x: F.trim(F.regexp_replace(x, r"^\s*[*-]\s+", ""))), F.array().cast("array<string>"))


def escape_query(text: Column) -> Column:
    """Backslashes before what a query parser would read as operators."""
    return F.regexp_replace(text, r'(&&|\|\||[+\-!(){}\[\]^"~*?:\\/])', r"\\$1")


def squash(score: Column) -> Column:
    return F.when(score < 0, F.raise_error(F.lit("a score must not be negative"))).otherwise(score / (score + 1.0))


def cache_key(model: Column, template: Column, inputs: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\0"), template, F.lit("\0"), canonical_json(inputs)).cast("binary"), 256)


def _hash_vector(text: str, size: int = 384) -> np.ndarray:
    out: list[int] = []
    i = 0
    while len(out) < size:
        out.extend(hashlib.sha256(f"{i}:{text}".encode()).digest())
        i += 1
    v = np.array(out[:size], dtype=np.float64) / 255.0 - 0.5
    return v / np.linalg.norm(v)


def hash_embedding(text: str, size: int = 384) -> list[float]:
    """A deterministic stand-in for a model: bytes of sha256("i:text"), centred, of length 1."""
    return _hash_vector(text, size).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedded(s: pd.Series) -> pd.Series:
    # arrays: lists of numbers would take four times their memory in a batch
    return s.map(_hash_vector, na_action="ignore")


def unit(v: Column) -> Column:
    """A vector at length 1; a zero vector is an error."""
    d = v.cast("array<double>")
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, F.raise_error(F.lit("a zero vector has no direction"))).otherwise(F.transform(d, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, z: s + z)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
