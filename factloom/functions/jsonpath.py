"""A JSONPath subset compiled to Column expressions over VARIANT.

`$`, `.key`, `['any key']`, `[n]` and `[*]` are known; filters, slices and `..` are refused. A path
gives the first match, as JSON text; SQL NULL means "missing", the text `null` a JSON null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"""\.(?P<key>[A-Za-z_@][\w@.\-]*?)(?=[.\[]|$)|\['(?P<quoted>[^']*)'\]|\["(?P<double>[^"]*)"\]|\[(?P<index>\d+)\]|\[(?P<star>\*)\]""")
_PLAIN = re.compile(r"^[A-Za-z_]\w*$")


@dataclass(frozen=True)
class Path:
    text: str
    steps: tuple

    @property
    def dotted(self) -> str:
        """One spelling for bracketed and dotted keys."""
        return "$" + "".join("[*]" if s == "*" else f"[{s}]" if isinstance(s, int) else f".{s}" for s in self.steps)


def bracketised(path: str) -> str:
    """Keys that are not plain names in brackets: `$.Marital Status` -> `$['Marital Status']`."""
    if not path.startswith("$"):
        return path
    out, parts = ["$"], re.findall(r"\[[^\]]*\]|\.[^.\[]+", path[1:])
    if "".join(parts) != path[1:]:
        raise ValueError(f"unsupported JSONPath {path!r}")
    for part in parts:
        out.append(part if part[0] == "[" or _PLAIN.match(part[1:]) else f"['{part[1:]}']")
    return "".join(out)


def parse(path: str) -> Path:
    text = bracketised(path if path.startswith("$") else f"$.{path}")
    at, steps = 1, []
    while at < len(text):
        m = _STEP.match(text, at)
        if m is None:
            raise ValueError(f"unsupported JSONPath {path!r} at {text[at:]!r}")
        if m["star"]:
            steps.append("*")
        elif m["index"] is not None:
            steps.append(int(m["index"]))
        else:
            steps.append(next(x for x in (m["key"], m["quoted"], m["double"]) if x is not None))
        at = m.end()
    return Path(text, tuple(steps))


def _literal(steps) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def matches(variant: Column, path: Path) -> Column:
    """All matches as an array of VARIANT."""
    return _matches(F.array(variant), path.steps)


def _matches(found: Column, steps) -> Column:
    steps = tuple(steps)
    if "*" in steps:
        k = steps.index("*")
        if k:
            found = F.transform(found, lambda v: F.try_variant_get(v, _literal(steps[:k]), "variant"))
        each = F.flatten(F.transform(found, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))))
        return _matches(each, steps[k + 1 :])
    if steps:
        found = F.transform(found, lambda v: F.try_variant_get(v, _literal(steps), "variant"))
    return F.filter(found, lambda v: v.isNotNull())


def first(variant: Column, path: str | Path) -> Column:
    """The first match as JSON text; NULL is missing."""
    p = parse(path) if isinstance(path, str) else path
    if "*" not in p.steps:
        v = F.try_variant_get(variant, _literal(p.steps), "variant") if p.steps else variant
    else:
        v = F.get(matches(variant, p), 0)
    return F.to_json(v)


def coalesced(variant: Column, paths: list[str]) -> tuple[Column, Column]:
    """The first match that is neither missing nor null, and the path that gave it."""
    got = [F.nullif(first(variant, p), F.lit("null")) for p in paths]
    which = F.coalesce(*[F.when(g.isNotNull(), F.lit(p)) for g, p in zip(got, paths)], F.lit(None).cast("string"))
    return F.coalesce(*got, F.lit(None).cast("string")), which


def as_string(json: Column) -> Column:
    """JSON text as a plain string: quoted strings are unquoted, the rest stays as written."""
    return F.when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")).otherwise(json)
