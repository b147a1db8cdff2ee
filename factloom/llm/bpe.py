"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded by the tiktoken library without special tokens. A text longer than
``PART_CHARS`` is first split at boundaries that the pre-splitting pattern is sure to make, so
memory follows the part. Nothing in the pattern looks back, so matches start afresh after a
match's end whatever stands before. Sure ends are: letters or digits that no more of their kind
follow; other signs before a digit or white space; white space before its last character.

A run of one kind (letters, digits, signs, white space) of ``PART_CHARS`` and more has no such
boundary inside and is one match by itself. It is handed to the library's call for a single
piece, as the library's pattern engine runs out of stack on white space of some 10^6 characters.

Defined results: a null text encodes like an empty one (no ids); empty texts have no ids; ids
decode to exactly the bytes of the text; a text with lone surrogates cannot occur in UTF-8
input. Rows repeat as they come; extra columns are carried through untouched (of the names
``ids``, ``out`` and ``exact`` the new column replaces an old one). An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm._text import give_back, pieces, small_batches
from factloom.session import ship

PART_CHARS = 1 << 16
PIECE_BYTES = 1 << 20
#: The endings that the pattern takes with an apostrophe, in its order.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\p{White_Space}\p{L}\p{N}])(?=[\p{White_Space}\p{N}])|(?<=\p{White_Space})(?=\p{White_Space}\P{White_Space})")
_WHITE = regex.compile(r"\p{White_Space}")
_RUNS = r"\p{L}{%d,}|\p{N}{%d,}|\p{White_Space}{%d,}|[^\p{White_Space}\p{L}\p{N}]{%d,}"


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _numerals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


@lru_cache(maxsize=4)
def _runs(size: int):
    return regex.compile(_RUNS % (size, size, size, size))


def safe_parts(text: str, size: int = PART_CHARS):
    """Parts of a text whose separate encodings concatenate to the encoding of the whole."""
    at, n = 0, len(text)
    while n - at > size:
        m = _SAFE.search(text, at + size)
        if m is None or m.start() <= at:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _ending(text: str, at: int) -> int:
    """How many letters from `at` on belong to an apostrophe before them that starts a match."""
    if at == 0 or text[at - 1] != "'":
        return 0
    if at > 1 and (text[at - 2] == " " or regex.match(r"[^\p{White_Space}\p{L}\p{N}]", text[at - 2])):
        return 0
    return next((len(e) for e in _ENDINGS if text.startswith(e, at)), 0)


def spans(text: str, size: int = PART_CHARS):
    """(part, single) in order: what the pattern splits further, and long runs that are one match."""
    at = 0
    for m in _runs(size).finditer(text):
        start, end = m.span()
        if text[start].isalpha():
            start += _ending(text, start)
        white = _WHITE.match(text, m.start()) is not None
        if white:
            end -= end < len(text)  # the last one goes with what follows
        elif start == m.start() and start > at and text[start - 1] == " ":
            start -= 1
        # white space other than a blank does not go with what follows: its last character is a match
        alone = start - 1 if not white and start == m.start() > at and text[start - 1] != " " and _WHITE.match(text, start - 1) else start
        if alone > at:
            yield from ((p, False) for p in safe_parts(text[at:alone], size))
        if start > alone:
            yield text[alone:start], False
        if end > start:
            yield text[start:end], True
        at = max(start, end)
    if at < len(text):
        yield from ((p, False) for p in safe_parts(text[at:], size))


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    e = encoding(path, pattern)
    if not text:
        return []
    if len(text) <= PART_CHARS:
        return e.encode_ordinary(text)
    out: list[int] = []
    for part, single in spans(text):
        out += e._core_bpe.encode_single_piece(part.encode()) if single else e.encode_ordinary(part)
    return out


def decode(ids, path: str, pattern: str) -> bytes:
    """The raw bytes of the ids; bytes that are not UTF-8 stay as they are."""
    return encoding(path, pattern).decode_bytes(list(ids)) if len(ids) else b""


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", exact: str | None = None) -> DataFrame:
    """`docs` with a column of token ids (array<int>) and, if `exact` names one, a column that says
    whether they decode to the text's bytes."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(exact, T.BooleanType(), False)] if exact else [])]
    docs = docs.drop(*(f.name for f in new))
    schema = T.StructType([*docs.schema.fields, *new])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                flat, ends, same = [], [0], []
                for t in part.column(text).to_pylist():
                    got = np.array(encode(t, path, pattern), dtype=np.int32)
                    flat.append(got)
                    ends.append(ends[-1] + len(got))
                    if exact:
                        same.append(decode(got.tolist(), path, pattern) == (t or "").encode())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *([pa.array(same, pa.bool_())] if exact else [])], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`rows` with a binary column of the bytes that the ids stand for; null ids give no bytes."""
    ship(rows.sparkSession)
    rows = rows.drop(out) if out in rows.columns else rows
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, ids, PIECE_BYTES // 4):
                got = [decode(i or [], path, pattern) for i in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*part.schema.names, out])
        give_back()

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, sha256 of the decimal ids joined by one space, and sha256 of the
    bytes decoded from those ids."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        e = encoding(path, pattern)
        numeral = _numerals(e.n_vocab)
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                n, a, b = [], [], []
                for t in part.column(1).to_pylist():
                    ids = encode(t, path, pattern)
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join([numeral[i] for i in ids]).encode()).hexdigest())
                    b.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, schema)
