"""Token counts by dynamic programming over a trie of pre-tokens.

A unigram model gives each vocabulary piece a log score; a pre-token's best segmentation into
pieces has the greatest sum (fewest pieces, then, among equals). Pre-tokens that begin alike
share that part of the work: the distinct pre-tokens of a batch are put in a trie by sorting
them, and each trie node (a prefix) gets its forward score, from the nodes above it on the
path, once. Where a pre-token ends, the number of pieces of its best segmentation is stored, and a
text's count is the sum over its pre-tokens. Pre-tokens of over ``LONG`` characters are scored by
themselves, in memory that does not grow with them.

Pieces are byte strings; every single byte counts as a piece with a low score, so each pre-token
has a segmentation. The vocabulary is a public rank file: scores fall with the logarithm of the
rank (a Zipf law), nothing is trained.

Defined results: null and empty texts have 0 tokens and score 0; rows repeat as they come; extra
columns are carried through.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm._text import pieces, small_batches
from factloom.session import ship

#: Counts of pre-tokens kept between the batches of a task (whole, or emptied when full).
REMEMBERED = 200_000
#: Pre-tokens of more characters are no part of the trie, whose path would hold each of their states.
LONG = 4096


class Vocabulary:
    def __init__(self, scores: dict[bytes, float]):
        worst = min(scores.values(), default=0.0) - 1.0
        self.scores = dict(scores)
        for i in range(256):
            self.scores.setdefault(bytes([i]), worst)
        self.longest = max(map(len, self.scores))
        # the trie of the pieces: node -> byte -> node, and each node's score
        self.next: list[dict[int, int]] = [{}]
        self.score: list[float | None] = [None]
        for piece, s in self.scores.items():
            at = 0
            for b in piece:
                to = self.next[at].get(b)
                if to is None:
                    to = self.next[at][b] = len(self.next)
                    self.next.append({})
                    self.score.append(None)
                at = to
            self.score[at] = s


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    total = math.log(sum(1.0 / (r + 2) for r in ranks.values()))
    return Vocabulary({p: -math.log(r + 2) - total for p, r in ranks.items()})


def counted(tokens: list[bytes], v: Vocabulary) -> tuple[list[int], list[float], int]:
    """Pieces and score of each of the distinct, sorted `tokens`; and the trie nodes scored.

    The tokens in sorted order are a depth-first walk of their trie: the stack holds the forward
    scores of the current prefix's nodes, and only nodes below what two neighbours share are new.
    A node's pieces reach forward to nodes below it, so each node keeps the pieces' states that
    are open at it.
    """
    counts, totals, nodes = [], [], 0
    nxt, own = v.next, v.score
    best: list[float] = [0.0]
    least: list[int] = [0]
    open_: list[list[tuple[int, int]]] = [[(0, 0)]]  # (piece trie node, where the piece began)
    before = b""
    for token in tokens:
        shared = 0
        most = min(len(before), len(token))
        while shared < most and before[shared] == token[shared]:
            shared += 1
        del best[shared + 1 :], least[shared + 1 :], open_[shared + 1 :]
        for k in range(shared, len(token)):
            b = token[k]
            top, few, states = -math.inf, 0, []
            for node, start in open_[k]:
                to = nxt[node].get(b)
                if to is None:
                    continue
                states.append((to, start))
                s = own[to]
                if s is not None:
                    s += best[start]
                    if s > top or (s == top and least[start] + 1 < few):
                        top, few = s, least[start] + 1
            best.append(top)
            least.append(few)
            states.append((0, k + 1))
            open_.append(states)
            nodes += 1
        counts.append(least[len(token)])
        totals.append(best[len(token)])
        before = token
    return counts, totals, nodes


def counted_alone(token: bytes, v: Vocabulary) -> tuple[int, float]:
    """Pieces and score of one long token, with no more than the last `longest` scores kept."""
    nxt, own, keep = v.next, v.score, v.longest + 1
    best, least = [0.0] * keep, [0] * keep
    states = [(0, 0)]
    for k, b in enumerate(token):
        top, few, ahead = -math.inf, 0, []
        for node, start in states:
            to = nxt[node].get(b)
            if to is None:
                continue
            ahead.append((to, start))
            s = own[to]
            if s is not None:
                at = start % keep
                s += best[at]
                if s > top or (s == top and least[at] + 1 < few):
                    top, few = s, least[at] + 1
        at = (k + 1) % keep
        best[at], least[at] = top, few
        ahead.append((0, k + 1))
        states = ahead
    return least[len(token) % keep], best[len(token) % keep]


def tokens_counted(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens", score: str = "token_score") -> DataFrame:
    """`docs` with the number of tokens and the score of each text; columns of those names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    ship(spark)
    docs = docs.drop(out, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType(), False), T.StructField(score, T.DoubleType(), False)])

    def run(batches):
        v = vocabulary(path)
        split = regex.compile(pattern)
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            for part in pieces(batch, text):
                found = [split.findall(t) if t else [] for t in part.column(text).to_pylist()]
                words = {w for ws in found for w in ws}
                # a very long one is scored by itself and not remembered
                alone = {w: counted_alone(w.encode(), v) for w in words if len(w) > LONG}
                fresh = words.difference(known, alone)
                if len(known) + len(fresh) > REMEMBERED:
                    known.clear()
                    fresh = words.difference(alone)
                new = sorted((w.encode(), w) for w in fresh)
                n, s, _ = counted([b for b, _ in new], v)
                known.update(zip((w for _, w in new), zip(n, s)))
                known.update(alone)
                sums = [[known[w] for w in ws] for ws in found]
                for w in alone:
                    del known[w]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array([sum(c for c, _ in x) for x in sums], np.int64)), pa.array(np.array([math.fsum(s for _, s in x) for x in sums], np.float64))], names=schema.names)

    return docs.mapInArrow(run, schema)
