"""A corpus pipeline: language, near-duplicates, repeated passages, mixture and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents; all but the last keep the columns of `documents`.

In every stage a null text is an empty one, an empty table gives no rows, and columns beside those of
`documents` are carried through (to the last stage but one) whatever their names. Stage by stage:

* language: rows with null or letterless texts go; a row without a lang gets the predicted one, a
  given lang stays; rows that repeat are judged each.
* near-duplicates: of equal or similar texts the row of the least id stays; rows that repeat that id
  stay together; a row with a null id, or without words, is no copy of any other and stays.
* repeated passages: of rows that share a string the one of the least id keeps it; rows of one id
  count as one document; a row with a null id loses nothing; a row of which nothing is left goes.
* mixture: rows of one id and weight are taken or left together; null sources are one source, the
  last; rows without words are taken with the whole epochs of their source.
* tokens: each row by itself.

Texts may be of any length; the operators' docstrings say how they are sliced.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, langid, minhash, mixing, suffix
from factloom.session import remove, shared_dir, table

#: Repeated strings of so many bytes are removed: fewer than 50 words of one letter have.
REPEAT_BYTES = 100
WEIGHTS, SHARE, CAP = [5, 2, 1], 1.5, 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those none of whose words speaks for a known language,
    which score an even guess; with nothing to learn from, all stay. Several languages are no fault.
    Where lang is null the predicted language takes its place."""
    model = langid.fit(docs)
    n = len(model.languages)
    if not n:
        return docs
    # plain names, so that what the operator adds clashes with no column
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    found = langid.identified(docs.toDF(*at.values()), model, text=at["text"], spans=True)
    known = F.lit(n == 1) | (F.size("spans") > 1) | (F.col("score") > 1 / n + 1e-9)
    found = found.where((F.col("lang_pred") != langid.UNDETERMINED) & known)
    return found.select(*[(F.coalesce(k, "lang_pred") if c == "lang" else F.col(k)).alias(c) for c, k in at.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group (five words, similarity 0.8)."""
    return minhash.deduplicated(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that an earlier document holds out of the texts, and counts their characters anew."""
    out = suffix.without_repeats(docs, width=REPEAT_BYTES)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents, some repeatedly, until each source comes to its target."""
    return mixing.mixture(docs, WEIGHTS, SHARE, CAP)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, and decodes them to prove it: doc_id, lang, source, n_tokens, token_ids, exact."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encoded(docs, path, pattern, exact="exact")
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "exact")


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("source_mix", mixture), ("byte_bpe", tokens)]

#: Neither languages, sketches nor suffix arrays can be said in SQL: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's folder goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    folder = None
    for k, (name, stage) in enumerate(STAGES):
        before, folder = folder, f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
    return docs
