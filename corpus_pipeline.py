"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. ``run`` writes the stages between in
the session's shared checkpoint folder.

Nulls, repeated rows, very long texts and empty tables are handled as each
operator's docstring says; only the columns of documents are read and returned.
When a stage begins, the working tables of the stages before it are freed, unless
its ``docs`` still read them: write a stage's result before calling the next.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscope.llm import bpe, hyperminhash, lang_id, mixing, radix_dedup
from equiscope.llm.queries import VOCABULARY
from equiscope.llm.util import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_left: list[str] = []  # working folders of earlier stages


def stage(fn):
    """A stage that first frees what the stages before it have left (see above)."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        used = docs.inputFiles() if _left else []
        name = lambda path: path.split(":", 1)[-1].lstrip("/")  # noqa: E731  without scheme and slashes
        # no files: cached or made up, so what it rests on can't be told
        free = [root for root in _left if used and not any(name(f).startswith(name(root)) for f in used)]
        Scratch(spark, "free").drop(*free)
        _left[:] = [root for root in _left if root not in free]
        before = len(Scratch.made)
        out = fn(spark, docs, sf_dir)
        _left.extend(Scratch.made[before:])
        return out

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; ``lang`` becomes the recognised one."""
    model = lang_id.fit(docs, "text", "lang", "doc_id")
    found = lang_id.identify(docs, model, "text", declared="lang", host="source")
    return found.where(~F.col("rejected")).withColumn("lang", F.col("language")).select(*COLUMNS)


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return radix_dedup.radix_dedup(docs).where("kept").select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates (five words, 0.8)."""
    return hyperminhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mixture draws, dealt into shards and shuffled."""
    return mixing.drawn_copies(mixing.mix(docs)).select(*COLUMNS)


@stage
def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the texts' token ids instead of the texts."""
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode_bpe)]

#: SQL can't express language ID, components and merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = scratch.table(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
