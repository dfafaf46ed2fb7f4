"""A corpus pipeline of five stages over `documents`; each stage's result is written as Parquet and is the next one's input.

Rejected languages go, one document of each near-duplicate group stays, personal data is sanitised, sources are mixed to their
weights, and what is left is packed into sequences. All stages but the last return the columns they were given.

In every stage a null text counts as empty, repeated rows are rows (the second stage keeps one of them), texts are read whole at any
length, rows with a null doc_id are told apart by their text, ties go to the smallest id, then to the smallest hash of the text, columns
that aren't named here pass through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import common, jaccard, langid, mixing, packing, pii, tokens

#: Tokens wanted, in percent of what arrives at the mixing stage, and passes over a document at most.
MIX_PERCENT, MIX_EPOCHS = 90, 2
#: The least language score of a document that stays. Random letters, base64 and other scripts score 0 to 0.3 against profiles of
#: European languages, short or mixed texts in a profile's language over 0.4.
LEAST_SCORE = 0.3


#: The columns that stages look at. All others travel in one struct, so that no name of theirs can meet a name of a stage.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known = [c for c in docs.columns if c in COLUMNS]
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*known, F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")), sf_dir)
        return out.select(*(F.col("others")[c].alias(c) if c in others else F.col(c) for c in docs.columns))

    return run


@apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the profiles know: no letter, or too far from each profile. A null lang becomes the predicted one.

    Profiles are learned from all documents with a lang. A table without any lang has no profiles, and so loses all its documents.
    """
    found = langid.identify(docs, F.lit(True), "__lang", "__score").where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


@apart
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the smallest id; rows without an id come last, in the order of a hash of their text."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.withColumn("__text", text).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod("__text", F.lit(1 << 61))))
    found = jaccard.grouped(named.select(F.col("__id").alias("doc_id"), "text")).where("kept")
    # an id may have several texts in one group
    one = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("at")).select("at.*")
    kept = one.unionByName(found.where("group is null").select("doc_id", "h")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__text"))
    # repeated rows go before they are shuffled
    return named.dropDuplicates(["__id", "__text"]).join(kept, ["__id", "__text"], "left_semi").select(*docs.columns)


@apart
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and removes or generalises terms that disclose it."""
    return pii.sanitise(docs)


@apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, in part or repeatedly, until each source has its tokens."""
    levels = mixing.document_levels()
    return mixing.apply(docs, mixing.decide(docs, levels, mixing.WEIGHTS, MIX_PERCENT, MIX_EPOCHS), levels)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 1024 tokens; one row a piece."""
    return packing.pack_documents(docs, tokens.vocabulary())


STAGES = [("language_id", language), ("ngram_jaccard_join", deduplicate), ("pii_sanitise", sanitise), ("source_mixing", mix), ("best_fit_packing", pack)]
#: SQL expresses neither the language profiles' training by arrays nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
