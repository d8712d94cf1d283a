"""Documents to packed training sequences: language, exact and near duplicates, PII, packing.

Each stage reads all that the one before it kept, from Parquet in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from caudal.llm.common import stored, table, without
from caudal.llm.exact_dedup import drop_exact_duplicates
from caudal.llm.language_id import UNDETERMINED, identify, train
from caudal.llm.minhash_dedup import near_duplicates
from caudal.llm.packing import WORD_BPE, pack
from caudal.llm.pii import find_personal_data, redacted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Language, MinHash and the tokenizer cannot be written in SQL; tests hold the stages against
# plain versions.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; the others carry the one found."""
    found = identify(docs.select(*COLUMNS), train(docs))
    known = found.filter(F.col("lang_pred") != UNDETERMINED)
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return drop_exact_duplicates(docs.select(*COLUMNS)).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the smallest id stays."""
    docs = docs.select(*COLUMNS)
    decisions = stored(near_duplicates(docs), "near-decisions")
    return without(docs, decisions.filter("NOT kept")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    found = find_personal_data(docs.select(*COLUMNS))
    clean = found.withColumn("text", redacted(F.col("text"), F.col("all_spans")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces, with their token ids."""
    return pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
