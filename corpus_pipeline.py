"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet in the shared
folder and read again as the next one's documents.  All but the last return the columns of
`documents` (doc_id, text, lang, source, n_chars; more are passed on).

language: documents in which no language has half of the words, or without a letter, go.
near_duplicates: of each component of alike documents, the one with the smallest id stays.  Rows of
    one id stay or go together; rows with a null id stay, as nothing names them.
decontamination: documents that give a test item away go.
personal_data: findings in texts are masked; n_chars is the new length.
tokens: the token ids of every text, with their number, instead of the text.

Null texts have no letter and go in the first stage; an empty table passes all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm import bpe, decontaminate, jaccard, language, pii
from rankloom.llm.common import stored
from rankloom.llm.registry import table

# Least proportion of the largest language.
MAJORITY = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs)
    known = language.identify(docs, model, out="__languages", lang="__lang", score="__score")
    return known.where((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= MAJORITY)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.components(docs)
    copies = stored(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).drop("text").withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("language", by_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_test_items),
    ("personal_data", without_personal_data),
    ("tokens", as_tokens),
]

# The stages are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
