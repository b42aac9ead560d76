"""A corpus pipeline over the llm operators: each stage takes what the one before it kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.llm import decontam, jaccard, langid, packing, secret_scan
from loomgraph.llm.queries import VOCABULARY


def _stage(function):
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        runtime.prepare(spark)
        return function(spark, docs, sf_dir)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with `lang` as predicted; those that language ID rejects go.

    Null texts and texts without a letter are rejected. Where no row has a label, no other is, and `lang` stays as it
    was. Repeated rows and null ids are judged like others; an empty table gives an empty one; other columns stay.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.judge(docs, model).where(~F.col("rejected"))
    lang = F.when(F.col("lang_pred") == langid.UNDETERMINED, F.col("row.lang")).otherwise(F.col("lang_pred"))
    return named.select(*[lang.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 80 % alike) stays, the one of the least doc_id.

    Null texts and texts without a word stay, all of them; of repeated rows one stays; an empty table gives an empty one.
    """
    return jaccard.representatives(docs, width=5, percent=80)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, or its template with other values, go.

    Null and empty texts stay; rows go one by one, whatever their ids; with an empty benchmark or table nothing goes.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret found in a text is replaced by a mark, and n_chars follows where it is a column.

    Null texts stay null and have no n_chars; repeated rows stay repeated; an empty table gives an empty one.
    """
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its sequence and its place there.

    Null and empty texts are a piece of one id; repeated rows are packed as often as they occur; other columns are not
    read; an empty table gives an empty one.
    """
    return packing.pack(packing.cut_documents(docs, VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing_stage),
]

#: Language ID and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = runtime.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
