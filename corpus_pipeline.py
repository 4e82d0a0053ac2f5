"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination and encoding of the documents table.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, langid, linededup, minhash, pieces
from quillspark.llm.queries import PIECES
from quillspark.llm.scratch import Scratch, mark, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts and those without a letter go."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines deleted from the later documents; a document that loses its whole text goes."""
    out = linededup.dedup_lines(docs).where("n_deleted = 0 or n_deleted < n_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def _whole(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents table for the rows of ``docs`` that are cut from it: no line that it has not."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("__whole"))
    cut = docs.select("doc_id", F.col("text").alias("__cut")).join(table, "doc_id")
    cut = cut.where(F.size(F.array_except(F.split("__cut", "\n", -1), F.split("__whole", "\n", -1))) == 0)
    return cut.select("doc_id", F.col("__whole").alias("text"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Line dedup leaves of a near copy the lines only that differ, which resemble nothing. So documents are compared by
    their texts before it first, and those that stay by their texts after it.
    """
    scratch, since = Scratch(spark, "near"), mark()

    def left(texts: DataFrame, name: str) -> DataFrame:
        gone = scratch.keep(minhash.near_duplicates(texts).where("not kept").select("doc_id").distinct(), f"{name}-gone")
        release(since)
        return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)

    docs = scratch.keep(left(scratch.keep(_whole(spark, docs, sf_dir), "whole"), "whole"), "rest")
    scratch.keep_only("rest")
    return left(docs, "cut")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_md5, round_trip, ids) of each document."""
    return pieces.encode(docs, pieces.PieceModel.load(PIECES))


STAGES = [("language", language), ("lines", lines), ("near", near), ("leaks", leaks), ("encode", encode)]
#: Classifier, alignment and lattice search have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            scratch.keep_only(name)
            release(since)
    return docs
