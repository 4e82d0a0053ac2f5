"""One query for each operator, over its whole table, and the pipeline; SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, langid, licenses, linededup, minhash, pieces, secrets, telephony, tokencount, urlrules

#: Vocabulary files of public tokenizers; read on the driver, never copied into the repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
WORDPIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.array_join("deleted", ",").alias("deleted_lines"), F.array_join("partners", ",").alias("partners"), F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=3, percent=85)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    words = secrets.corpus_words(docs)
    found = secrets.scan(docs, secrets.fit(secrets.labelled_findings(words), words), words)
    return found.select("doc_id", "position", "length", F.md5("value").alias("value_md5"), "score", "is_secret")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), licenses.fit()).drop("paragraph")


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digests(telephony.audio_columns(_read(spark, sf_dir, "documents")))


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), tokencount.load_ranks(WORDPIECES))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), pieces.PieceModel.load(PIECES), keep=False)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op10_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(_read(spark, sf_dir, "pages"), urlrules.RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package, and a user of this module

    return corpus_pipeline.run(spark, sf_dir).drop("ids")


QUERIES = {f.__name__: f for f in (op1_linededup, op2_minhash, op3_secrets, op4_telephony, op5_tokencount, op6_licenses, op7_decontamination, op8_langid, op9_pieces, op10_urlrules, pipeline)}
ORACLES = {"op7_decontamination": decontaminate.ORACLE, "op10_urlrules": urlrules.ORACLE}
