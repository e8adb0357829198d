"""The registered queries of this subpackage, thin over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cotrain, crf, fmindex, jaccard, katz, knn, langid, mixing, warc
from .shared import crc_fold, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.result(mixing.plan(table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    return katz.score(docs)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels")
    quality, toxic = cotrain.fit(docs, labels, ["quality", "toxic"])
    scored = cotrain.predict(docs, {"": quality, "toxic_": toxic})
    keep = (F.col("score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return scored.select("doc_id", "text_score", "meta_score", "score", "toxic_score", keep.alias("keep"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.windows(chat.control_case(table(spark, sf_dir, "conversations"))))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return crf.scan(docs, crf.fit(docs)).select("doc_id", *crf.digest(F.col("secret_spans")))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return knn.search(vectors, vectors.where("vec_id % 20 = 0"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_warc, op3_katz, op4_quality, op5_chat_windows, op6_jaccard, op7_secrets, op8_neighbours, op9_decontamination, op10_language)}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op2_warc": warc.SQL}
