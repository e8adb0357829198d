"""A corpus pipeline of five stages, each a table in the shared folder that the next one reads.

Every stage takes (spark, docs, sf_dir). All but the last keep the columns of ``docs``, whatever their names. Rows that
repeat are told apart by no stage but near_duplicates; an empty table gives an empty one; a null text is an empty text.
A stage that calls Python bounds the session's Arrow batches (``shared.small_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glotspark.llm import crf, fmindex, jaccard, langid, mixing
from glotspark.llm.shared import Scratch, saved, small_batches, table

#: Language identification rejects what has no letters and what it is less sure of than this.
SURE = 0.5


def _aside(docs: DataFrame, made: list[str]) -> tuple[DataFrame, list]:
    """``docs`` with the columns that an operator makes itself under other names, and the columns that bring all back."""
    names = {}
    for c in docs.columns:
        names[c] = c
        while c in made and (names[c] in made or names[c] in docs.columns):
            names[c] = f"_{names[c]}"
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go: those with null text or no letter, and those scored under SURE.

    Rows without a lang are no examples but are judged like all; with no example at all, every document goes.
    """
    small_batches(spark)
    model = langid.fit(docs)
    docs, own = _aside(docs, ["lang_pred", "score"])
    return langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity 0.8).

    Rows that share an id are one document, which stays or goes whole. A document without words is no near copy,
    nor is a row without an id. Of rows with the same id and text one stays, the first by the other columns; so it
    does of rows without an id that have the same text (they are compared with one another only).
    """
    small_batches(spark)
    groups = jaccard.join(docs.select("doc_id", "text"), width=5, percent=80)
    marked = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("component_id") < F.col("doc_id")).alias("gone"), F.count("*").alias("n"))
    marked = saved(marked.where("gone OR n > 1"), "pipeline-marked")
    named = docs.where("doc_id IS NOT NULL")
    # Only rows whose id repeats or is null are sorted by their texts.
    several = named.join(marked.where("NOT gone").select("doc_id"), "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id IS NULL"))
    same = Window.partitionBy("doc_id", "text").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(1)])
    place = "n"
    while place in docs.columns:
        place = f"_{place}"
    one = several.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1)
    return named.join(marked.select("doc_id"), "doc_id", "left_anti").select(docs.columns).union(one.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; the others go. A document without words stays, and an empty benchmark keeps all."""
    small_batches(spark)
    docs, own = _aside(docs, fmindex.FOUND.names)
    return fmindex.find(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(own)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark and n_chars (if there is one) counted anew where there was one.

    A null text stays null, and repeated rows stay repeated.
    """
    small_batches(spark)
    model = crf.fit(docs)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    docs, own = _aside(docs, ["secret_spans"])
    found = crf.scan(docs, model)
    clean = found.withColumn("text", crf.redacted(F.col("text"), F.col("secret_spans")))
    if kind:
        clean = clean.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(own)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document under the target weights; null text has size 0, the null source is a source."""
    return mixing.result(mixing.plan(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]

#: SQL can't express language identification or the CRF; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept = Scratch(spark)
        docs = kept.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            last.remove()
        last = kept
    return STAGES[-1][1](spark, docs, sf_dir)
