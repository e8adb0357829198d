"""The corpus audit: every cell detector as findings of one long table, and glossary adherence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import bounded_broadcast, duplicates, length_outliers, long_form


def findings(wide: DataFrame, row: str, key: str, langs: list[str], base: str) -> DataFrame:
    """(row, lang, kind) of a wide table with a row number: duplicate keys, damaged or padded cells, lost placeholders, odd lengths."""
    cells = long_form(wide.select(F.col(row).alias("row"), *langs), "row", langs)
    source = wide.select(F.col(row).alias("row"), X.strip(F.col(base)).alias("source"))
    value = F.col("value")
    kinds = [F.when(X.has_mojibake(value), "mojibake"), F.when(~X.is_nfc(value), "not_nfc"), F.when(X.whitespace_issue(value).isNotNull(), "whitespace")]
    own = cells.where("value <> ''").select("row", "lang", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    both = cells.where(F.col("lang") != base).join(source, "row").where(X.filled(value) & (F.col("source") != ""))
    parity = both.where(X.placeholders(value) != X.placeholders(F.col("source"))).select("row", "lang", F.lit("placeholder_mismatch").alias("kind"))
    ratios = both.select("row", "lang", (F.length(X.strip(value)) / F.length("source")).alias("ratio"))
    odd = length_outliers(ratios, "lang").select("row", "lang", F.lit("length_outlier").alias("kind"))
    twice = duplicates(wide, key, row).select(F.col(row).alias("row"), F.lit(None).cast("string").alias("lang"), F.lit("duplicate_key").alias("kind"))
    return own.union(parity).union(odd).union(twice)


def adherence(segments: DataFrame, glossary: DataFrame, case_sensitive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per language (lang, applicable, adherent, rate), and the misses (id, lang, term, expected).

    Segments are (id, lang, source, target); the glossary has (lang, term, expected). A term applies
    where it stands in the source and has an expected form in that language.
    """
    key = (lambda c: c) if case_sensitive else X.fold
    low = glossary.where(X.filled(F.col("expected")) & X.filled(F.col("term"))).distinct().select(F.col("lang").alias("g_lang"), "term", "expected", key(F.col("term")).alias("t"), key(F.col("expected")).alias("e"))
    folded = segments.select("id", "lang", key(F.col("source")).alias("s"), key(F.col("target")).alias("d"))
    hit = folded.join(bounded_broadcast(low), F.expr("lang = g_lang AND contains(s, t)")).where(X.bounded(F.col("s"), F.col("t"))).withColumn("ok", F.coalesce(X.bounded(F.col("d"), F.col("e")), F.lit(False)))
    rates = hit.groupBy("lang").agg(F.count("*").alias("applicable"), F.count_if("ok").alias("adherent"), F.avg(F.col("ok").cast("double")).alias("rate"))
    return rates, hit.where("NOT ok").select("id", "lang", "term", "expected")


def top_misses(misses: DataFrame, k: int = 5) -> DataFrame:
    """(lang, term, n): the most missed terms of each language, ties to the smaller term."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
    return misses.groupBy("lang", "term").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def languages(glossary: DataFrame, segments: DataFrame) -> list[str]:
    """The languages that both tables have columns for, in the glossary's order; none is an error."""
    from .quality import is_language

    both = [c for c in glossary.columns if is_language(c) and c in segments.columns]
    if not both:
        raise ValueError("the glossary and the segments share no language")
    return both
