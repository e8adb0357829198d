"""Translation quality: language columns, translation states, equity, untranslated terms, metric tables, and the audit report."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import duplicates, exact_medians, long_form

# A header that looks like a language tag, and names that are never one.
LANGUAGE_HEADER = re.compile(r"[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})*\Z")
NEVER_LANGUAGES = ("key", "id", "term", "source", "slug", "context", "note")


def is_language(name: str) -> bool:
    """Whether a column's name is taken for a language tag."""
    return name.lower() not in NEVER_LANGUAGES and LANGUAGE_HEADER.match(name.strip()) is not None


def columns_of(wide: DataFrame, key: str | None = None) -> tuple[str | None, list[str]]:
    """The key column (``key`` if the table has it, else the first that is no language) and the language columns."""
    langs = [c for c in wide.columns if is_language(c)]
    others = [c for c in wide.columns if c not in langs]
    return (key if key in wide.columns else others[0] if others else None), langs


def most_filled(wide: DataFrame, langs: Sequence[str]) -> str:
    """The language with the most cells filled; ties go to the first column."""
    filled = wide.agg(*(F.count_if(X.filled(F.col(f"`{c}`"))).alias(f"n{k}") for k, c in enumerate(langs))).first()
    return langs[max(range(len(langs)), key=lambda k: (filled[k], -k))]


def state(target: Column, source: Column, short_ratio: float = 0.3) -> Column:
    """blank, untranslated (the source copied), too_short (under ``short_ratio`` of the source's length) or translated; both compared stripped."""
    t, s = X.strip(target), X.strip(source)
    return F.when(t == "", "blank").when(s == "", "translated").when(t == s, "untranslated").when(F.length(t) < F.length(s) * short_ratio, "too_short").otherwise("translated")


def states(wide: DataFrame, row: str, langs: Sequence[str], base: str, short_ratio: float = 0.3) -> DataFrame:
    """(row, lang, source, state) of every cell; a filled cell of the base language is translated."""
    cells = long_form(wide.select(F.col(row).alias("row"), F.col(f"`{base}`").alias("source"), *(F.col(f"`{c}`") for c in langs)), ["row", "source"], list(langs))
    own = F.when(X.filled(F.col("value")), "translated").otherwise("blank")
    return cells.select("row", "lang", "source", F.when(F.col("lang") == base, own).otherwise(state(F.col("value"), F.col("source"), short_ratio)).alias("state"))


def equity(cells: DataFrame) -> DataFrame:
    """From ``states``: lang, n_rows, filled, coverage, untranslated and too_short with their rates among filled cells, the distance from the best, and whether it is over 0.10."""
    n = lambda s: F.count_if(F.col("state") == s)
    counts = cells.groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(F.col("state") != "blank").alias("filled"), n("untranslated").alias("untranslated"), n("too_short").alias("too_short"))
    rate = lambda c: F.when(F.col("filled") > 0, F.col(c) / F.col("filled")).otherwise(0.0)
    rated = counts.withColumn("coverage", F.col("filled") / F.col("n_rows")).withColumn("untranslated_rate", rate("untranslated")).withColumn("too_short_rate", rate("too_short"))
    behind = F.max("coverage").over(Window.partitionBy()) - F.col("coverage")  # a row for each language
    return rated.withColumn("behind", behind).withColumn("underserved", behind > 0.10)


def spread(per_lang: DataFrame) -> DataFrame:
    """One row: the gap from best to worst coverage, and its coefficient of variation (of the population; 0 at mean 0)."""
    mean = F.avg("coverage")
    return per_lang.agg((F.max("coverage") - F.min("coverage")).alias("gap"), F.when(mean > 0, F.stddev_pop("coverage") / mean).otherwise(0.0).alias("cv"))


def untranslated(wide: DataFrame, row: str, langs: Sequence[str], base: str) -> DataFrame:
    """(row, lang, term): cells that are blank or copied from the base, where the base isn't blank."""
    others = [c for c in langs if c != base]
    kept = states(wide, row, others, base).where("state IN ('blank', 'untranslated')").withColumn("term", X.strip(F.col("source")))
    return kept.where("term <> ''").select("row", "lang", "term")


def untranslated_counts(wide: DataFrame, row: str, langs: Sequence[str], base: str) -> DataFrame:
    return untranslated(wide, row, langs, base).groupBy("term").agg(F.count("*").alias("n"))


# The metric tables: segments (id, source_text), translations (segment, lang, text), matches (segment, lang, term), job rows (job, log).


def _percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)


def term_adherence(matches: DataFrame, translations: DataFrame) -> DataFrame:
    """lang, applicable, applied, adherence_pct: of the matched terms, those that their segment's translation holds in any case."""
    both = matches.join(translations, ["segment", "lang"])
    applied = F.count_if(F.contains(F.lower("text"), F.lower("term")))
    return both.groupBy("lang").agg(F.count("*").alias("applicable"), applied.alias("applied"), _percent(applied, F.count("*")).alias("adherence_pct"))


def coverage_gap(translations: DataFrame) -> DataFrame:
    """lang, n_filled, n_segments, coverage_pct, gap_from_best_pp."""
    n = translations.groupBy("lang").agg(F.count_if(X.filled(F.col("text"))).alias("n_filled"), F.count("*").alias("n_segments"))
    share = F.col("n_filled") / F.col("n_segments")
    return n.select("lang", "n_filled", "n_segments", F.round(100.0 * share, 1).alias("coverage_pct"), F.round(100.0 * (F.max(share).over(Window.partitionBy()) - share), 1).alias("gap_from_best_pp"))


def tag_forms(translations: DataFrame) -> DataFrame:
    """base, forms (sorted), n_forms of languages with several spellings."""
    tags = translations.select("lang").distinct()
    return tags.groupBy(F.split_part(F.replace("lang", F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)).alias("base")).agg(F.array_sort(F.collect_list("lang")).alias("forms"), F.count("*").alias("n_forms")).where("n_forms > 1")


def damaged(translations: DataFrame, most: int = 100, width: int = 60) -> DataFrame:
    """The first ``most`` rows (by segment and language) that look wrongly decoded, with the start of their text."""
    return translations.where(X.has_mojibake(F.col("text"))).orderBy("segment", "lang").limit(most).select("segment", "lang", F.left("text", F.lit(width)).alias("sample"))


def copied_through(translations: DataFrame, segments: DataFrame) -> DataFrame:
    """lang, copied, total, copy_pct of languages where some translation is its source."""
    both = translations.join(segments.select(F.col("id").alias("segment"), "source_text"), "segment")
    copied = F.count_if(X.strip(F.col("text")) == X.strip(F.col("source_text")))
    return both.groupBy("lang").agg(copied.alias("copied"), F.count("*").alias("total"), _percent(copied, F.count("*")).alias("copy_pct")).where("copied > 0")


def requested(log: Column, what: str) -> Column:
    """Whether the JSON array ``requested`` holds ``what``."""
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(log, "$.requested"), "array<string>"), what), F.lit(False))


def augmenter_health(jobs: DataFrame, most: int = 20) -> DataFrame:
    """job, rows_total, glossary_requested, zero_match_rows: jobs whose glossary found nothing come first."""
    asked = requested(F.col("log"), "glossary")
    terms = F.coalesce(F.json_array_length(F.get_json_object("log", "$.glossary_terms")), F.lit(0))
    out = jobs.groupBy("job").agg(F.count("*").alias("rows_total"), F.count_if(asked).alias("glossary_requested"), F.count_if(asked & (terms == 0)).alias("zero_match_rows"))
    return out.orderBy(F.desc("zero_match_rows"), "job").limit(most)


# The audit as one report.


def repeated_values(wide: DataFrame, column: str) -> DataFrame:
    """One row: how many non-blank cells repeat an earlier one (stripped)."""
    value = X.strip(F.col(f"`{column}`"))
    return wide.select(value.alias("v")).where("v <> ''").agg((F.count("v") - F.count_distinct("v")).alias("n"))


def parity(cells: DataFrame) -> DataFrame:
    """From (row, lang, value, source): cells whose placeholders aren't the source's, with those missing and those extra, repeats told apart."""
    marks = cells.withColumn("want", X.placeholders(X.strip(F.col("source")))).withColumn("have", X.placeholders(F.col("value"))).where("want <> have")
    return marks.select("row", "lang", X.multiset_minus(F.col("want"), F.col("have")).alias("missing"), X.multiset_minus(F.col("have"), F.col("want")).alias("extra"))


def audit(wide: DataFrame, row: str, key: str | None = None, base: str | None = None) -> tuple[dict, DataFrame]:
    """The report's head (key column, languages, base, coverage, spellings, counts) and all findings (row, column, issue, detail).

    ``row`` numbers the rows from 1. Findings stay a DataFrame; only counts by column and issue come to the driver.
    """
    key_column, langs = columns_of(wide.drop(row), key)
    spark = wide.sparkSession
    if not langs:
        none = spark.createDataFrame([(0, "(header)", "no language columns detected", ", ".join(wide.columns))], "row long, column string, issue string, detail string")
        return {"key_column": key_column, "languages": [], "base": None, "coverage": {}, "spellings": {}, "counts": {"no language columns detected": 1}}, none
    base = base if base in langs else most_filled(wide, langs)
    by_base: dict[str, list[str]] = {}
    for c in langs:
        by_base.setdefault(re.split("[-_]", c)[0].lower(), []).append(c)
    spellings = {b: cs for b, cs in by_base.items() if len(cs) > 1}
    quoted = [F.col(f"`{c}`") for c in langs]
    cells = long_form(wide.select(F.col(row).cast("long").alias("row"), F.col(f"`{base}`").alias("source"), *quoted), ["row", "source"], langs)
    value = F.col("value")
    live = cells.where(X.filled(value))
    kinds = [
        F.when(X.has_mojibake(value), F.struct(F.lit("possible mojibake").alias("issue"), F.left(value, F.lit(40)).alias("detail"))),
        F.when(~X.is_nfc(value), F.struct(F.lit("not NFC-normalized").alias("issue"), F.lit("jamo-split or combining sequence").alias("detail"))),
        F.when(X.whitespace_issue(value).isNotNull(), F.struct(X.whitespace_issue(value).alias("issue"), F.lit("").alias("detail"))),
    ]
    own = live.select("row", F.col("lang").alias("column"), F.explode(F.array_compact(F.array(*kinds))).alias("f")).select("row", "column", "f.issue", "f.detail")
    both = live.where((F.col("lang") != base) & X.filled(F.col("source")))
    bits = F.concat_ws("; ", *(F.when(F.size(c) > 0, F.concat(F.lit(f"{c} "), F.array_join(c, ", "))) for c in ("missing", "extra")))
    lost = parity(both).select("row", F.col("lang").alias("column"), F.lit("placeholder mismatch").alias("issue"), bits.alias("detail"))
    ratios = both.select("row", "lang", (F.length(X.strip(value)) / F.length(X.strip(F.col("source")))).alias("ratio"))
    far = ratios.join(exact_medians(ratios, "lang", "ratio"), "lang").withColumn("times", F.col("ratio") / F.col("median")).where("times > 4 OR times < 0.25")
    odd = far.select("row", F.col("lang").alias("column"), F.lit("length-ratio outlier").alias("issue"), F.concat(F.format_number("times", 1), F.lit("x the column median")).alias("detail"))
    found = own.union(lost).union(odd)
    if key_column:
        keys = wide.select(F.col(row).cast("long").alias("row"), X.strip(F.col(f"`{key_column}`")).alias("k"))
        twice = duplicates(keys, "k", "row").select("row", F.lit(key_column).alias("column"), F.lit("duplicate key").alias("issue"), F.concat(F.lit("first seen at row "), F.col("first_row")).alias("detail"))
        found = found.union(twice)
    if spellings:
        found = found.union(spark.createDataFrame([(0, ", ".join(cs), "mixed lang-code forms", f"all map to base '{b}'") for b, cs in spellings.items()], found.schema))
    total = cells.groupBy("lang").agg(F.avg(X.filled(value).cast("double")).alias("coverage")).collect()  # a row for each language
    counts = {r.issue: r.n for r in found.groupBy("issue").agg(F.count("*").alias("n")).collect()}
    head = {"key_column": key_column, "languages": langs, "base": base, "coverage": {r.lang: round(r.coverage, 4) for r in total}, "spellings": spellings, "counts": counts, "duplicate_source": repeated_values(wide, base).first().n}
    return head, found
