"""Corpus operators: audit, equity, matching, evaluation, merging, spans, windows, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: A glossary of at most so many terms is tested term by term; a larger one goes through an automaton.
AUTOMATON_FROM = 100
#: A glossary's terms are held by every worker: this many characters is the bound, checked before they are fetched.
MOST_CHARS = 16_000_000
#: What a cross join may broadcast, in rows, by its own count.
MOST_BROADCAST = 100_000


def long_form(wide: DataFrame, key: str | list[str], langs: list[str]) -> DataFrame:
    """(key, lang, value) from one column for each language."""
    return wide.unpivot(key, langs, "lang", "value")


def bounded_broadcast(small: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``small`` marked for broadcast where it has at most ``most`` rows; else as it is, and Spark picks the join."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def coverage(cells: DataFrame) -> DataFrame:
    return cells.groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(X.filled(F.col("value"))).alias("filled"), F.avg(X.filled(F.col("value")).cast("double")).alias("coverage"))


def equity(per_lang: DataFrame) -> DataFrame:
    """coverage by language with the distance from the best and whether it is over 0.10; the input has a row for each language."""
    best = F.max("coverage").over(Window.partitionBy())
    return per_lang.withColumn("behind", best - F.col("coverage")).withColumn("underserved", F.col("behind") > 0.10)


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Second and later rows of each non-blank key, with the row that had it first.

    Only hashes of the key move: the first row of each is found with a partial minimum, so one key that a great many
    rows share is no hot spot. ``order`` is unique.
    """
    marked = rows.where(X.filled(F.col(key))).withColumn("__hash", F.sha2(F.col(key).cast("string").cast("binary"), 256))
    first = marked.groupBy("__hash").agg(F.min(order).alias("first_row"), F.count("*").alias("__n")).where("__n > 1").select("__hash", "first_row")
    return marked.join(first, "__hash").where(F.col(order) > F.col("first_row")).drop("__hash")


def exact_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median) of positive values, exact, by counts of distinct values: no task holds a group's values, only its distinct ones pass a window."""
    counts = rows.where(F.col(value) > 0).groupBy(group, value).agg(F.count("*").alias("n"))
    # Values are dealt over bands by their binary exponent, so that a window sees a band of a group.
    banded = counts.withColumn("band", F.floor(F.log2(F.col(value)) * 8))
    bands = banded.groupBy(group, "band").agg(F.sum("n").alias("m"))
    upward = Window.partitionBy(group).orderBy("band")
    bands = bands.withColumn("before", F.coalesce(F.sum("m").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy(group)))
    # The middle two positions (the same one twice where the number is odd), counted from 0.
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    near = bands.where((F.col("before") <= high) & (F.col("before") + F.col("m") > low)).select(group, "band", "before", "total")
    within = Window.partitionBy(group, "band").orderBy(value)
    placed = banded.join(near, [group, "band"]).withColumn("end", F.col("before") + F.sum("n").over(within)).withColumn("start", F.col("end") - F.col("n"))
    at = lambda p: F.max(F.when((F.col("start") <= p) & (p < F.col("end")), F.col(value)))
    return placed.groupBy(group).agg(((at(low) + at(high)) / 2).alias("median"))


def length_outliers(ratios: DataFrame, group: str, high: float = 4.0, low: float = 0.25) -> DataFrame:
    """Rows whose ratio is over ``high`` or under ``low`` times their group's exact median."""
    medians = exact_medians(ratios, group, "ratio")
    return ratios.join(medians, group).where((F.col("ratio") / F.col("median") > high) | (F.col("ratio") / F.col("median") < low))


def glossary(terms: DataFrame, min_len: int, most_chars: int = MOST_CHARS) -> list[tuple[int, str]]:
    """(ord, term) in order, without empty, short and repeated terms. The size is checked before anything is fetched."""
    kept = terms.where((F.length("term") >= max(1, min_len)))
    size = kept.agg(F.sum(F.length("term"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"a glossary of {size} characters; the bound is {most_chars}")
    first = kept.groupBy("term").agg(F.min("ord").alias("ord"))
    return sorted((r.ord, r.term) for r in first.collect())


def _each(texts: DataFrame, pairs: list[tuple[int, str]], hay: Column, test) -> DataFrame:
    """(id, ord, term) by one constant test on the column ``__hay`` for each term; no join."""
    hits = [F.when(test(t), F.struct(F.lit(o).cast("int").alias("ord"), F.lit(t).alias("term"))) for o, t in pairs]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<struct<ord:int,term:string>>")
    return texts.select("id", hay.alias("__hay")).select("id", F.explode(found).alias("m")).select("id", "m.ord", "m.term")


def substring_matches(texts: DataFrame, terms: DataFrame, min_len: int = 2, case_sensitive: bool = False) -> DataFrame:
    """(id, ord, term): terms contained in texts, without regard to case unless ``case_sensitive``; repeated terms count once, at their first place."""
    pairs = glossary(terms, min_len)
    if len(pairs) > AUTOMATON_FROM:
        return _automaton(texts, pairs, "same" if case_sensitive else "lower", False)
    low = F.col("text") if case_sensitive else F.lower("text")
    return _each(texts, pairs, low, lambda t: F.contains(F.col("__hay"), F.lit(t if case_sensitive else t.lower())))


def boundary_matches(texts: DataFrame, terms: DataFrame, min_len: int = 1, case_sensitive: bool = False) -> DataFrame:
    """As substring_matches, but a term that isn't CJK stands between word boundaries (see ``text.boundary_pattern``)."""
    pairs = glossary(terms, min_len)
    if len(pairs) > AUTOMATON_FROM:
        return _automaton(texts, pairs, "same" if case_sensitive else "lower", True)
    low = F.col("text") if case_sensitive else F.lower("text")
    fold = (lambda t: t) if case_sensitive else str.lower

    def test(t):
        has = F.contains(F.col("__hay"), F.lit(fold(t)))
        return has if X.CJK.search(t) else has & F.col("__hay").rlike(X.boundary_pattern(fold(t)))

    return _each(texts, pairs, low, test)


def automaton_matches(texts: DataFrame, terms: DataFrame, min_len: int = 2, case_sensitive: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, ord, term): terms contained in texts by one pass of an Aho-Corasick automaton. Keys and texts are NFKC and case-folded, so that
    width and case don't count; ``case_sensitive`` compares them as they are. Repeated terms count once, at their first place."""
    return _automaton(texts, glossary(terms, min_len, most_chars), "same" if case_sensitive else "fold", False)


def _automaton(texts: DataFrame, pairs: list[tuple[int, str]], keys: str, at_boundaries: bool) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(pairs)
    batch_bytes = 8 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        key = {"same": str, "lower": str.lower, "fold": X._fold}[keys]
        machine, by_key = ahocorasick.Automaton(), {}
        for place, (o, term) in enumerate(shared.value):
            by_key.setdefault(key(term), []).append((place, o, term))
        for k, held in by_key.items():
            machine.add_word(k, (len(k), at_boundaries and not X.CJK.search(k), held))
        machine.make_automaton()
        for batch in batches:
            ids, ords, found, size = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or not by_key:
                    continue
                text, hits = key(text), {}
                for end, (n, bound, held) in machine.iter(text):
                    if held[0][0] in hits or bound and not X.at_boundary(text, end + 1 - n, end + 1):
                        continue
                    hits.update((p, (o, t)) for p, o, t in held)
                size += len(hits) * 32
                for p in sorted(hits):
                    ids.append(i)
                    ords.append(hits[p][0])
                    found.append(hits[p][1])
                if size > batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ords, pa.int32()), pa.array(found, pa.string())], names=["id", "ord", "term"])
                    ids, ords, found, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ords, pa.int32()), pa.array(found, pa.string())], names=["id", "ord", "term"])

    return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, ord int, term string")


def match(texts: DataFrame, terms: DataFrame, min_len: int = 2, case_sensitive: bool = False) -> DataFrame:
    """The default matcher over many texts: the automaton."""
    return automaton_matches(texts, terms, min_len, case_sensitive)


def find_terms(spark, text: str, terms: DataFrame, min_len: int = 2) -> list[str]:
    """The terms in one text, in glossary order."""
    one = spark.createDataFrame([(0, text)], "id long, text string")
    return [r.term for r in match(one, terms, min_len).orderBy("ord").collect()]


def longest_first(matches: DataFrame) -> DataFrame:
    """Without matches whose term lies within a longer matched term of the same text."""
    all_ = F.collect_list("term").over(Window.partitionBy("id"))
    held = F.exists("all", lambda o: (F.length(o) > F.length("term")) & F.contains(F.lower(o), F.lower(F.col("term"))))
    return matches.withColumn("all", all_).where(~held).drop("all")


def top_k(counts: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """By count, ties to the smaller key."""
    return counts.orderBy(F.desc(n), key).limit(max(k, 0))


def sliding_mean(rows: DataFrame, stream: str, order: list[str], value: str, width: int) -> DataFrame:
    """Mean of each full window of ``width`` rows of a stream."""
    if width <= 0:
        raise ValueError("width must be positive")
    w = Window.partitionBy(stream).orderBy(*order)
    frame = w.rowsBetween(1 - width, 0)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("mean", F.avg(value).over(frame)).where(F.col("place") >= width)


def longest_ok_run(flags: DataFrame, stream: str, place: str, bad: str, most_bad: int) -> DataFrame:
    """(stream, run_length, run_start, run_end): the first widest run with at most ``most_bad`` defects; place counts from 0."""
    ends = flags.groupBy(stream).agg((F.max(place) + 1).alias("n"))
    edges = flags.where(bad).select(stream, F.col(place).alias("at")).union(ends.select(stream, F.lit(-1).cast("int").alias("at")))
    w = Window.partitionBy(stream).orderBy("at")
    runs = edges.withColumn("next", F.lead("at", most_bad + 1).over(w)).join(ends, stream).withColumn("stop", F.coalesce("next", "n"))
    runs = runs.withColumn("run_length", F.col("stop") - F.col("at") - 1)
    best = runs.groupBy(stream).agg(F.max(F.struct(F.col("run_length"), (-F.col("at")).alias("neg"))).alias("b"))
    start = 1 - F.col("b.neg")
    some = F.col("b.run_length") > 0
    return best.select(stream, "b.run_length", F.when(some, start).otherwise(0).alias("run_start"), F.when(some, start + F.col("b.run_length")).otherwise(0).alias("run_end"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc, label, start, end) of one label that touch or overlap, as one."""
    w = Window.partitionBy("doc", "label").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("doc", "label", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_sources(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (source, row_no, key, lang, value): the first non-blank value of each (key, lang), and the later ones that differ."""
    w = Window.partitionBy("key", "lang").orderBy("source", "row_no")
    ranked = cells.where(X.filled(F.col("value"))).withColumn("n", F.row_number().over(w)).withColumn("kept", F.first("value").over(w)).withColumn("kept_source", F.first("source").over(w))
    return ranked.where("n = 1").select("key", "lang", "value", "source"), ranked.where("value <> kept").select("key", "lang", "kept", "kept_source", "value", "source")


def provenance(merged: DataFrame) -> DataFrame:
    """(source, n): how many cells of a merge each source gave."""
    return merged.groupBy("source").agg(F.count("*").alias("n"))


def fold_base(merged: DataFrame) -> DataFrame:
    """A merge with a language without region (``ko``) taken into its locale (``ko-KR``) where the table has one: of several the last by name.

    A cell that the locale has itself stays, and the other's is dropped.
    """
    tags = merged.select("lang").distinct()
    locales = tags.where(F.contains("lang", F.lit("-"))).groupBy(F.split_part("lang", F.lit("-"), F.lit(1)).alias("lang")).agg(F.max("lang").alias("locale"))
    named = merged.join(locales, "lang", "left").withColumn("from_base", F.col("locale").isNotNull() & ~F.contains("lang", F.lit("-")))
    target = F.when(F.col("from_base"), F.col("locale")).otherwise(F.col("lang"))
    rest = [c for c in merged.columns if c not in ("key", "lang")]
    best = named.groupBy("key", target.alias("lang")).agg(F.min(F.struct("from_base", *rest)).alias("b"))
    return best.select("key", "lang", *(F.col(f"b.{c}") for c in rest))


def gram_weights(terms: DataFrame, n: int = 3) -> DataFrame:
    """(gram, idf): ln((1 + terms) / (1 + terms with the gram)) + 1 over padded n-grams of folded, stripped terms (ord, term)."""
    folded = terms.select("ord", X.strip(X.fold(F.col("term"))).alias("key"))
    grams = folded.select("ord", F.explode(F.array_distinct(X.char_ngrams(F.col("key"), n))).alias("gram"))
    total = bounded_broadcast(terms.agg(F.count("*").alias("total")))
    df = grams.groupBy("gram").agg(F.count("*").alias("df")).join(total, F.lit(True))
    return df.select("gram", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


def gram_vectors(rows: DataFrame, key: str, text: str, idf: DataFrame, n: int = 3) -> DataFrame:
    """(key, gram, w): gram counts by weight; grams without a weight are left out."""
    folded = rows.select(key, X.strip(X.fold(F.col(text))).alias("__key"))
    grams = folded.select(key, F.explode(X.char_ngrams(F.col("__key"), n)).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count("*").alias("tf")).join(idf, "gram").select(key, "gram", (F.col("tf") * F.col("idf")).alias("w"))


def cosines(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(a, b, score) of sparse vectors (a, gram, w) and (b, gram, w) that share a gram."""
    norm = lambda v, name: v.groupBy(name).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(f"{name}_norm"))
    dots = left.select(a, "gram", F.col("w").alias("wa")).join(right.select(b, "gram", F.col("w").alias("wb")), "gram").groupBy(a, b).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return dots.join(norm(left, a), a).join(norm(right, b), b).select(a, b, (F.col("dot") / (F.col(f"{a}_norm") * F.col(f"{b}_norm"))).alias("score"))


def fuzzy(queries: DataFrame, terms: DataFrame, n: int = 3) -> DataFrame:
    """(query, ord, term, score) of queries (query) and terms (ord, term) that share a gram: cosine of TF-IDF vectors of character n-grams."""
    idf = gram_weights(terms, n)
    asked = queries.select("query").distinct()
    scored = cosines(gram_vectors(asked, "query", "query", idf, n), "query", gram_vectors(terms, "ord", "term", idf, n), "ord")
    return scored.join(terms.select("ord", "term"), "ord").select("query", "ord", "term", "score")


def fuzzy_match(queries: DataFrame, terms: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """(query, term, score): the best term of each query that reaches ``threshold``; ties go to the first term."""
    best = fuzzy(queries, terms, n).groupBy("query").agg(F.min(F.struct((-F.round("score", 12)).alias("cost"), "ord", "term", "score")).alias("b"))
    return best.select("query", "b.term", "b.score").where(F.col("score") >= threshold)


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """precision, recall and F1; 0 where undefined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)
