"""Term lookup: prefixes, membership, longest prefix, exact and nearest terms, and cross-lingual surfaces. Terms are (ord, term)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def folded(terms: DataFrame) -> DataFrame:
    """Terms with ``key``, their folded form; of terms with one key the last counts, as where terms are stored by key. Empty keys are left out."""
    keyed = terms.select("ord", "term", X.fold(F.col("term")).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.max(F.struct("ord", "term")).alias("b")).select("b.ord", "b.term", "key")


def with_prefix(prefixes: DataFrame, terms: DataFrame) -> DataFrame:
    """(prefix, term): all terms that begin with each of ``prefixes`` (prefix), folded; an empty prefix has all.

    An equi-join: a term meets the prefixes of its own first characters, of the lengths that are asked for only.
    """
    asked = prefixes.select("prefix", X.fold(F.col("prefix")).alias("start")).distinct()
    lengths = sorted(r.n for r in asked.select(F.length("start").alias("n")).where("n IS NOT NULL").distinct().collect())
    cuts = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    own = folded(terms).withColumn("n", F.explode(F.filter(cuts, lambda n: n <= F.length("key")))).select("term", F.expr("left(key, n)").alias("start"))
    return asked.join(own, "start").select("prefix", "term")


def members(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``texts`` (id, text) with ``known``: whether the folded text is a term."""
    keys = folded(terms).select(F.col("key").alias("__key"), F.lit(True).alias("__hit"))
    held = texts.withColumn("__key", X.fold(F.col("text"))).join(keys, "__key", "left")
    return held.withColumn("known", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def longest_prefix(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term): the longest term that the folded text (id, text, start) begins with at ``start``, or null. Places are those of the folded text."""
    keys = folded(terms)
    lengths = F.array_sort(F.collect_set(F.length("key")))
    sizes = keys.agg(lengths.alias("sizes")).first().sizes  # one number for each length of a term
    rest = texts.select("id", F.expr("substring(f, start + 1)").alias("rest")) if "f" in texts.columns else texts.withColumn("f", X.fold(F.col("text"))).select("id", F.expr("substring(f, start + 1)").alias("rest"))
    cuts = F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")
    tried = rest.withColumn("n", F.explode_outer(F.filter(cuts, lambda n: n <= F.length("rest")))).withColumn("key", F.expr("left(rest, n)"))
    return tried.join(keys.select("key", "term"), "key", "left").groupBy("id").agg(F.max_by("term", F.when(F.col("term").isNotNull(), F.col("n"))).alias("term"))


def closest(queries: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """(query, term, distance): the nearest term within ``most`` edits, folded; ties go to the first term.

    Candidates come from equi-joins, not from all pairs: two strings within ``most`` edits of one another, cut into
    ``most + 1`` pieces, share a piece at a place that differs by at most ``most``. The distance is then exact.
    """
    asked = queries.select("query", X.fold(F.col("query")).alias("q")).distinct()
    known = terms.select("ord", "term", X.fold(F.col("term")).alias("t"))
    k = most + 1
    # A term's pieces: the first ones are longer by one where its length isn't divisible.
    cut = F.expr(f"transform(sequence(0, {k - 1}), i -> struct(i AS piece, length(t) AS n, cast(i * (length(t) div {k}) + least(i, length(t) % {k}) AS int) AS at, cast(length(t) div {k} + int(i < length(t) % {k}) AS int) AS size))")
    pieces = known.withColumn("p", F.explode(cut)).select("ord", "term", "t", "p.piece", "p.n", F.expr("substring(t, p.at + 1, p.size)").alias("gram"))
    # What a query could hold of a term of each near length, piece by piece and shift by shift.
    near = asked.withColumn("n", F.explode(F.expr(f"sequence(greatest(0, length(q) - {most}), length(q) + {most})"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    placed = near.selectExpr("query", "q", "n", "piece", f"cast(piece * (n div {k}) + least(piece, n % {k}) AS int) AS at", f"cast(n div {k} + int(piece < n % {k}) AS int) AS size")
    probes = placed.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).where("at + shift >= 0 AND at + shift + size <= length(q)")
    probes = probes.select("query", "q", "n", "piece", F.expr("substring(q, at + shift + 1, size)").alias("gram")).distinct()
    met = probes.join(pieces, ["n", "piece", "gram"]).select("query", "q", "ord", "term", "t").distinct()
    d = met.withColumn("distance", X.bounded_distance(F.col("q"), F.col("t"), most)).where(F.col("distance") <= most)
    best = d.groupBy("query").agg(F.min(F.struct("distance", "ord", "term")).alias("b"))
    return best.select("query", "b.term", "b.distance")


def surfaces(concepts: DataFrame, langs: list[str]) -> DataFrame:
    """(surface, concept): each label and synonym (separated by ``|``), stripped and lower-cased; of several concepts the last by id has it."""
    labels = F.array(*(F.col(c) for c in langs))
    other = F.split(F.coalesce("synonyms", F.lit("")), r"\|")
    named = concepts.select(F.col("id").alias("concept"), F.explode(F.concat(labels, other)).alias("s")).select(F.lower(X.strip(F.col("s"))).alias("surface"), "concept")
    return named.where("surface <> ''").groupBy("surface").agg(F.max("concept").alias("concept"))


def lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, concept): the concept that a surface of any language names, or null."""
    asked = queries.select("query", F.lower(X.strip(F.col("query"))).alias("surface"))
    return asked.join(index, "surface", "left").select("query", "concept")
