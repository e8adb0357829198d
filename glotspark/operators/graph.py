"""Graph operators: entity clusters, shortest paths, reachability, concept hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .tables import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge (src, dst, ...) in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def clusters(records: DataFrame, key: str, signals: list[str], folded: bool = False) -> DataFrame:
    """(key, cluster): records that share a non-blank signal, directly or through others; cluster is the smallest key.

    With ``folded``, signals that differ in width, case, hyphens or blanks only are the same (see ``text.cluster_fold``).

    Each signal value links its records to the smallest of them, so a value with n records makes n links. Labels take
    the least of their neighbours', then their label's own label, until nothing changes.
    """
    star = None
    for s in signals:
        # The minimum is pre-aggregated and joined back, so that one hot value never meets in one task; long values go by their hash.
        value = X.cluster_fold(F.col(s).cast("string")) if folded else F.col(s).cast("string")
        held = records.where(X.filled(F.col(s).cast("string"))).select(F.col(key).alias("src"), F.sha2(value.cast("binary"), 256).alias("value"))
        least = held.groupBy("value").agg(F.min("src").alias("dst"))
        one = held.join(least, "value").where("src <> dst").select("src", "dst")
        star = one if star is None else star.union(one)
    edges = cut(undirected(star.distinct()))
    labels = cut(records.select(F.col(key).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = edges.join(labels.toDF("dst", "l"), "dst").groupBy("src").agg(F.min("l").alias("l"))
        lower = labels.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("mid"))
        lower = cut(lower)
        jumped = lower.join(lower.select(F.col("node").alias("mid"), F.col("mid").alias("next")), "mid")
        new = cut(jumped.select("node", "old", F.least("mid", "next").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select(F.col("node").alias(key), F.col("label").alias("cluster"))
        labels = new.select("node", "label")


def distances(edges: DataFrame, source, weight: str | None = None) -> DataFrame:
    """(node, cost, parent): the least cost from ``source`` over edges (src, dst, weight); every edge costs 1 without ``weight``.

    Only nodes whose cost fell in the last round are relaxed. Ties go to the smaller parent. A negative weight is an error.
    """
    step = F.col(weight).cast("double") if weight else F.lit(1.0)
    arcs = cut(edges.select("src", "dst", step.alias("w")).where("src IS NOT NULL AND dst IS NOT NULL"))
    if not arcs.where("w < 0").isEmpty():
        raise ValueError("a negative weight")
    kind = arcs.schema["src"].dataType
    known = cut(edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("parent"), F.lit(True).alias("fresh")))
    while not known.where("fresh").isEmpty():
        reached = known.where("fresh").join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("parent"))
        best = reached.groupBy("node").agg(F.min(F.struct("cost", "parent")).alias("b")).select("node", F.col("b.cost").alias("c"), F.col("b.parent").alias("p"))
        both = known.join(best, "node", "full")
        better = F.coalesce(F.col("c") < F.col("cost"), F.col("cost").isNull())
        known = cut(both.select("node", F.when(better, F.col("c")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("p")).otherwise(F.col("parent")).alias("parent"), better.alias("fresh")))
    return known.drop("fresh")


def reachable(edges: DataFrame, source) -> DataFrame:
    """(node, hops) of all nodes that ``source`` reaches, itself included."""
    return distances(edges, source).select("node", F.col("cost").cast("int").alias("hops"))


def path(found: DataFrame, target) -> list | None:
    """The nodes from the source to ``target`` along the parents of ``distances``; None where it isn't reached. Ties went to the smaller parent."""
    row = found.where(F.col("node") == F.lit(target)).first()
    if row is None:
        return None
    out = [row.node]
    while row.parent is not None:  # as many steps as the path has
        row = found.where(F.col("node") == F.lit(row.parent)).first()
        out.append(row.node)
    return out[::-1]


def shortest_path(edges: DataFrame, source, target, weight: str | None = None) -> list | None:
    """The path of the fewest hops, or of the least cost with ``weight``."""
    return path(distances(edges, source, weight), target)


def ancestors(concepts: DataFrame) -> DataFrame:
    """(id, ancestor, depth) along ``broader``, unresolved parents included; a chain stops before a node it has seen."""
    hop = cut(concepts.select("id", "broader").where(X.filled(F.col("broader"))))
    step = cut(hop.where("id <> broader").select("id", F.col("broader").alias("ancestor"), F.array("id", "broader").alias("seen"), F.lit(1).alias("depth")))
    found = step
    while not step.isEmpty():
        nxt = step.join(hop.toDF("ancestor", "up"), "ancestor").where("NOT array_contains(seen, up)")
        step = cut(nxt.select("id", F.col("up").alias("ancestor"), F.array_append("seen", F.col("up")).alias("seen"), (F.col("depth") + 1).alias("depth")))
        found = found.union(step)
    return found.select("id", "ancestor", "depth")


def registered(tags: DataFrame) -> DataFrame:
    """(lang, value): a store from (ord, lang, value) with every value under its normalised tag and under its base language; the last by ord stays."""
    rows = tags.select("ord", F.explode(X.lang_aliases(F.col("lang"))).alias("lang"), "value")
    return rows.groupBy("lang").agg(F.max_by("value", "ord").alias("value"))


def lookup(keys: DataFrame, store: DataFrame) -> DataFrame:
    """(id, lang, value): the store's (lang, value) under the normalised tag, else under its base language, else null."""
    tries = keys.select("id", "lang", F.posexplode_outer(X.lang_aliases(F.col("lang"))).alias("rank", "tag"))
    hit = tries.join(store.select(F.col("lang").alias("tag"), "value"), "tag", "left")
    w = Window.partitionBy("id", "lang").orderBy(F.col("value").isNull(), "rank")
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "lang", "value")


def overlay(base: DataFrame, variants: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` rows with the fields of a matching variant where these are not blank."""
    v = variants.select(key, *(F.when(X.filled(F.col(f)), F.col(f)).alias(f"__{f}") for f in fields))
    return base.join(v, key, "left").select(key, *(F.coalesce(f"__{f}", f).alias(f) for f in fields))


def span_conflicts(spans: DataFrame) -> DataFrame:
    """Overlapping spans (doc, label, start, end) of one document with different labels, earlier span first."""
    a, b = spans.alias("a"), spans.alias("b")
    order = "struct(a.start, a.end, a.label) < struct(b.start, b.end, b.label)"
    on = F.expr(f"a.doc = b.doc AND a.start < b.end AND b.start < a.end AND a.label <> b.label AND {order}")
    return a.join(b, on).select("a.doc", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("label", "start", "end")))
