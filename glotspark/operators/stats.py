"""Evaluation statistics, thresholds, naive Bayes on noisy labels, and slot expansion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import bounded_broadcast
from .tables import cut

def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p of ``b`` against ``c`` discordant pairs; 1 without any."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


def bootstrap_f1(pairs: DataFrame, draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile interval of F1 over (gold, predicted) booleans.

    A resample of the rows is a multinomial draw of the four outcomes' counts, so only these four counts leave Spark.
    """
    import numpy as np

    r = pairs.agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "gold AND predicted"), ("fp", "NOT gold AND predicted"), ("fn", "gold AND NOT predicted"), ("tn", "NOT gold AND NOT predicted")))).first()
    n = sum(r)
    if not n:
        return 0.0, 0.0
    tp, fp, fn, _ = np.random.default_rng(seed).multinomial(n, np.array(r) / n, size=draws).T
    f1 = np.sort(np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0))
    return float(f1[int(alpha / 2 * draws)]), float(f1[min(int((1 - alpha / 2) * draws), draws - 1)])


def bootstrap_rows(pairs: DataFrame, draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """As ``bootstrap_f1``, by drawing rows: every resample draws as many rows of (id, gold, predicted) as there are, by a hash of resample, place and seed."""
    numbered = pairs.withColumn("at", F.row_number().over(Window.orderBy("id")) - 1) if "at" not in pairs.columns else pairs
    n = numbered.count()
    if not n:
        return 0.0, 0.0
    drawn = pairs.sparkSession.range(draws * n).select((F.col("id") % draws).alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int").alias("at"))
    hits = drawn.groupBy("draw", "at").agg(F.count("*").alias("times")).join(numbered.select("at", "gold", "predicted"), "at")
    part = lambda e: F.sum(F.when(F.expr(e), F.col("times")).otherwise(0))
    counts = hits.groupBy("draw").agg(part("gold AND predicted").alias("tp"), part("gold <> predicted").alias("wrong"))
    f1 = counts.select(F.when(F.col("tp") + F.col("wrong") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("wrong"))).otherwise(0.0).alias("f1"))
    found = sorted(r.f1 for r in f1.collect())  # a row for each draw
    return found[int(alpha / 2 * draws)], found[min(int((1 - alpha / 2) * draws), draws - 1)]


def reached(scores: DataFrame, score: str, at: float) -> int:
    """How many rows reach a score."""
    return scores.agg(F.count_if(F.col(score) >= at)).first()[0]


def inclusion_rates(n: int, k: int, trials: int, spark, seed: int = 0) -> DataFrame:
    """(item, rate): how often each of ``n`` items is in a sample of ``k`` by hash, over ``trials`` seeds; k / n for a fair sample."""
    rows = spark.range(n * trials).select((F.col("id") % n).alias("item"), F.expr(f"id div {n}").alias("trial"))
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(F.xxhash64("item", "trial", F.lit(seed)), "item"))
    return rows.withColumn("rank", rank).groupBy("item").agg((F.count_if(F.col("rank") <= k) / trials).alias("rate"))


def noise_sweep(rows: DataFrame, rates: Sequence[float], seed: int = 0) -> DataFrame:
    """(rate, accuracy) of naive Bayes trained on rows (id, tokens, label 0/1) of which a share has its label turned over; the test rows stay clean.

    Rows are split 70 to 30 by a hash of their ids. The same rows are turned over in every run, and those of a lower rate at every higher one.
    """
    part = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10))
    train, test = rows.where(part < 7), rows.where(part >= 7)
    out = None
    for rate in rates:
        guess = bayes_predict(flipped(train, "label", "id", rate, seed).select("label", "tokens"), test.select("id", "tokens"))
        one = test.join(guess, "id").agg(F.lit(float(rate)).alias("rate"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
        out = one if out is None else out.union(one)
    return out


def merged_shards(shards: list[DataFrame], key: str | Column) -> DataFrame:
    """The rows of sorted shards in one order: by ``key``, ties by shard and by the place within it. A range partitioning and an external sort."""
    out = None
    for k, shard in enumerate(shards):
        one = shard.withColumn("shard", F.lit(k)).withColumn("place", F.monotonically_increasing_id())
        out = one if out is None else out.unionByName(one)
    return out.orderBy(key, "shard", "place")


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of an ordered table with their number in it from 1, without one window over all: by their number in their partition and the rows of the partitions before.

    The partitions are written first: sampling sets the bounds of a range partitioning, so that another run of the same plan deals rows otherwise.
    """
    part = F.spark_partition_id()
    rows = cut(ordered.select("*", part.alias("__part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("__n")))
    counts = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}  # a row for each partition
    before = [0]
    for k in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(k, 0))
    starts = F.array(*(F.lit(n).cast("long") for n in before))
    return rows.withColumn(name, starts[F.col("__part")] + F.col("__n") + 1).drop("__part", "__n")


def budget_threshold(scores: DataFrame, group: str, score: str, budget: int) -> DataFrame:
    """(group, threshold): the smallest score of the group that at most ``budget`` of its rows reach; groups without one are left out."""
    counts = scores.groupBy(group, score).agg(F.count("*").alias("n"))
    upward = Window.partitionBy(group).orderBy(F.desc(score))
    return counts.withColumn("reach", F.sum("n").over(upward)).where(F.col("reach") <= budget).groupBy(group).agg(F.min(score).alias("threshold"))


def flipped(rows: DataFrame, label: str, key: str, rate: float, seed: int = 0) -> DataFrame:
    """Rows with a 0/1 label turned over where the hash of the key falls under ``rate``: the same rows in every run."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return rows.withColumn(label, F.when(draw < rate, 1 - F.col(label)).otherwise(F.col(label)))


def bayes_scores(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, label, logp) of ``test`` (id, tokens) for each label of ``train`` (label, tokens): Laplace-smoothed multinomial naive Bayes."""
    priors = train.groupBy("label").agg(F.count("*").alias("docs"))
    words = train.select("label", F.explode("tokens").alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))
    size = words.agg(F.count_distinct("token").alias("v"))
    totals = priors.join(words.groupBy("label").agg(F.sum("n").alias("total")), "label", "left")
    one = lambda df: df.select("*", F.lit(1).alias("__one"))
    model = bounded_broadcast(one(totals).join(one(size), "__one").join(one(priors.agg(F.sum("docs").alias("all_docs"))), "__one").drop("__one"))
    # Every token weighs ln(1 / (total + v)); a known one adds ln(n + 1), so only hits are joined.
    hits = test.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("times")).join(words, "token")
    gain = hits.groupBy("id", "label").agg(F.sum(F.col("times") * F.log(F.col("n") + 1.0)).alias("gain"))
    rows = test.select("id", F.size("tokens").alias("length")).join(model, F.lit(True)).join(gain, ["id", "label"], "left")
    logp = F.log(F.col("docs") / F.col("all_docs")) - F.col("length") * F.log(F.coalesce("total", F.lit(0)) + F.col("v").cast("double")) + F.coalesce("gain", F.lit(0.0))
    return rows.select("id", "label", logp.alias("logp"))


def bayes_predict(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, predicted): the likeliest label; ties go to the smaller."""
    best = bayes_scores(train, test).groupBy("id").agg(F.min(F.struct((-F.col("logp")).alias("cost"), "label")).alias("b"))
    return best.select("id", F.col("b.label").alias("predicted"))


def expand(spark, slots: dict[str, Sequence[str]], constraint: str = "true") -> DataFrame:
    """Every assignment of the slots that meets a SQL condition on them. Catalyst puts each part of it at the earliest slot it can."""
    out = None
    for name, values in slots.items():
        one = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
        out = one if out is None else out.join(F.broadcast(one), F.lit(True))  # literals of the plan
    return out.where(constraint)


def fill_templates(templates: DataFrame, values: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Examples (intent, lang, template, text, spans) of templates with any number of ``{slot}``, at most ``most`` for each template.

    Every combination of the slots' values (slot, lang, value) in the template's language; a slot named twice has one
    value. Templates without values for a slot are left out. spans has (slot, start, end) of each value in the text,
    in code points, known from the template's pieces.
    """
    found = templates.withColumn("__names", F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1))).withColumn("__slots", F.array_distinct("__names"))
    full = found.withColumn("__values", F.array().cast("array<string>"))
    deepest = found.agg(F.max(F.size("__slots"))).first()[0] or 0
    for k in range(deepest):
        has = F.size("__slots") > k
        given = values.select(F.col("slot").alias("__slot"), F.col("lang").alias("__lang"), F.col("value").alias("__value"))
        more = full.where(has).join(given, (F.get("__slots", F.lit(k)) == F.col("__slot")) & (F.col("lang") == F.col("__lang")))
        full = full.where(~has).unionByName(more.withColumn("__values", F.array_append("__values", F.col("__value"))).select(full.columns))
    parts = "transform(__names, (n, i) -> struct(n AS slot, __values[CAST(array_position(__slots, n) - 1 AS INT)] AS value, __pieces[i + 1] AS after))"
    start = "struct(__pieces[0] AS text, CAST(array() AS array<struct<slot:string,start:int,end:int>>) AS spans)"
    grown = "struct(a.text || p.value || p.after AS text, array_append(a.spans, struct(p.slot AS slot, char_length(a.text) AS start, char_length(a.text) + char_length(p.value) AS end)) AS spans)"
    built = full.withColumn("__pieces", F.split("template", r"\{\w+\}", -1)).withColumn("__made", F.expr(f"aggregate({parts}, {start}, (a, p) -> {grown})"))
    out = built.select("intent", "lang", "template", F.col("__made.text").alias("text"), F.col("__made.spans").alias("spans"))
    w = Window.partitionBy("intent", "lang", "template").orderBy(F.xxhash64("text", F.lit(seed)), "text")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
