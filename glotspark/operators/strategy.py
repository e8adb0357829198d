"""Matching strategies held against labelled pairs (id, text, term, gold): predictions, scores, and whether the best is better."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import scores
from .stats import bootstrap_f1, mcnemar

#: A strategy says of a folded text, a folded term and the raw term whether they match.
Strategy = Callable[[Column, Column, Column], Column]


def substring(text: Column, term: Column, raw: Column) -> Column:
    return F.contains(text, term)


def word_boundary(text: Column, term: Column, raw: Column) -> Column:
    """Between word boundaries; CJK terms anywhere."""
    return F.when(X.is_cjk(raw), F.contains(text, term)).otherwise(X.bounded(text, term))


def at_least(least: int) -> Strategy:
    """word_boundary for terms of ``least`` characters and more; shorter ones only if they are CJK."""

    def run(text: Column, term: Column, raw: Column) -> Column:
        return (X.is_cjk(raw) | (F.length(raw) >= least)) & word_boundary(text, term, raw)

    return run


def strategies(least: int = 3) -> dict[str, Strategy]:
    return {"substring": substring, "word_boundary": word_boundary, f"word_boundary+min{least}": at_least(least)}


def is_gold(c: Column) -> Column:
    """The labels that count as yes; fixed values."""
    return F.coalesce(F.trim(c).isin("1", "true", "True", "yes"), F.lit(False))


def predictions(pairs: DataFrame, chosen: dict[str, Strategy]) -> DataFrame:
    """(id, gold, and a boolean for each strategy). An empty term matches under ``substring`` only."""
    raw = X.strip(F.col("term"))
    folded = pairs.select("id", is_gold(F.col("gold")).alias("gold"), X.fold(F.coalesce("text", F.lit(""))).alias("__t"), X.fold(raw).alias("__k"), raw.alias("__raw"))
    return folded.select("id", "gold", *(F.coalesce(f(F.col("__t"), F.col("__k"), F.col("__raw")), F.lit(False)).alias(n) for n, f in chosen.items()))


def confusion(predicted: DataFrame, names: list[str]) -> DataFrame:
    """strategy, tp, fp, fn, tn, prec, recall, f1: one row for each strategy."""
    long = predicted.unpivot(["id", "gold"], names, "strategy", "hit")
    n = lambda e: F.count_if(F.expr(e))
    counts = long.groupBy("strategy").agg(n("hit AND gold").alias("tp"), n("hit AND NOT gold").alias("fp"), n("NOT hit AND gold").alias("fn"), n("NOT hit AND NOT gold").alias("tn"))
    prec, recall, f1 = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("*", prec.alias("prec"), recall.alias("recall"), f1.alias("f1"))


def discordant(predicted: DataFrame, a: str, b: str) -> tuple[int, int, float]:
    """How often only ``a`` is right, how often only ``b``, and the exact two-sided p of that."""
    right = lambda c: F.col(f"`{c}`") == F.col("gold")
    r = predicted.agg(F.count_if(right(a) & ~right(b)).alias("x"), F.count_if(~right(a) & right(b)).alias("y")).first()
    return r.x, r.y, mcnemar(r.x, r.y)


def significance(predicted: DataFrame, names: list[str], draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> dict:
    """Strategies from the best F1 down (ties as given) with their intervals, and the test of the first two."""
    f1 = {r.strategy: r.f1 for r in confusion(predicted, names).collect()}  # a row for each strategy
    ranked = sorted(names, key=lambda n: -f1[n])
    intervals = {n: bootstrap_f1(predicted.select("gold", F.col(f"`{n}`").alias("predicted")), draws, alpha, seed) for n in ranked}
    out = {"n": predicted.count(), "ranked": [{"strategy": n, "f1": f1[n], "low": intervals[n][0], "high": intervals[n][1]} for n in ranked]}
    if len(ranked) > 1:
        only_first, only_second, p = discordant(predicted, *ranked[:2])
        out |= {"only_first": only_first, "only_second": only_second, "p": p, "significant": p < alpha}
    return out
