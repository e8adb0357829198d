"""Streaming forms of the aggregates; each works on a batch table as on a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X


def tumbling(events: DataFrame, ts: str, value: str, keys: list[str], width: str, late: str = "1 hour") -> DataFrame:
    """(keys, start, n, mean) of event-time windows. On a stream, rows later than ``late`` are dropped and windows leave the state."""
    return events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*keys, F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """(keys, start, n) of sessions that end after ``gap`` without an event."""
    return events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def coverage(cells: DataFrame) -> DataFrame:
    """Coverage by language, in update or complete mode."""
    return cells.groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(X.filled(F.col("value"))).alias("filled"), F.avg(X.filled(F.col("value")).cast("double")).alias("coverage"))


def moments(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, variance, deviation) of the sample so far, in update or complete mode: Spark's own mergeable moments."""
    return events.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"))


def zscores(rows: DataFrame, known: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with zscore against ``moments``; 0 without a deviation. For a batch of a stream, in ``foreachBatch``."""
    z = F.when(F.col("deviation") > 0, (F.col(value) - F.col("mean")) / F.col("deviation")).otherwise(0.0)
    return rows.join(known.select(*keys, "mean", "deviation"), keys, "left").withColumn("zscore", z).drop("mean", "deviation")


def top_terms(terms: DataFrame, term: str, k: int) -> DataFrame:
    """The ``k`` most frequent terms so far, ties to the smaller; complete mode on a stream."""
    return terms.groupBy(term).agg(F.count("*").alias("n")).orderBy(F.desc("n"), term).limit(max(k, 0))


def _ordered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable")


def row_means(events: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """(key, place, mean): the mean of each full window of ``width`` rows of a key, as rows come. State: the last rows of each key.

    Rows are in order within a micro-batch; those of a later one come after.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    kind = events.schema[key].dataType

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, last = state.get if state.exists else (0, [])
        values = [*last, *_ordered(batches, order)[value].astype(float).tolist()]
        full = range(width, len(values) + 1)
        first = place - len(last)
        yield pd.DataFrame({"key": [k[0]] * len(full), "place": [first + end for end in full], "mean": [math.fsum(values[end - width : end]) / width for end in full]})
        state.update((first + len(values), values[len(values) - min(len(values), width - 1) :]))

    out = T.StructType([T.StructField("key", kind), T.StructField("place", T.LongType()), T.StructField("mean", T.DoubleType())])
    return events.groupBy(key).applyInPandasWithState(step, out, "place long, last array<double>", "append", GroupStateTimeout.NoTimeout)


def reservoir(events: DataFrame, key: str, item: str, k: int, seed: int = 0) -> DataFrame:
    """(key, items): a uniform sample of ``k`` distinct items of each key, after every batch. State: the k items of the smallest hashes, so that order and retries don't matter."""
    kind = events.schema[key].dataType
    marked = events.select(key, F.col(item).cast("string").alias("item"), F.xxhash64(item, F.lit(seed)).alias("mark"))

    def step(g: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marks, items = state.get if state.exists else ([], [])
        held = dict(zip(items, marks, strict=True))
        for batch in batches:
            held.update(zip(batch["item"], batch["mark"].astype(int), strict=True))
            held = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:k])
        state.update((list(held.values()), list(held)))
        yield pd.DataFrame({"key": [g[0]], "items": [sorted(held)]})

    out = T.StructType([T.StructField("key", kind), T.StructField("items", T.ArrayType(T.StringType()))])
    return marked.groupBy(key).applyInPandasWithState(step, out, "marks array<long>, items array<string>", "update", GroupStateTimeout.NoTimeout)


def ok_runs(events: DataFrame, key: str, order: list[str], bad: str, most_bad: int) -> DataFrame:
    """(key, run_length, run_start, run_end): the first widest run so far with at most ``most_bad`` defects, after every batch. State: the places of the last defects."""
    kind = events.schema[key].dataType

    def step(g: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, best, start, defects = state.get if state.exists else (0, 0, 0, [])
        defects = list(defects)
        for is_bad in _ordered(batches, order)[bad].astype(bool):
            if is_bad:
                defects = [*defects, place][-most_bad - 1 :]
            place += 1
            low = defects[0] + 1 if len(defects) > most_bad else 0
            if place - low > best:
                best, start = place - low, low
        state.update((place, best, start, defects))
        yield pd.DataFrame({"key": [g[0]], "run_length": [best], "run_start": [start if best else 0], "run_end": [start + best if best else 0]})

    out = T.StructType([T.StructField("key", kind), *(T.StructField(n, T.LongType()) for n in ("run_length", "run_start", "run_end"))])
    return events.groupBy(key).applyInPandasWithState(step, out, "place long, best long, start long, defects array<long>", "update", GroupStateTimeout.NoTimeout)
