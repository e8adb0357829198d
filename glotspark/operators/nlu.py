"""Intent data: its specification, balance of classes, and accounts of constrained expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stats import expand

SPEC = "slots map<string,map<string,array<string>>>, intents map<string,map<string,array<string>>>"


def read_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(intent, lang, template) and (slot, lang, value) of a JSON specification of ``intents`` and ``slots`` by language."""
    spec = spark.read.schema(SPEC).json(path, multiLine=True)

    def flat(column: str, outer: str, inner: str) -> DataFrame:
        by = spec.select(F.explode(column).alias(outer, "by")).select(outer, F.explode("by").alias("lang", "all"))
        return by.select(outer, "lang", F.explode("all").alias(inner))

    return flat("intents", "intent", "template"), flat("slots", "slot", "value")


def balance(examples: DataFrame) -> DataFrame:
    """(level, lang, intent, n, thin) of examples (lang, intent): by intent, by language, and by both; a cell is thin under half of the cells' mean."""
    n = examples.groupBy("lang", "intent").agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy())  # a row for each cell
    cells = n.select(F.lit("cell").alias("level"), "lang", "intent", "n", (F.col("n") < 0.5 * mean).alias("thin"))
    none = F.lit(None).cast("string")
    langs = n.groupBy("lang").agg(F.sum("n").alias("n")).select(F.lit("lang").alias("level"), "lang", none.alias("intent"), "n", F.lit(False).alias("thin"))
    intents = n.groupBy("intent").agg(F.sum("n").alias("n")).select(F.lit("intent").alias("level"), none.alias("lang"), "intent", "n", F.lit(False).alias("thin"))
    return cells.union(langs).union(intents)


def all_distinct(names: Sequence[str]) -> str:
    """The SQL condition that the slots' values all differ."""
    return " AND ".join(f"`{a}` <> `{b}`" for i, a in enumerate(names) for b in names[i + 1 :]) or "true"


def node_counts(spark: SparkSession, slots: dict[str, Sequence[str]], constraints: dict[str, str]) -> tuple[int, int, int]:
    """(valid, visited, product): assignments that meet every condition, partial assignments looked at on the way, and the size of the full product.

    ``constraints`` has for a slot the SQL condition that is asked as soon as that slot has a value; each slot's
    choices extend the assignments that held so far.
    """
    visited, product, held = 0, 1, None
    names = list(slots)
    for k, name in enumerate(names):
        product *= len(slots[name])
        visited += (1 if held is None else held) * len(slots[name])
        asked = [constraints[n] for n in names[: k + 1] if n in constraints]
        held = expand(spark, {n: slots[n] for n in names[: k + 1]}, " AND ".join(f"({c})" for c in asked) or "true").count()
    return (1 if held is None else held), visited, product
