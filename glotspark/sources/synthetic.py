"""Made-up tables of any size, the same for the same seed: rows come from hashes of their numbers, so nothing is made on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 for each row."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def corpus(spark: SparkSession, n: int, langs: list[str], filled: float = 0.8, seed: int = 0) -> DataFrame:
    """(key, one column for each language): the first is always filled, the others in a share of the rows."""
    cells = [F.when(F.lit(k == 0) | (draw(seed + k, F.col("id")) < filled), F.concat(F.lit(f"{lang} text "), F.col("id").cast("string"))).otherwise("").alias(lang) for k, lang in enumerate(langs)]
    return spark.range(n).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), *cells)


def ratios(spark: SparkSession, n: int, mean: float = 1.0, spread: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, ratio): a sum of twelve draws, close to a normal distribution."""
    total = sum((draw(seed + k, F.col("id")) for k in range(12)), F.lit(0.0))
    return spark.range(n).select("id", (F.lit(mean) + spread * (total - 6)).alias("ratio"))


def terms(spark: SparkSession, n: int) -> DataFrame:
    """(ord, term): distinct terms."""
    return spark.range(n).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("term"), F.lower(F.hex("id"))).alias("term"))


def segments(spark: SparkSession, n: int, n_terms: int, words: int = 12, seed: int = 0) -> DataFrame:
    """(id, text): texts of which about one word in four is a term."""
    word = lambda i: F.when(draw(seed, F.col("id"), i) < 0.25, F.concat(F.lit("term"), F.lower(F.hex(F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(n_terms)))))).otherwise(F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("id"), i), F.lit(5000)).cast("string")))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " ").alias("text"))


def shards(spark: SparkSession, n: int, k: int) -> list[DataFrame]:
    """``k`` sorted shards (value) that interleave: shard i has i, i + k, i + 2k, ..."""
    return [spark.range(i, n, k).toDF("value") for i in range(k)]


def intents(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, tokens, label): short texts of two classes, whose words overlap."""
    label = F.pmod(F.col("id"), F.lit(2)).cast("int")
    word = lambda i: F.when(draw(seed, F.col("id"), i) < 0.4, F.concat(F.when(F.pmod(F.col("id"), F.lit(2)) == 0, "buy").otherwise("sell"), F.pmod(F.xxhash64("id", i), F.lit(20)).cast("string"))).otherwise(F.concat(F.lit("common"), F.pmod(F.xxhash64(i, "id", F.lit(seed)), F.lit(50)).cast("string")))
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), word).alias("tokens"), label.alias("label"))
