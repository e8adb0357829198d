"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

A source's target is its weight's share of the budget, held to ``limit`` times its size,
with the excess reshared by weight until no source is above. Every document of a source
expects the same number of copies, target / source size. Expected copies are summed over
the source's documents, ordered by size class, one random offset a source is added, and a
copy is emitted at each integer boundary that the sum crosses. As the order is by size,
each source's words come near its target too; no document has over ``limit`` copies.

The prefix sum is two-level, so that no task holds a source: each size class of a source is
split by a hash of id and text into as many chunks as its count asks for (of about
CHUNK_ROWS documents), the prefix sums of the classes' and the chunks' counts give each chunk
its first rank, and ranks within a chunk are a window over the chunk alone. Only the sources
themselves (a row each) meet in one task.

Defined results: null text has size 0; the null source is a source of its own, ordered
last; sources of size 0 have target 0 and documents of size 0 follow their source's rate;
repeated rows are documents of their own; rows with equal ids keep their order by size;
an empty table gives an empty result; input columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
CHUNK_ROWS = 1 << 10
SEED = 17


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none. A word ends at a blank or at the end."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _offset(seed: int) -> Column:
    """One random number from 0 to 1 for each source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_size and target from one row (source, source_size) for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * limit)
    # Sources reach their caps in the order of cap / weight; before each, the level at which the rest would stand.
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.greatest(F.lit(0.0), F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    room = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", rest / room)
    # The first source whose cap holds its level has the right one, and no later level is above it.
    free = F.max(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))).over(everything)
    return leveled.select("source", "source_size", F.when(free.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * free)).alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, chunk_rows: int = CHUNK_ROWS, seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target and copies."""
    width = F.greatest(F.length(F.bin("size")) - 4, F.lit(0))
    id_, body = F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    mark = F.conv(F.substring(F.md5(F.concat(id_, F.lit(":"), F.md5(body))), 1, 15), 16, 10).cast("long")
    sized = saved(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), mark.alias("mark")), "mix-sizes")
    class_ = (width * 16 + F.call_function("shiftright", F.col("size"), width)).cast("int")
    sized = sized.withColumn("class", class_)
    parts = sized.groupBy("source", "class").agg(F.ceil(F.count("*") / chunk_rows).alias("parts"))
    sized = sized.alias("d").join(parts.alias("p"), F.expr("d.source <=> p.source AND d.class = p.class")).select("d.*", F.pmod("mark", "parts").alias("split"))
    chunks = sized.groupBy("source", "class", "split").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sums = targets(chunks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    # First ranks in two steps: of a source's classes, and of a class's chunks.
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    classes = chunks.groupBy("source", "class").agg(F.sum("n").alias("n")).select("source", "class", upto("n", earlier("source").orderBy("class")).alias("first"))
    within = chunks.select("source", "class", "split", upto("n", earlier("source", "class").orderBy("split")).alias("place"))
    starts = within.alias("w").join(classes.alias("k"), F.expr("w.source <=> k.source AND w.class = k.class")).select("w.source", "w.class", "w.split", (F.col("first") + F.col("place")).alias("before"))
    starts = starts.alias("c").join(sums.alias("s"), F.expr("c.source <=> s.source")).select("c.source", "c.class", "c.split", "before", "source_size", "target")
    within = Window.partitionBy("source", "class", "split").orderBy("size", "doc_id", "mark")
    ranked = sized.withColumn("rank", F.row_number().over(within))
    joined = ranked.alias("d").join(starts.alias("p"), F.expr("d.source <=> p.source AND d.class = p.class AND d.split = p.split"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("before") + F.col("rank")
    crossed = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    return (
        joined.select("doc_id", "d.source", "size", "source_size", "target", "before", "rank", rate.alias("rate"))
        .withColumn("offset", _offset(seed))
        .select("doc_id", "source", "size", "source_size", "target", crossed.cast("int").alias("copies"))
    )


def mix(docs: DataFrame, planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as ``planned`` says, with copy_no from 1. Ids must be unique here."""
    copies = planned.where("copies > 0").select(F.col("doc_id").alias(key), "copies")
    return docs.drop("copies", "copy_no").join(copies, key).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def result(planned: DataFrame) -> DataFrame:
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS mark FROM {{docs}}),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, {LIMIT}.0::DOUBLE * source_size AS cap FROM sums),
leveled AS (
  SELECT *, greatest(0.0::DOUBLE, (SELECT sum(source_size) FROM sums) * {SHARE}::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (
  SELECT source, source_size, CASE WHEN free IS NULL THEN cap ELSE least(cap, weight * free) END AS target,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM leveled, (SELECT max(level) AS free FROM leveled WHERE cap >= weight * level)),
classed AS (SELECT *, greatest(length(bin(size)) - 4, 0) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM sized),
split AS (SELECT *, mark % CAST(ceil(count(*) OVER (PARTITION BY source, class) / {{chunk}}.0) AS BIGINT) AS split FROM classed),
placed AS (
  SELECT d.doc_id, d.size, t.*, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.class, d.split, d.size, d.doc_id NULLS FIRST, d.mark) AS place
  FROM split d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CAST(floor(place * rate + u) - floor((place - 1) * rate + u) AS INTEGER) AS copies FROM placed)
"""
SQL = ORACLE.format(docs="documents", chunk=CHUNK_ROWS) + "SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted"
