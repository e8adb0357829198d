"""A lexicon of concepts (id, broader, domain, pos, labels by language, synonyms): triples, warnings, cycles, order, linking."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .corpus import boundary_matches
from .graph import reachable
from .tables import cut
from .vocabulary import lookup, surfaces


def built(rows: DataFrame, langs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Concepts of a glossary (id, broader, domain, pos, synonyms and a column for each language), and warnings (id, warning).

    Cells are stripped, blank ones null. A row without an id has its first label for one; a row without either is left
    out with a warning; a broader concept that is no concept is another.
    """
    clean = lambda c: F.nullif(X.strip(F.col(c)), F.lit(""))
    named = rows.select(F.coalesce(clean("id"), *(clean(c) for c in langs)).alias("id"), *(clean(c).alias(c) for c in rows.columns if c != "id"))
    concepts = named.where("id IS NOT NULL")
    unnamed = named.where("id IS NULL").select(F.lit(None).cast("string").alias("id"), F.lit("row with no id and no labels skipped").alias("warning"))
    lost = warnings(concepts).select("id", F.concat(F.lit("broader concept "), F.col("broader"), F.lit(" is unresolved")).alias("warning"))
    return concepts, unnamed.union(lost)


def warnings(concepts: DataFrame) -> DataFrame:
    """(id, broader): concepts whose broader concept is not in the table."""
    have = concepts.where(X.filled(F.col("broader"))).select("id", "broader")
    return have.join(concepts.select(F.col("id").alias("broader")), "broader", "left_anti").select("id", "broader")


def triples(concepts: DataFrame, langs: list[str]) -> DataFrame:
    """(s, p, o) of a concept's type, labels, synonyms (separated by ``|``), domain, part of speech and broader concept."""
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rows = [F.struct(F.lit("rdf:type").alias("p"), F.lit("skos:Concept").alias("o"))]
    rows += [F.when(X.filled(F.col(x)), F.struct(F.lit("skos:prefLabel").alias("p"), F.concat(text(F.col(x)), F.lit(f"@{x}")).alias("o"))) for x in langs]
    rows += [F.when(X.filled(F.col(c)), F.struct(F.lit(p).alias("p"), (F.col(c) if c == "broader" else text(F.col(c))).alias("o"))) for c, p in (("domain", "dct:subject"), ("pos", "lexinfo:partOfSpeech"), ("broader", "skos:broader"))]
    other = F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), r"\|"), X.strip), lambda t: t != "")
    alt = F.transform(other, lambda t: F.struct(F.lit("skos:altLabel").alias("p"), text(t).alias("o")))
    return concepts.select(F.col("id").alias("s"), F.explode(F.filter(F.concat(F.array(*rows), alt), lambda t: t.isNotNull())).alias("t")).select("s", "t.p", "t.o")


def cycles(concepts: DataFrame) -> DataFrame:
    """(members): the sorted nodes of each cycle of ``broader``, once.

    By doubling hops: once twice as many hops end at as many nodes, every chain has ended and only cycles are left; once
    twice as wide a window has the same smallest node everywhere, that is the cycle's. So rounds grow with the logarithm
    of the longest chain, and every round moves one row for each node that is left.
    """
    own = concepts.select("id", F.col("broader").alias("up")).where("up IS NOT NULL")
    jump, ends, before = own, own.select("up").distinct().count(), -1
    while ends != before:
        before = ends
        jump = cut(jump.select("id", F.col("up").alias("mid")).join(jump.select(F.col("id").alias("mid"), "up"), "mid").select("id", "up"))
        ends = jump.select("up").distinct().count()
    on = jump.select(F.col("up").alias("id")).distinct()
    low = cut(own.join(on, "id").select("id", "up", F.least("id", "up").alias("low"), F.lit(True).alias("new")))
    while not low.where("new").isEmpty():
        after = low.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("other"))
        low = cut(low.join(after, "up").select("id", F.col("next").alias("up"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("new")))
    return low.groupBy("low").agg(F.array_sort(F.collect_list("id")).alias("members")).select("members")


def leveled(concepts: DataFrame) -> DataFrame:
    """(id, level): 0 without a broader concept in the table, else one more than that; null on and under cycles. Sorted by
    level (nulls last) and id this is a valid order at any size; ``ordered`` is the exact one of small tables."""
    have = concepts.select("id", F.col("broader").alias("up"))
    up = have.join(concepts.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up")
    level = cut(have.join(up.select("id"), "id", "left_anti").select("id", F.lit(0).alias("level")))
    out = level
    while not level.isEmpty():
        level = cut(up.join(level.toDF("up", "level"), "up").select("id", (F.col("level") + 1).alias("level")))
        out = out.union(level)
    return concepts.select("id").join(out, "id", "left")


def descendants(concepts: DataFrame, start: str) -> DataFrame:
    """(id, depth) of all that is narrower than ``start``, by the fewest steps; ``start`` itself only where it is on a cycle."""
    down = concepts.where("broader IS NOT NULL").select(F.col("broader").alias("src"), F.col("id").alias("dst"))
    found = reachable(down, start).toDF("id", "depth")
    around = found.join(down.where(F.col("dst") == start).select(F.col("src").alias("id")), "id").agg((F.min("depth") + 1).alias("depth")).where("depth IS NOT NULL")
    return found.where(F.col("id") != start).union(around.select(F.lit(start).alias("id"), "depth"))


def stats(concepts: DataFrame, langs: list[str]) -> DataFrame:
    """(name, n): concepts, languages in use, triples, broader edges, synonyms, surfaces, and concepts of each domain (``domain:x``)."""
    used = concepts.agg(*(F.count_if(X.filled(F.col(c))).alias(c) for c in langs), F.count("*").alias("concepts"), F.count_if(X.filled(F.col("broader"))).alias("broader"))
    in_use = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in langs), F.lit(0)).cast("long")
    head = used.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("n")) for n, v in (("concepts", F.col("concepts")), ("languages", in_use), ("broader", F.col("broader")))))).alias("r")).select("r.*")
    rows = triples(concepts, langs)
    more = rows.agg(F.count("*").alias("t"), F.count_if(F.col("p") == "skos:altLabel").alias("a")).select(F.explode(F.array(F.struct(F.lit("triples").alias("name"), F.col("t").alias("n")), F.struct(F.lit("synonyms").alias("name"), F.col("a").alias("n")))).alias("r")).select("r.*")
    index = surfaces(concepts, langs).agg(F.lit("surfaces").alias("name"), F.count("*").alias("n"))
    domains = concepts.where(X.filled(F.col("domain"))).groupBy(F.concat(F.lit("domain:"), F.col("domain")).alias("name")).agg(F.count("*").alias("n"))
    return head.union(more).union(index.select("name", "n")).union(domains)


def export(concepts: DataFrame, langs: list[str]) -> DataFrame:
    """(kind, json): a line for each concept with its labels and synonyms, and one for each surface of the index."""
    labels = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, langs)), F.array(*(F.col(c) for c in langs))), lambda _, v: X.filled(v))
    synonyms = F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), r"\|"), X.strip), lambda t: t != "")
    lines = concepts.select(F.lit("concept").alias("kind"), F.to_json(F.struct("id", labels.alias("labels"), "domain", "pos", synonyms.alias("synonyms"), "broader")).alias("json"))
    return lines.union(surfaces(concepts, langs).select(F.lit("surface").alias("kind"), F.to_json(F.struct("surface", "concept")).alias("json")))


def card(concepts: DataFrame, langs: list[str], surface: str) -> str:
    """What the lexicon knows of a surface form, as Markdown."""
    one = concepts.sparkSession.createDataFrame([(surface,)], "query string")
    hit = lookup(one, surfaces(concepts, langs)).join(concepts, F.col("concept") == F.col("id")).first()
    if not hit:
        return f"'{surface}': not in the lexicon"
    lines = [f"# '{surface}': concept `{hit.id}`", "", *(f"- `{c}`: {hit[c]}" for c in langs if hit[c])]
    for name in ("synonyms", "domain", "broader"):
        if hit[name]:
            lines.append(f"- {name}: {hit[name].replace('|', ', ')}")
    return "\n".join(lines) + "\n"


def ordered(concepts: DataFrame, most: int = 1_000_000) -> list[str]:
    """Ids with broader concepts first, the smallest ready id next; what lies on or under cycles follows, sorted.

    The order is sequential, so it is made on the driver; the size is checked first. Larger tables: ``leveled``.
    """
    if concepts.count() > most:
        raise ValueError(f"over {most} concepts; use leveled")
    broader = {r.id: r.broader for r in concepts.select("id", "broader").collect()}
    below: dict[str, list[str]] = {}
    for i, b in broader.items():
        if b in broader:
            below.setdefault(b, []).append(i)
    ready = [i for i, b in broader.items() if b not in broader]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(heapq.heappop(ready))
        for i in below.get(out[-1], ()):
            heapq.heappush(ready, i)
    return out + sorted(broader.keys() - set(out))


def link(texts: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(id, concept, surface): for each text and concept, its longest surface found; Latin surfaces at word boundaries. The glossary's size is checked."""
    low = surfaces.where(X.filled(F.col("surface"))).select("concept", "surface", F.lower("surface").alias("term"))
    hit = boundary_matches(texts, low.select(F.lit(0).alias("ord"), "term")).select("id", "term").distinct().join(low, "term")
    best = hit.groupBy("id", "concept").agg(F.min(F.struct((-F.length("surface")).alias("n"), "surface")).alias("b"))
    return best.select("id", "concept", "b.surface")
