"""Registered queries of lexicons, merges, registers, posts and intent data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import corpus as C
from ..operators import graph as G
from ..operators import lexicon as L
from ..operators import nlu as N
from ..operators import posts as P
from ..operators import vocabulary as V
from ..sources import sinks
from .extra import _LEXICON, _lexicon
from .more import _EDGES, _GLOSSARY, _IN, _edges
from .registry import _SOURCES, TERMS, query, read, texts

_L = f"c AS ({_LEXICON.format(text='VARCHAR')})"
_SURFACES = "s AS (SELECT surface, max(id) AS concept FROM (SELECT lower(trim(en)) AS surface, id FROM c UNION ALL SELECT lower(trim(ko)), id FROM c UNION ALL SELECT lower(trim(unnest(string_split(synonyms, '|')))), id FROM c) WHERE surface <> '' GROUP BY surface)"


@query(f"WITH {_L}, {_SURFACES} SELECT p_partkey, s.concept FROM part LEFT JOIN s ON s.surface = lower(trim(CASE WHEN p_size % 3 = 0 THEN ' ' || upper(p_name) ELSE p_type || p_size END))")
def surface_lookup(spark, sf_dir):
    asked = read(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN ' ' || upper(p_name) ELSE p_type || p_size END").alias("query"))
    found = V.lookup(asked.select("query").distinct(), V.surfaces(_lexicon(spark, sf_dir), ["en", "ko"]))
    return asked.join(found, "query", "left").select("p_partkey", "concept")


@query(
    f"WITH {_L}, {_SURFACES} SELECT 'concepts' AS name, count(*) AS n FROM c UNION ALL SELECT 'languages', 2 UNION ALL SELECT 'broader', count(broader) FROM c UNION ALL SELECT 'triples', count(*) * 4 + count(broader) + count(*) FILTER (WHERE ko <> ' ') FROM c UNION ALL SELECT 'synonyms', count(*) FROM c UNION ALL SELECT 'surfaces', count(*) FROM s UNION ALL SELECT 'domain:' || domain, count(*) FROM c GROUP BY domain"
)
def lexicon_stats(spark, sf_dir):
    return L.stats(_lexicon(spark, sf_dir), ["en", "ko"])


#: A hierarchy with cycles: of every 50 parts the first four point at one another in a ring, the rest hang under them.
_RINGS = "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 50 < 4 THEN CAST(p_partkey - p_partkey % 50 + (p_partkey % 50 + 1) % 4 AS VARCHAR) WHEN p_partkey % 50 < 30 THEN CAST(p_partkey - 1 AS VARCHAR) END AS broader FROM part"


def _rings(spark, sf_dir):
    return spark.sql(_RINGS.replace("FROM part", "FROM {part}").replace("VARCHAR", "STRING"), part=read(spark, sf_dir, "part"))


@query("SELECT array_to_string(list(CAST(p_partkey AS VARCHAR) ORDER BY CAST(p_partkey AS VARCHAR)), ',') AS members FROM part WHERE p_partkey % 50 < 4 GROUP BY p_partkey // 50")
def lexicon_cycles(spark, sf_dir):
    return L.cycles(_rings(spark, sf_dir)).select(F.array_join("members", ",").alias("members"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 50 >= 30 THEN 0 END AS level FROM part")
def lexicon_levels(spark, sf_dir):
    return L.leveled(_rings(spark, sf_dir))


@query(f"WITH RECURSIVE r AS ({_RINGS}), d(id, depth) AS (SELECT id, 1 FROM r WHERE broader = '1' UNION SELECT r.id, d.depth + 1 FROM d JOIN r ON r.broader = d.id WHERE d.depth < 60) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY id")
def narrower_concepts(spark, sf_dir):
    return L.descendants(_rings(spark, sf_dir), "1")


_NAMED = "SELECT 'c' || CAST(i % 4 AS VARCHAR) AS concept, t AS surface FROM (VALUES {}) v(i, t)"


@query(
    f"WITH v AS ({_NAMED.format(', '.join(f'({i}, {t!r})' for i, t in enumerate(TERMS)))}), h AS (SELECT d.doc_id AS id, v.concept, v.surface, row_number() OVER (PARTITION BY d.doc_id, v.concept ORDER BY length(v.surface) DESC, v.surface) AS n FROM documents d, v WHERE regexp_matches(lower(d.text), '(^|[^\\p{{L}}\\p{{N}}_])' || v.surface || '([^\\p{{L}}\\p{{N}}_]|$)')) SELECT id, concept, surface FROM h WHERE n = 1"
)
def linked_entities(spark, sf_dir):
    named = spark.createDataFrame([(f"c{i % 4}", t) for i, t in enumerate(TERMS)], "concept string, surface string")
    return L.link(texts(spark, sf_dir), named)


@query(
    f"WITH RECURSIVE e AS ({_EDGES}), p(node, cost, hops) AS (SELECT 0, 0.0::DOUBLE, 0 UNION SELECT e.dst, p.cost + e.w, p.hops + 1 FROM p JOIN e ON e.src = p.node WHERE p.hops < 24 AND p.cost < 60), d AS (SELECT node, min(cost) AS cost FROM p GROUP BY node), "
    "u AS (SELECT d.node, min(e.src) AS parent FROM d JOIN e ON e.dst = d.node JOIN d f ON f.node = e.src WHERE f.cost + e.w = d.cost AND d.node <> 0 GROUP BY d.node), b(node, back) AS (SELECT 12, 0 UNION ALL SELECT u.parent, b.back + 1 FROM b JOIN u ON u.node = b.node) SELECT CAST(max(back) OVER () - back AS BIGINT) AS step, CAST(node AS BIGINT) AS node FROM b"
)
def cheapest_path(spark, sf_dir):
    found = G.shortest_path(_edges(spark, sf_dir), 0, 12, "w")
    return spark.createDataFrame(list(enumerate(found)), "step long, node long")


_BASES = f"SELECT source, row_no, key, CASE WHEN lang = 'ko' AND row_no % 2 = 0 THEN 'ko-KR' WHEN lang = 'en' AND row_no % 3 = 0 THEN 'en-US' ELSE lang END AS lang, value FROM ({_SOURCES})"
_MERGED = f"m AS (SELECT key, lang, value, source FROM (SELECT *, row_number() OVER (PARTITION BY key, lang ORDER BY source, row_no) AS n FROM ({_BASES}) WHERE trim(value) <> '') WHERE n = 1)"


def _merged(spark, sf_dir):
    rows = spark.sql(_BASES.replace("FROM part", "FROM {part}").replace("VARCHAR(9)", "STRING"), part=read(spark, sf_dir, "part"))
    return C.merge_sources(rows)[0]


@query(f"WITH {_MERGED} SELECT source, count(*) AS n FROM m GROUP BY source")
def source_provenance(spark, sf_dir):
    return C.provenance(_merged(spark, sf_dir))


@query(
    f"WITH {_MERGED}, f AS (SELECT *, CASE lang WHEN 'ko' THEN 'ko-KR' WHEN 'en' THEN 'en-US' ELSE lang END AS target FROM m) SELECT key, target AS lang, value, source FROM (SELECT *, row_number() OVER (PARTITION BY key, target ORDER BY CASE WHEN lang = target THEN 0 ELSE 1 END) AS n FROM f) WHERE n = 1"
)
def folded_bases(spark, sf_dir):
    return C.fold_base(_merged(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT key, coalesce(max(value) FILTER (WHERE lang = 'en'), '') AS en, coalesce(max(value) FILTER (WHERE lang = 'ko-KR'), '') AS \"ko-KR\" FROM m GROUP BY key")
def wide_cells(spark, sf_dir):
    return sinks.wide(_merged(spark, sf_dir), "key", ["en", "ko-KR"])


@query(
    "WITH t AS (SELECT p_partkey AS ord, CASE p_size % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'en-GB' ELSE 'ko-KR' END AS lang, p_brand AS value FROM part), a AS (SELECT ord, lang, value FROM t UNION ALL SELECT ord, split_part(lang, '-', 1), value FROM t) SELECT lang, arg_max(value, ord) AS value FROM a GROUP BY lang"
)
def registered_tags(spark, sf_dir):
    tags = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.expr("CASE p_size % 3 WHEN 0 THEN 'en_us' WHEN 1 THEN 'EN-gb' ELSE 'ko-KR' END").alias("lang"), F.col("p_brand").alias("value"))
    return G.registered(tags)


@query("SELECT 'p' || p_partkey AS slug, p_name AS title, 'body' AS content FROM part WHERE p_size % 4 = 0 OR p_size % 4 = 3")
def base_posts(spark, sf_dir):
    files = read(spark, sf_dir, "part").selectExpr("concat('p', p_partkey, CASE p_size % 4 WHEN 0 THEN '.mdx' WHEN 1 THEN '.en.mdx' WHEN 2 THEN '.md' ELSE '.mdx' END) AS name", "concat('---\\ntitle: ', p_name, '\\n---\\nbody') AS raw")
    return P.listing(files).select("slug", F.col("data")["title"].alias("title"), "content")


_EXAMPLES = "SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 20000 THEN 'middle' ELSE 'long' END AS intent FROM documents"


@query(
    f"WITH n AS (SELECT lang, intent, count(*) AS n FROM ({_EXAMPLES}) GROUP BY ALL) SELECT 'cell' AS level, lang, intent, n, n < 0.5 * avg(n) OVER () AS thin FROM n UNION ALL SELECT 'lang', lang, NULL, CAST(sum(n) AS BIGINT), false FROM n GROUP BY lang UNION ALL SELECT 'intent', NULL, intent, CAST(sum(n) AS BIGINT), false FROM n GROUP BY intent"
)
def class_balance(spark, sf_dir):
    return N.balance(spark.sql(_EXAMPLES.replace("FROM documents", "FROM {documents}"), documents=read(spark, sf_dir, "documents")))


@query(
    "WITH g AS (SELECT DISTINCT n_name AS a FROM nation), r AS (SELECT r_name AS c FROM region) SELECT (SELECT count(*) FROM g, g h, r WHERE g.a <> h.a) AS valid, (SELECT count(*) FROM g) + (SELECT count(*) FROM g, g h) + (SELECT count(*) FROM g, g h, r WHERE g.a <> h.a) AS visited, (SELECT count(*) FROM g, g h, r) AS product"
)
def node_accounts(spark, sf_dir):
    names = [r.n_name for r in read(spark, sf_dir, "nation").collect()]
    slots = {"give": names, "receive": names, "with": [r.r_name for r in read(spark, sf_dir, "region").collect()]}
    return spark.createDataFrame([N.node_counts(spark, slots, {"receive": N.all_distinct(["give", "receive"])})], "valid long, visited long, product long")


@query(
    "WITH RECURSIVE r AS (SELECT c_custkey, lower(replace(c_mktsegment || c_custkey % 300, '-', '')) AS v, c_custkey // 4 AS ext FROM customer), s AS (SELECT c_custkey, 'v' || v AS g FROM r WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, 'e' || ext FROM r WHERE c_custkey % 4 < 2), l AS (SELECT DISTINCT a.c_custkey AS a, b.c_custkey AS b FROM s a JOIN s b USING (g)), p(a, b) AS (SELECT c_custkey, c_custkey FROM r UNION SELECT p.a, l.b FROM p JOIN l ON p.b = l.a) SELECT a AS c_custkey, min(b) AS cluster FROM p GROUP BY a"
)
def folded_clusters(spark, sf_dir):
    part = read(spark, sf_dir, "customer")
    name = F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || (c_custkey % 300) WHEN c_custkey % 3 = 1 THEN '  ' || lower(c_mktsegment) || '-' || (c_custkey % 300) END")
    return G.clusters(part.select("c_custkey", name.alias("name"), F.expr("CASE WHEN c_custkey % 4 < 2 THEN c_custkey div 4 END").alias("ext")), "c_custkey", ["name", "ext"], folded=True)


@query(
    f"WITH h AS (SELECT d.lang, g.term FROM documents d JOIN ({_GLOSSARY}) g ON d.lang = g.lang WHERE g.expected <> '' AND {_IN.format('term')} AND NOT {_IN.format('expected')}), n AS (SELECT lang, term, count(*) AS n FROM h GROUP BY ALL) SELECT lang, term, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS place FROM n) WHERE place <= 5"
)
def missed_terms(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("source"), F.col("text").alias("target"))
    return A.top_misses(A.adherence(docs, spark.sql(_GLOSSARY))[1])
