"""Registered queries of the graph, sequence, statistics, generator and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import graph as G
from ..operators import sequences as Q
from ..operators import stats as S
from ..streaming import windows as W
from .registry import _SPANS, query, read

_EDGES = "SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, CAST(1 + n_nationkey % 5 AS DOUBLE) AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, CAST(2 + n_nationkey % 3 AS DOUBLE) FROM nation"
_RECORDS = "SELECT doc_id, text, CASE WHEN doc_id % 5 < 2 THEN CAST(floor(doc_id / 5) AS BIGINT) END AS ext FROM documents"
_CONCEPTS = "SELECT CAST(p_partkey AS VARCHAR(20)) AS id, CASE WHEN p_partkey > 1 THEN CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR(20)) END AS broader FROM part"


def _edges(spark, sf_dir):
    return spark.sql(_EDGES.replace("FROM nation", "FROM {nation}"), nation=read(spark, sf_dir, "nation"))


@query(f"WITH RECURSIVE r AS ({_RECORDS}), s AS (SELECT doc_id, 't' || text AS v FROM r WHERE text <> '' UNION ALL SELECT doc_id, 'e' || ext FROM r WHERE ext IS NOT NULL), l AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (v)), p(a, b) AS (SELECT doc_id, doc_id FROM r UNION SELECT p.a, l.b FROM p JOIN l ON p.b = l.a) SELECT a AS doc_id, min(b) AS cluster FROM p GROUP BY a")
def entity_clusters(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return G.clusters(spark.sql(_RECORDS.replace("FROM documents", "FROM {documents}"), documents=docs), "doc_id", ["text", "ext"])


@query(f"WITH RECURSIVE e AS ({_EDGES}), p(node, cost, hops) AS (SELECT 0, 0.0::DOUBLE, 0 UNION SELECT e.dst, p.cost + e.w, p.hops + 1 FROM p JOIN e ON e.src = p.node WHERE p.hops < 24 AND p.cost < 60) SELECT node, min(cost) AS cost FROM p GROUP BY node")
def cheapest_paths(spark, sf_dir):
    return G.distances(_edges(spark, sf_dir), 0, "w").select("node", "cost")


@query(f"WITH RECURSIVE e AS ({_EDGES}), p(node, hops) AS (SELECT 0, 0 UNION SELECT e.dst, p.hops + 1 FROM p JOIN e ON e.src = p.node WHERE p.hops < 24) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM p GROUP BY node")
def reachable_nodes(spark, sf_dir):
    return G.reachable(_edges(spark, sf_dir), 0)


@query(f"WITH RECURSIVE c AS ({_CONCEPTS}), p(id, ancestor, depth) AS (SELECT id, broader, 1 FROM c WHERE broader IS NOT NULL UNION ALL SELECT p.id, c.broader, p.depth + 1 FROM p JOIN c ON c.id = p.ancestor WHERE c.broader IS NOT NULL) SELECT id, ancestor, CAST(depth AS INTEGER) AS depth FROM p")
def concept_ancestors(spark, sf_dir):
    return G.ancestors(spark.sql(_CONCEPTS.replace("FROM part", "FROM {part}").replace("VARCHAR(20)", "STRING"), part=read(spark, sf_dir, "part")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'ko_kr' ELSE 'pt-BR' END AS lang, CASE WHEN p_size % 2 = 0 THEN 'base' ELSE 'exact' END AS value FROM part")
def alias_lookup(spark, sf_dir):
    store = spark.sql("SELECT * FROM VALUES ('ko', 'base'), ('pt', 'unused'), ('pt-BR', 'exact') AS t(lang, value)")
    return G.lookup(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'ko_kr' ELSE 'pt-BR' END").alias("lang")), store)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS p_name, p_brand FROM part")
def locale_overlay(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    variants = part.select("p_partkey", F.expr("CASE WHEN p_size % 3 = 0 THEN p_type ELSE ' ' END").alias("p_name"), F.lit(None).cast("string").alias("p_brand")).where("p_size % 2 = 0 OR p_size % 3 = 0")
    return G.overlay(part.select("p_partkey", "p_name", "p_brand"), variants, "p_partkey", ["p_name", "p_brand"])


@query(f'WITH s AS (SELECT DISTINCT * FROM ({_SPANS})) SELECT a.doc, a.label AS label_a, a."start" AS start_a, a."end" AS end_a, b.label AS label_b, b."start" AS start_b, b."end" AS end_b FROM s a JOIN s b ON a.doc = b.doc AND a."start" < b."end" AND b."start" < a."end" AND a.label <> b.label AND (a."start", a."end", a.label) < (b."start", b."end", b.label)')
def span_conflicts(spark, sf_dir):
    spans = spark.sql(_SPANS.replace(chr(34), "`").replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events"))
    return G.span_conflicts(spans.distinct())


@query("WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY value DESC) AS reach FROM c) SELECT event_type, min(value) AS threshold FROM r WHERE reach <= 50 GROUP BY event_type")
def budget_thresholds(spark, sf_dir):
    return S.budget_threshold(read(spark, sf_dir, "events"), "event_type", "value", 50)


_BAYES = "WITH d AS (SELECT doc_id, lang, list_filter(string_split(text, ' '), lambda x: x <> '') AS tokens FROM documents WHERE text IS NOT NULL), tr AS (SELECT * FROM d WHERE doc_id % 10 < 7), te AS (SELECT * FROM d WHERE doc_id % 10 >= 7), w AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(tokens) AS token FROM tr) GROUP BY ALL), m AS (SELECT lang, ln(count(*)::DOUBLE / (SELECT count(*) FROM tr)) AS prior, (SELECT count(DISTINCT token) FROM w) AS v, any_value(t.total) AS total FROM tr JOIN (SELECT lang, sum(n) AS total FROM w GROUP BY lang) t USING (lang) GROUP BY lang), g AS (SELECT doc_id, w.lang, sum(ln(n + 1.0::DOUBLE)) AS gain FROM (SELECT doc_id, unnest(tokens) AS token FROM te) x JOIN w USING (token) GROUP BY ALL) SELECT te.doc_id AS id, arg_max(m.lang, prior - len(te.tokens) * ln((total + v)::DOUBLE) + coalesce(gain, 0)) AS predicted FROM te CROSS JOIN m LEFT JOIN g ON g.doc_id = te.doc_id AND g.lang = m.lang GROUP BY te.doc_id"


@query(_BAYES)
def bayes_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.expr("filter(split(text, ' '), x -> x <> '')").alias("tokens"))
    return S.bayes_predict(docs.where("id % 10 < 7").select("label", "tokens"), docs.where("id % 10 >= 7").select("id", "tokens"))


@query("SELECT a, b, c FROM (VALUES ('x'), ('y'), ('z')) t(a), (VALUES ('x'), ('y'), ('w')) u(b), (VALUES ('1'), ('2')) v(c) WHERE a <> b")
def constrained_slots(spark, sf_dir):
    return S.expand(spark, {"a": "xyz", "b": "xyw", "c": "12"}, "a <> b")


@query("SELECT user_id, CAST(len(list_reduce(list([value] ORDER BY ts, event_id), lambda acc, x: list_concat(acc[1:len(list_filter(acc, lambda t: t < x[1]))], x, acc[len(list_filter(acc, lambda t: t < x[1])) + 2:]))) AS BIGINT) AS longest FROM events GROUP BY user_id")
def rising_values(spark, sf_dir):
    """Length of the longest run of rising values in each user's whole sequence, by time and event."""
    ordered = read(spark, sf_dir, "events").groupBy("user_id").agg(F.expr("transform(array_sort(collect_list(struct(ts, event_id, value))), x -> x.value)").alias("vals"))
    return ordered.select("user_id", F.size(Q.lis(F.col("vals"))).cast("long").alias("longest"))


@query("SELECT event_type, CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS start, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    out = W.tumbling(read(spark, sf_dir, "events"), "ts", "value", ["event_type"], "1 hour")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, sf_dir):
    out = W.sessions(read(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_GLOSSARY = "SELECT * FROM (VALUES ('en', 'and', 'the'), ('en', 'that', 'with'), ('fr', 'et', 'les'), ('de', 'und', 'die'), ('es', 'de', 'los'), ('es', 'y', '')) AS g(lang, term, expected)"
_IN = "regexp_matches(lower(d.text), '(^|[^\\p{{L}}\\p{{N}}_])' || g.{} || '([^\\p{{L}}\\p{{N}}_]|$)')"


@query(f"SELECT lang, count(*) AS applicable, count(*) FILTER (WHERE ok) AS adherent, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM (SELECT d.lang, {_IN.format('expected')} AS ok FROM documents d JOIN ({_GLOSSARY}) g ON d.lang = g.lang WHERE g.expected <> '' AND {_IN.format('term')}) GROUP BY lang")
def glossary_adherence(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("source"), F.col("text").alias("target"))
    return A.adherence(docs, spark.sql(_GLOSSARY))[0]


@query("WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 9 = 0 THEN p_name || ' {x}' WHEN p_size % 9 = 1 THEN ' ' || p_name WHEN p_size % 9 = 2 THEN '' ELSE p_name END AS en FROM part), f AS (SELECT 'placeholder_mismatch' AS kind, count(*) AS n FROM p WHERE en LIKE '%{x}' UNION ALL SELECT 'whitespace', count(*) FROM p WHERE en LIKE ' %' UNION ALL SELECT 'duplicate_key', (SELECT count(*) - count(DISTINCT p_name) FROM p)) SELECT kind, n FROM f WHERE n > 0")
def audit_findings(spark, sf_dir):
    part = read(spark, sf_dir, "part").selectExpr("p_partkey AS row", "p_name AS ko", "CASE WHEN p_size % 9 = 0 THEN p_name || ' {x}' WHEN p_size % 9 = 1 THEN ' ' || p_name WHEN p_size % 9 = 2 THEN '' ELSE p_name END AS en")
    return A.findings(part.withColumn("key", F.col("ko")), "row", "key", ["ko", "en"], "ko").groupBy("kind").agg(F.count("*").alias("n"))
