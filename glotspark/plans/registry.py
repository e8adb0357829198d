"""Registered queries of the corpus operators, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C

FLAGSHIP = "coverage_by_lang"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: A small glossary over the words of the corpus and of part names.
TERMS = ["the", "tion", "ver", "eau", "and the", "heit", "and", "re", "que", "ción"]
TAGS = ["ko-KR", "ko_kr", "KO", "zh-hans-cn", "zh_Hans_CN", "en", "EN-us", "es-419", "pt_BR", "sr-latn"]
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))
_TAGS = ", ".join(f"('{t}')" for t in TAGS)


def query(sql: str | None = None):
    """Registers the function under its name, with the oracle's SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT CAST(ord AS INT) AS ord, term FROM VALUES {_VALUES} AS t(ord, term)")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


#: Documents with planted defects: some blank, padded or damaged.
_CELLS = "SELECT doc_id, lang, source, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN ' ' || text WHEN doc_id % 23 = 0 THEN 'Ã©' || text ELSE text END AS value FROM documents"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CELLS.replace("documents", "{documents}"), documents=read(spark, sf_dir, "documents"))


_COVERAGE = f"SELECT lang, count(*) AS n_rows, CAST(sum(CASE WHEN trim(value) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS filled, avg(CASE WHEN trim(value) <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage FROM ({_CELLS}) GROUP BY lang"


@query(_COVERAGE)
def coverage_by_lang(spark, sf_dir):
    return C.coverage(cells(spark, sf_dir))


@query(f"SELECT *, max(coverage) OVER () - coverage AS behind, max(coverage) OVER () - coverage > 0.10::DOUBLE AS underserved FROM ({_COVERAGE})")
def equity_by_lang(spark, sf_dir):
    return C.equity(C.coverage(cells(spark, sf_dir)))


@query("SELECT doc_id, first_row FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_row, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE trim(text) <> '') WHERE n > 1")
def duplicate_values(spark, sf_dir):
    return C.duplicates(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "first_row")


@query("WITH r AS (SELECT doc_id, lang, CAST(length(text) AS DOUBLE) AS ratio FROM documents), m AS (SELECT lang, median(ratio) AS median FROM r WHERE ratio > 0 GROUP BY lang) SELECT doc_id, lang, ratio, median FROM r JOIN m USING (lang) WHERE ratio / median > 4 OR ratio / median < 0.25")
def length_outliers(spark, sf_dir):
    ratios = read(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("double").alias("ratio"))
    return C.length_outliers(ratios, "lang").select("doc_id", "lang", "ratio", "median")


@query(f"SELECT doc_id FROM ({_CELLS}) WHERE regexp_matches(value, '[Â-ô][\u0080-¿]+|�')")
def mojibake_screen(spark, sf_dir):
    return cells(spark, sf_dir).where(X.has_mojibake(F.col("value"))).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN regexp_matches(value, '^[\\s\\x0b\\p{{Z}}]|[\\s\\x0b\\p{{Z}}]$') THEN 'leading/trailing whitespace' WHEN regexp_matches(value, '\\p{{Cc}}') THEN 'control character' END AS issue FROM ({_CELLS}) WHERE regexp_matches(value, '^[\\s\\x0b\\p{{Z}}]|[\\s\\x0b\\p{{Z}}]$') OR regexp_matches(value, '\\p{{Cc}}')")
def whitespace_issues(spark, sf_dir):
    return cells(spark, sf_dir).select("doc_id", X.whitespace_issue(F.col("value")).alias("issue")).where("issue IS NOT NULL")


@query(r"SELECT page_id, CAST(len(regexp_extract_all(html, '\{[^}]*\}|%\d*\$?[sdfx]|<[^>]+>|\[\[[^\]]+\]\]')) AS BIGINT) AS n_placeholders FROM pages")
def page_placeholders(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(X.placeholders(F.col("html"))).cast("long").alias("n_placeholders"))


@query(f"SELECT lower(split_part(replace(tag, '_', '-'), '-', 1)) AS base, count(*) AS n_forms, array_to_string(list_sort(list(tag)), ',') AS forms FROM (VALUES {_TAGS}) t(tag) GROUP BY 1 HAVING count(*) > 1")
def tag_drift(spark, sf_dir):
    tags = spark.sql(f"SELECT tag FROM VALUES {_TAGS} AS t(tag)")
    return tags.groupBy(X.base_lang(F.col("tag")).alias("base")).agg(F.count_distinct("tag").alias("n_forms"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("forms")).where("n_forms > 1")


_PARTS = "list_transform(string_split(replace(tag, '_', '-'), '-'), lambda p, i: CASE WHEN i = 1 THEN lower(p) ELSE {} END)"
_NORMAL = "array_to_string(" + _PARTS.format("CASE WHEN regexp_matches(p, '^[A-Za-z]{4}$') THEN upper(left(p, 1)) || lower(substr(p, 2)) WHEN regexp_matches(p, '^[A-Za-z]{2}$') THEN upper(p) ELSE lower(p) END") + ", '-')"
_DOC_TAGS = "SELECT DISTINCT CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN upper(lang) WHEN 2 THEN lang || '_' || lang WHEN 3 THEN upper(lang) || '-latn_' || lang WHEN 4 THEN lang || '-419' ELSE lang || '-Hant-tw-x' END AS tag FROM documents"
_ALL_TAGS = f"SELECT tag FROM (VALUES {_TAGS}) t(tag) UNION {_DOC_TAGS}"


@query(f"SELECT tag, {_NORMAL} AS normal, array_to_string({_PARTS.format('upper(p)')}, '-') AS canon, {_NORMAL} || CASE WHEN contains({_NORMAL}, '-') THEN ',' || split_part({_NORMAL}, '-', 1) ELSE '' END AS aliases FROM ({_ALL_TAGS})")
def tag_forms(spark, sf_dir):
    tag = F.col("tag")
    tags = spark.sql(_ALL_TAGS.replace("FROM documents", "FROM {documents}").replace("(VALUES", "VALUES").replace(") t(tag)", " AS t(tag)"), documents=read(spark, sf_dir, "documents"))
    return tags.select("tag", X.normalize_lang(tag).alias("normal"), X.canon_lang(tag).alias("canon"), F.array_join(X.lang_aliases(tag), ",").alias("aliases"))


_SUBSTRING = f"SELECT d.doc_id AS id, CAST(t.ord AS INTEGER) AS ord, t.term FROM documents d, (VALUES {_VALUES}) t(ord, term) WHERE contains(lower(d.text), t.term)"


@query(_SUBSTRING)
def substring_match(spark, sf_dir):
    return C.substring_matches(texts(spark, sf_dir), terms(spark))


@query(_SUBSTRING)
def automaton_match(spark, sf_dir):
    return C.automaton_matches(texts(spark, sf_dir), terms(spark))


_BOUNDED = f"SELECT d.doc_id AS id, CAST(t.ord AS INTEGER) AS ord, t.term FROM documents d, (VALUES {_VALUES}) t(ord, term) WHERE regexp_matches(lower(d.text), '(^|[^\\p{{L}}\\p{{N}}_])' || t.term || '([^\\p{{L}}\\p{{N}}_]|$)')"


@query(_BOUNDED)
def boundary_match(spark, sf_dir):
    return C.boundary_matches(texts(spark, sf_dir), terms(spark))


@query(f"WITH m AS ({_BOUNDED}) SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.id = m.id AND length(o.term) > length(m.term) AND contains(o.term, m.term))")
def longest_match(spark, sf_dir):
    return C.longest_first(C.boundary_matches(texts(spark, sf_dir), terms(spark)))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS term FROM documents) WHERE term <> '' GROUP BY term ORDER BY n DESC, term LIMIT 25")
def top_terms(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("term")).where("term <> ''")
    return C.top_k(words.groupBy("term").agg(F.count("*").alias("n")), "term", "n", 25)


@query("SELECT user_id, event_id, mean FROM (SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n >= 5")
def sliding_mean(spark, sf_dir):
    return C.sliding_mean(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5).select("user_id", "event_id", "mean")


@query("SELECT event_type, count(*) AS n, avg(value) AS mean, var_samp(value) AS variance, stddev_samp(value) AS deviation, stddev_pop(value) AS deviation_pop FROM events GROUP BY event_type")
def running_moments(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.stddev_samp("value").alias("deviation"), F.stddev_pop("value").alias("deviation_pop"))


_SPANS = 'SELECT user_id AS doc, event_type AS label, CAST(event_id % 1000 AS INT) AS "start", CAST(event_id % 1000 + 1 + event_id % 37 AS INT) AS "end" FROM events'


@query(f'WITH s AS ({_SPANS}), m AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY doc, label ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), i AS (SELECT *, sum(new) OVER (PARTITION BY doc, label ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc, label, min("start") AS "start", max("end") AS "end" FROM i GROUP BY doc, label, island')
def merged_spans(spark, sf_dir):
    return C.merge_spans(spark.sql(_SPANS.replace(chr(34), "`").replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events")))


_SOURCES = "SELECT CAST(p_partkey % 3 AS INT) AS source, p_partkey AS row_no, CAST(p_partkey % 400 AS VARCHAR(9)) AS key, CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'ko' END AS lang, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_brand END AS value FROM part"


@query(f"SELECT key, lang, value, source FROM (SELECT *, row_number() OVER (PARTITION BY key, lang ORDER BY source, row_no) AS n FROM ({_SOURCES}) WHERE trim(value) <> '') WHERE n = 1")
def merged_sources(spark, sf_dir):
    sources = spark.sql(_SOURCES.replace("FROM part", "FROM {part}").replace("VARCHAR(9)", "STRING"), part=read(spark, sf_dir, "part"))
    return C.merge_sources(sources)[0]


@query(f"SELECT key, lang, kept, kept_source, value, source FROM (SELECT *, first_value(value) OVER w AS kept, first_value(source) OVER w AS kept_source FROM ({_SOURCES}) WHERE trim(value) <> '' WINDOW w AS (PARTITION BY key, lang ORDER BY source, row_no)) WHERE value <> kept")
def merge_conflicts(spark, sf_dir):
    sources = spark.sql(_SOURCES.replace("FROM part", "FROM {part}").replace("VARCHAR(9)", "STRING"), part=read(spark, sf_dir, "part"))
    return C.merge_sources(sources)[1]


@query("SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance, 1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)) AS similarity FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND abs(length(a.n_name) - length(b.n_name)) <= 3")
def edit_distances(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    near = n.alias("a").join(n.alias("b"), F.expr("a.n_nationkey < b.n_nationkey AND abs(length(a.n_name) - length(b.n_name)) <= 3"))
    a, b = F.col("a.n_name"), F.col("b.n_name")
    return near.select(a.alias("a"), b.alias("b"), F.levenshtein(a, b).alias("distance"), X.similarity(a, b).alias("similarity"))


@query("SELECT source, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (SELECT source, count(*) FILTER (WHERE quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars >= 500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < 500) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def rule_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("source").agg(F.expr("count_if(quality = 1 AND n_chars >= 500)").alias("tp"), F.expr("count_if(quality = 0 AND n_chars >= 500)").alias("fp"), F.expr("count_if(quality = 1 AND n_chars < 500)").alias("fn"))
    prec, recall, f1 = C.scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("source", "tp", "fp", "fn", prec.alias("prec"), recall.alias("recall"), f1.alias("f1"))


@query("SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':7'), event_id LIMIT 100")
def reservoir(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7"))), "event_id").limit(100).select("event_id")


@query("SELECT event_type, count(*) FILTER (WHERE value < 50) AS lower_bound, count(*) FILTER (WHERE value <= 50) AS upper_bound FROM events GROUP BY event_type")
def bounds(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 50).alias("lower_bound"), F.count_if(F.col("value") <= 50).alias("upper_bound"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_field(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k IS NOT NULL")
