"""Registered queries of translation quality, metric tables, strategies and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import quality as Q
from ..operators import stats as S
from ..operators import strategy as T
from ..operators import vocabulary as V
from .registry import _VALUES, TERMS, query, read

#: Parts as a multilingual table: blank, copied, short, padded and placeholder-damaged cells.
_WIDE = (
    "SELECT p_partkey AS rn, CASE WHEN p_partkey % 40 = 3 THEN 'k1' ELSE 'k' || p_partkey END AS key, p_name || CASE WHEN p_size % 4 = 0 THEN ' {a} %s' ELSE '' END AS ko, "
    "CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN left(p_name, 2) WHEN 3 THEN ' ' || p_name || ' ' WHEN 4 THEN p_type || ' %s %s' ELSE p_type || ' <b>' END AS en, "
    "CASE WHEN p_partkey % 3 = 0 THEN ' ' WHEN p_partkey % 7 = 0 THEN p_name ELSE p_brand || ' {a} %s' END AS ja FROM part"
)
_LANGS = ["ko", "en", "ja"]


def _frame(spark, sf_dir, sql, table):
    sql = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace("VARCHAR", "STRING"), **{table: read(spark, sf_dir, table)})


def wide(spark, sf_dir):
    return _frame(spark, sf_dir, _WIDE, "part")


_CELLS = f"w AS ({_WIDE}), c AS (SELECT rn, key, 'ko' AS lang, ko AS source, ko AS value FROM w UNION ALL SELECT rn, key, 'en', ko, en FROM w UNION ALL SELECT rn, key, 'ja', ko, ja FROM w)"
_STATES = f"{_CELLS}, st AS (SELECT rn, lang, CASE WHEN trim(value) = '' THEN 'blank' WHEN lang = 'ko' THEN 'translated' WHEN trim(value) = trim(source) THEN 'untranslated' WHEN length(trim(value)) < length(trim(source)) * 0.3 THEN 'too_short' ELSE 'translated' END AS state FROM c)"
_EQUITY = (
    f"{_STATES}, e AS (SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE state <> 'blank') AS filled, count(*) FILTER (WHERE state = 'untranslated') AS untranslated, count(*) FILTER (WHERE state = 'too_short') AS too_short FROM st GROUP BY lang), "
    "r AS (SELECT *, filled::DOUBLE / n_rows AS coverage, CASE WHEN filled > 0 THEN untranslated::DOUBLE / filled ELSE 0 END AS untranslated_rate, CASE WHEN filled > 0 THEN too_short::DOUBLE / filled ELSE 0 END AS too_short_rate FROM e)"
)


@query(f"WITH {_STATES} SELECT * FROM st")
def translation_states(spark, sf_dir):
    return Q.states(wide(spark, sf_dir), "rn", _LANGS, "ko").select(F.col("row").alias("rn"), "lang", "state")


@query(f"WITH {_EQUITY} SELECT *, max(coverage) OVER () - coverage AS behind, max(coverage) OVER () - coverage > 0.10::DOUBLE AS underserved FROM r")
def equity_rates(spark, sf_dir):
    return Q.equity(Q.states(wide(spark, sf_dir), "rn", _LANGS, "ko"))


@query(f"WITH {_EQUITY} SELECT max(coverage) - min(coverage) AS gap, stddev_pop(coverage) / avg(coverage) AS cv FROM r")
def equity_spread(spark, sf_dir):
    return Q.spread(Q.equity(Q.states(wide(spark, sf_dir), "rn", _LANGS, "ko")))


@query(f"WITH {_STATES} SELECT trim(w.ko) AS term, count(*) AS n FROM st JOIN w USING (rn) WHERE lang <> 'ko' AND state IN ('blank', 'untranslated') GROUP BY 1")
def untranslated_terms(spark, sf_dir):
    return Q.untranslated_counts(wide(spark, sf_dir), "rn", _LANGS, "ko")


_TRANSLATIONS = f"WITH {_CELLS} SELECT rn AS segment, CASE WHEN lang = 'en' AND rn % 2 = 0 THEN 'en_US' WHEN lang = 'en' THEN 'en-US' ELSE lang END AS lang, CASE WHEN rn % 50 = 7 THEN 'Ã©' || value ELSE value END AS text FROM c"


def translations(spark, sf_dir):
    return _frame(spark, sf_dir, _TRANSLATIONS, "part")


@query(f"SELECT t.lang, count(*) FILTER (WHERE trim(t.text) = trim(s.p_name)) AS copied, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (WHERE trim(t.text) = trim(s.p_name)) / count(*), 1) AS copy_pct FROM ({_TRANSLATIONS}) t JOIN part s ON s.p_partkey = t.segment GROUP BY t.lang HAVING count(*) FILTER (WHERE trim(t.text) = trim(s.p_name)) > 0")
def copied_translations(spark, sf_dir):
    return Q.copied_through(translations(spark, sf_dir), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("source_text")))


@query(f"WITH m AS (SELECT segment, lang, CASE WHEN segment % 2 = 0 THEN 'ECO' ELSE 'ring' END AS term FROM ({_TRANSLATIONS})) SELECT lang, count(*) AS applicable, count(*) FILTER (WHERE contains(lower(t.text), lower(term))) AS applied, round(100.0::DOUBLE * count(*) FILTER (WHERE contains(lower(t.text), lower(term))) / count(*), 1) AS adherence_pct FROM m JOIN ({_TRANSLATIONS}) t USING (segment, lang) GROUP BY lang")
def term_adherence(spark, sf_dir):
    t = translations(spark, sf_dir)
    return Q.term_adherence(t.select("segment", "lang", F.expr("CASE WHEN segment % 2 = 0 THEN 'ECO' ELSE 'ring' END").alias("term")), t)


@query(f"WITH n AS (SELECT lang, count(*) FILTER (WHERE trim(text) <> '') AS n_filled, count(*) AS n_segments FROM ({_TRANSLATIONS}) GROUP BY lang) SELECT *, round(100.0::DOUBLE * (n_filled::DOUBLE / n_segments), 1) AS coverage_pct, round(100.0::DOUBLE * (max(n_filled::DOUBLE / n_segments) OVER () - n_filled::DOUBLE / n_segments), 1) AS gap_from_best_pp FROM n")
def coverage_gaps(spark, sf_dir):
    return Q.coverage_gap(translations(spark, sf_dir))


@query(f"SELECT split_part(replace(lang, '_', '-'), '-', 1) AS base, array_to_string(list(DISTINCT lang ORDER BY lang), ',') AS forms, count(DISTINCT lang) AS n_forms FROM ({_TRANSLATIONS}) GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def forms_seen(spark, sf_dir):
    return Q.tag_forms(translations(spark, sf_dir)).withColumn("forms", F.array_join("forms", ","))


@query(f"SELECT segment, lang, left(text, 60) AS sample FROM ({_TRANSLATIONS}) WHERE regexp_matches(text, '[Â-ô][\u0080-¿]+|�') ORDER BY segment, lang LIMIT 100")
def damaged_sample(spark, sf_dir):
    return Q.damaged(translations(spark, sf_dir))


_JOBS = """SELECT o_custkey % 97 AS job, CASE WHEN o_orderkey % 5 = 0 THEN '{"requested": []}' WHEN o_orderkey % 5 = 1 THEN '{"requested": ["glossary", "memory"], "glossary_terms": ["a", "b"]}' WHEN o_orderkey % 5 = 2 THEN '{"requested": ["glossary"], "glossary_terms": []}' WHEN o_orderkey % 7 = 3 THEN '{}' ELSE '{"requested": ["glossary"]}' END AS log FROM orders"""
_ASKED = "coalesce(list_contains(CAST(json_extract(log, '$.requested') AS VARCHAR[]), 'glossary'), false)"


@query(f"SELECT job, count(*) AS rows_total, count(*) FILTER (WHERE {_ASKED}) AS glossary_requested, count(*) FILTER (WHERE {_ASKED} AND coalesce(json_array_length(log, '$.glossary_terms'), 0) = 0) AS zero_match_rows FROM ({_JOBS}) GROUP BY job ORDER BY zero_match_rows DESC, job LIMIT 20")
def augmenter_jobs(spark, sf_dir):
    return Q.augmenter_health(_frame(spark, sf_dir, _JOBS, "orders"))


@query(f"SELECT count(*) - count(DISTINCT trim(ko)) AS n FROM ({_WIDE}) WHERE trim(ko) <> ''")
def repeated_sources(spark, sf_dir):
    return Q.repeated_values(wide(spark, sf_dir), "ko")


_MARKS = r"regexp_extract_all({}, '\{{[^}}]*\}}|%\d*\$?[sdfx]|<[^>]+>|\[\[[^\]]+\]\]')"
_PARITY = f"{_CELLS}, m AS (SELECT rn, lang, list_sort({_MARKS.format('source')}) AS want, list_sort({_MARKS.format('value')}) AS have FROM c WHERE lang <> 'ko' AND trim(value) <> '' AND trim(source) <> '')"
_MORE = "array_to_string(list_sort(flatten(list_transform(list_distinct({0}), lambda x: list_transform(range(greatest(0, len(list_filter({0}, lambda y: y = x)) - len(list_filter({1}, lambda y: y = x)))), lambda i: x)))), ',')"


@query(f"WITH {_PARITY} SELECT rn, lang, {_MORE.format('want', 'have')} AS missing, {_MORE.format('have', 'want')} AS extra FROM m WHERE want <> have")
def placeholder_parity(spark, sf_dir):
    cells = C.long_form(wide(spark, sf_dir).select("rn", F.col("ko").alias("source"), "en", "ja"), ["rn", "source"], ["en", "ja"])
    found = Q.parity(cells.where(X.filled(F.col("value")) & X.filled(F.col("source"))).select(F.col("rn").alias("row"), "lang", "value", "source"))
    return found.select(F.col("row").alias("rn"), "lang", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("missing", "extra")))


_RATIOS = f"{_CELLS}, ra AS (SELECT rn, lang, length(trim(value))::DOUBLE / length(trim(source)) AS ratio FROM c WHERE lang <> 'ko' AND trim(value) <> ''), md AS (SELECT lang, median(ratio) AS median FROM ra GROUP BY lang)"


@query(
    f"WITH {_RATIOS}, m AS (SELECT rn, lang, list_sort({_MARKS.format('source')}) AS want, list_sort({_MARKS.format('value')}) AS have FROM c WHERE lang <> 'ko' AND trim(value) <> '') "
    "SELECT lang AS \"column\", 'whitespace' AS issue, count(*) AS n FROM c WHERE trim(value) <> '' AND trim(value) <> value GROUP BY lang UNION ALL SELECT lang, 'placeholder mismatch', count(*) FROM m WHERE want <> have GROUP BY lang "
    "UNION ALL SELECT lang, 'length-ratio outlier', count(*) FROM ra JOIN md USING (lang) WHERE ratio / median > 4 OR ratio / median < 0.25 GROUP BY lang UNION ALL SELECT 'key', 'duplicate key', count(*) - count(DISTINCT key) FROM w"
)
def audit_counts(spark, sf_dir):
    """The whole audit of the table, its findings counted by column and issue."""
    found = Q.audit(wide(spark, sf_dir), "rn", "key", "ko")[1]
    issue = F.when(F.col("issue") == "leading/trailing whitespace", "whitespace").otherwise(F.col("issue"))
    return found.groupBy("column", issue.alias("issue")).agg(F.count("*").alias("n"))


_PAIRS = f"SELECT doc_id AS id, text, term, CASE WHEN n_chars % 3 = 0 THEN '1' WHEN n_chars % 3 = 1 THEN 'yes ' ELSE 'no' END AS gold FROM documents JOIN (VALUES {_VALUES}) t(ord, term) ON ord = doc_id % {len(TERMS)}"
_SIDE = "(^|[^\\p{L}\\p{N}_])"
_PREDICTED = f"p AS (SELECT id, gold IN ('1', 'yes ') AS gold, contains(lower(text), term) AS substring, regexp_matches(lower(text), '{_SIDE}' || term || '($|[^\\p{{L}}\\p{{N}}_])') AS word_boundary, length(term) >= 3 AND regexp_matches(lower(text), '{_SIDE}' || term || '($|[^\\p{{L}}\\p{{N}}_])') AS min3 FROM ({_PAIRS}))"


def predicted(spark, sf_dir):
    pairs = spark.sql(_PAIRS.replace("FROM documents", "FROM {documents}"), documents=read(spark, sf_dir, "documents"))
    return T.predictions(pairs, T.strategies(3))


@query(
    f"WITH {_PREDICTED}, l AS (SELECT 'substring' AS strategy, substring AS hit, gold FROM p UNION ALL SELECT 'word_boundary', word_boundary, gold FROM p UNION ALL SELECT 'word_boundary+min3', min3, gold FROM p), "
    "s AS (SELECT strategy, count(*) FILTER (WHERE hit AND gold) AS tp, count(*) FILTER (WHERE hit AND NOT gold) AS fp, count(*) FILTER (WHERE NOT hit AND gold) AS fn, count(*) FILTER (WHERE NOT hit AND NOT gold) AS tn FROM l GROUP BY strategy) "
    "SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS prec, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM s"
)
def strategy_scores(spark, sf_dir):
    return T.confusion(predicted(spark, sf_dir), list(T.strategies(3)))


@query(
    f"WITH {_PREDICTED}, d AS (SELECT count(*) FILTER (WHERE substring = gold AND word_boundary <> gold) AS x, count(*) FILTER (WHERE substring <> gold AND word_boundary = gold) AS y FROM p) "
    "SELECT x AS only_first, y AS only_second, round(CASE WHEN x + y = 0 THEN 1 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(x + y + 1.0) - lgamma(i + 1.0) - lgamma(x + y - i + 1.0) - (x + y) * ln(2.0))) FROM range(least(x, y) + 1) t(i))) END, 6) AS p FROM d"
)
def strategy_test(spark, sf_dir):
    x, y, p = T.discordant(predicted(spark, sf_dir), "substring", "word_boundary")
    return spark.createDataFrame([(x, y, round(p, 6))], "only_first long, only_second long, p double")


_WORDS = "SELECT CAST(min(p_partkey) AS INT) AS ord, p_name AS term FROM part GROUP BY p_name"


def words(spark, sf_dir):
    return _frame(spark, sf_dir, _WORDS, "part")


@query(f"SELECT DISTINCT left(upper(p_name), 4) AS prefix, w.term FROM part JOIN ({_WORDS}) w ON starts_with(w.term, left(p_name, 4))")
def prefix_terms(spark, sf_dir):
    return V.with_prefix(read(spark, sf_dir, "part").select(F.expr("left(upper(p_name), 4)").alias("prefix")), words(spark, sf_dir))


_ASKED_NAMES = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', '') WHEN 2 THEN p_name || 's and more' ELSE p_type END AS text FROM part"


def names(spark, sf_dir):
    return _frame(spark, sf_dir, _ASKED_NAMES, "part")


@query(f"SELECT id, lower(text) IN (SELECT p_name FROM part) AS known FROM ({_ASKED_NAMES})")
def known_terms(spark, sf_dir):
    return V.members(names(spark, sf_dir), words(spark, sf_dir)).select("id", "known")


@query(f"SELECT n.id, arg_max(w.term, length(w.term)) AS term FROM ({_ASKED_NAMES}) n LEFT JOIN ({_WORDS}) w ON starts_with(lower(n.text), w.term) GROUP BY n.id")
def longest_prefix_terms(spark, sf_dir):
    return V.longest_prefix(names(spark, sf_dir).withColumn("start", F.lit(0)), words(spark, sf_dir))


@query(f"WITH d AS (SELECT q.text AS query, w.ord, w.term, levenshtein(lower(q.text), w.term) AS distance FROM (SELECT DISTINCT text FROM ({_ASKED_NAMES})) q JOIN ({_WORDS}) w ON abs(length(q.text) - length(w.term)) <= 2) SELECT query, arg_min(term, distance * 1000000 + ord) AS term, CAST(min(distance) AS INTEGER) AS distance FROM d WHERE distance <= 2 GROUP BY query")
def closest_terms(spark, sf_dir):
    return V.closest(names(spark, sf_dir).select(F.col("text").alias("query")), words(spark, sf_dir))


_GRAMS = "list_transform(range(1, length('^' || {0} || '$') - 1), lambda i: substr('^' || {0} || '$', i, 3))"


@query(
    f"WITH w AS ({_WORDS}), q AS (SELECT DISTINCT text AS query FROM ({_ASKED_NAMES})), g AS (SELECT ord, unnest({_GRAMS.format('term')}) AS gram FROM w), i AS (SELECT gram, ln((1.0::DOUBLE + (SELECT count(*) FROM w)) / (1 + count(DISTINCT ord))) + 1 AS idf FROM g GROUP BY gram), "
    f"vt AS (SELECT ord, gram, count(*) * any_value(idf) AS w FROM g JOIN i USING (gram) GROUP BY ord, gram), vq AS (SELECT query, gram, count(*) * any_value(idf) AS w FROM (SELECT query, unnest({_GRAMS.format('lower(query)')}) AS gram FROM q) JOIN i USING (gram) GROUP BY query, gram), "
    "s AS (SELECT query, ord, sum(vq.w * vt.w) / (sqrt((SELECT sum(x.w * x.w) FROM vq x WHERE x.query = vq.query)) * sqrt((SELECT sum(y.w * y.w) FROM vt y WHERE y.ord = vt.ord))) AS score FROM vq JOIN vt USING (gram) GROUP BY query, ord) "
    "SELECT query, arg_min(term, -round(score, 12) + ord / 1e18) AS term, round(max(score), 9) AS score FROM (SELECT query, ord, score, max(round(score, 12)) OVER (PARTITION BY query) AS top FROM s) JOIN w USING (ord) WHERE round(score, 12) = top GROUP BY query HAVING max(score) >= 0.5"
)
def fuzzy_terms(spark, sf_dir):
    found = C.fuzzy_match(names(spark, sf_dir).select(F.col("text").alias("query")), words(spark, sf_dir))
    return found.select("query", "term", F.round("score", 9).alias("score"))


@query("SELECT event_id, round(CASE WHEN d > 0 THEN (value - m) / d ELSE 0 END, 9) AS zscore FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY event_type) USING (event_type)")
def event_zscores(spark, sf_dir):
    from ..streaming import windows as W

    events = read(spark, sf_dir, "events")
    return W.zscores(events, W.moments(events, ["event_type"], "value"), ["event_type"], "value").select("event_id", F.round("zscore", 9).alias("zscore"))


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id % 3, event_id) AS place FROM events")
def merged_order(spark, sf_dir):
    events, rest = read(spark, sf_dir, "events").select("event_id", "value"), F.col("event_id") % 3
    by = [c.asc_nulls_last() for c in (F.col("value"), rest, F.col("event_id"))]
    # Remainders of negative ids come before 0 and those of null ids last.
    shards = [events.where(own).orderBy(*by) for own in (rest <= 0, rest == 1, (rest == 2) | rest.isNull())]
    return S.numbered(S.merged_shards(shards, by[0]).select("event_id"), "place")


@query(
    "WITH f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS place, value > 40 AS bad FROM events), e AS (SELECT user_id, place AS p FROM f WHERE bad UNION ALL SELECT DISTINCT user_id, -1 FROM f), "
    "n AS (SELECT user_id, max(place) + 1 AS n FROM f GROUP BY user_id), r AS (SELECT user_id, p, coalesce(lead(p, 3) OVER (PARTITION BY user_id ORDER BY p), n) - p - 1 AS len FROM e JOIN n USING (user_id)) "
    "SELECT user_id, CAST(max(len) AS INTEGER) AS run_length, CAST(CASE WHEN max(len) > 0 THEN arg_max(p, len * 1000000 - p) + 1 ELSE 0 END AS INTEGER) AS run_start, CAST(CASE WHEN max(len) > 0 THEN arg_max(p, len * 1000000 - p) + 1 + max(len) ELSE 0 END AS INTEGER) AS run_end FROM r GROUP BY user_id"
)
def longest_runs(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    flags = read(spark, sf_dir, "events").select("user_id", place.alias("place"), (F.col("value") > 40).alias("bad"))
    return C.longest_ok_run(flags, "user_id", "place", "bad", 2)


@query("SELECT doc_id, regexp_matches(text, '[가-힣]') AS korean, regexp_matches(text, '[぀-ヿ]') AS japanese, length(regexp_replace(text, '[^가-힣぀-ヿ㐀-鿿]', '', 'g')) >= greatest(1, floor(length(text) / 2)) AS cjk, regexp_replace(left(text, 200), '[\\x00-\\x1f\\x7f-\\x9f]', '·', 'g') AS shown FROM documents")
def script_checks(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.looks_korean(t).alias("korean"), X.looks_japanese(t).alias("japanese"), X.mostly_cjk(t).alias("cjk"), X.printable(F.left(t, F.lit(200))).alias("shown"))


_LINE = "'x,' || p_partkey || ',\"say \"\"' || p_name || '\"\"\",' || p_brand"
_HEADER = "'attachment; filename=\"' || p_name || '_' || p_partkey || '__.csv\"; filename*=UTF-8' || chr(39) || chr(39) || replace(p_name, ' ', '%20') || '_' || p_partkey || '%EA%B0%80%22.csv'"


@query(f"SELECT p_partkey, {_LINE} AS line, {_HEADER} AS header FROM part")
def csv_lines(spark, sf_dir):
    name = F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit('가".csv'))
    return read(spark, sf_dir, "part").select("p_partkey", X.csv_row(F.lit("x"), F.col("p_partkey").cast("string"), F.concat(F.lit('say "'), F.col("p_name"), F.lit('"')), F.col("p_brand")).alias("line"), X.content_disposition(name).alias("header"))
