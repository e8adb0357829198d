"""Translation quality, strategies, vocabularies, lexicons and intent data on small cases."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from glotspark.functions import text as X
from glotspark.operators import audit as A
from glotspark.operators import corpus as C
from glotspark.operators import graph as G
from glotspark.operators import lexicon as L
from glotspark.operators import nlu as N
from glotspark.operators import posts as P
from glotspark.operators import quality as Q
from glotspark.operators import sequences as S
from glotspark.operators import stats as ST
from glotspark.operators import strategy as T
from glotspark.operators import vocabulary as V
from glotspark.plans import registry
from glotspark.sources import sinks


def test_headers(spark):
    wide = spark.createDataFrame([("k", "a", "b", "c", "d")], "key string, ko string, en_US string, note string, `zh-Hans-CN` string")
    assert Q.columns_of(wide) == ("key", ["ko", "en_US", "zh-Hans-CN"]) and Q.columns_of(wide, "note")[0] == "note"
    assert not any(map(Q.is_language, ["id", "Term", "english", "k0", "", "context"]))


def test_states(spark):
    wide = spark.createDataFrame([(1, "안녕", "안녕 ", "hi"), (2, "a long source text", "x", " "), (3, None, "x", None), (4, " ", None, "y")], "n long, ko string, en string, ja string")
    got = {(r.row, r.lang): r.state for r in Q.states(wide, "n", ["ko", "en", "ja"], "ko").collect()}
    assert got[1, "en"] == "untranslated" and got[2, "en"] == "too_short" and got[2, "ja"] == "blank" and got[3, "en"] == "translated" and got[4, "ko"] == "blank"
    rates = {r.lang: r for r in Q.equity(Q.states(wide, "n", ["ko", "en", "ja"], "ko")).collect()}
    assert rates["en"].filled == 3 and rates["en"].untranslated_rate == pytest.approx(1 / 3) and rates["ko"].underserved and not rates["en"].underserved
    assert {(r.row, r.lang, r.term) for r in Q.untranslated(wide, "n", ["ko", "en", "ja"], "ko").collect()} == {(1, "en", "안녕"), (2, "ja", "a long source text")}
    assert Q.states(wide.limit(0), "n", ["ko", "en"], "ko").isEmpty() and Q.spread(Q.equity(Q.states(wide.limit(0), "n", ["ko"], "ko"))).first().gap is None


def test_audit(spark):
    rows = [(1, "start", "시작 {0}", "Start {0}", "開始"), (2, "x", "확인", "OK", "OK"), (3, "start", "시작 {0}", "Go {0} {0}", "ë³´íµ"), (4, "y", "네", "yes " * 20, ""), (5, "z", "아니오", " no", None)]
    wide = spark.createDataFrame(rows, "n long, key string, ko string, en string, ja string")
    head, found = Q.audit(wide, "n")
    got = {(r.row, r.column, r.issue): r.detail for r in found.collect()}
    assert head["key_column"] == "key" and head["base"] == "ko" and head["coverage"] == {"ko": 1.0, "en": 1.0, "ja": 0.6} and head["duplicate_source"] == 1
    assert got[3, "key", "duplicate key"] == "first seen at row 1" and got[3, "en", "placeholder mismatch"] == "extra {0}" and got[1, "ja", "placeholder mismatch"] == "missing {0}"
    assert (3, "ja", "possible mojibake") in got and (5, "en", "leading/trailing whitespace") in got and (4, "en", "length-ratio outlier") in got
    assert sum(head["counts"].values()) == len(got)
    text = sinks.audit_report(head, found, most=2)
    assert "- base language: ko" in text and f"{len(got) - 2} more." in text and len(json.loads(sinks.audit_report(head, found, "json"))["findings"]) == len(got)
    assert Q.audit(spark.createDataFrame([(1, "a")], "n long, term string"), "n")[0]["counts"]
    spelled = Q.audit(spark.createDataFrame([(1, "k", "a", "b")], "n long, key string, ko string, ko_KR string"), "n")
    assert spelled[0]["spellings"] == {"ko": ["ko", "ko_KR"]} and spelled[0]["counts"] == {"mixed lang-code forms": 1}


def test_median(spark):
    rnd = random.Random(1)
    rows = [(g, rnd.choice([0.001, 0.5, 1.0, 1.5, 2.0, 100.0, rnd.random()])) for g in "abc" for _ in range(rnd.randrange(1, 60))] + [("d", 2.0), ("e", -1.0), ("f", None)]
    df = spark.createDataFrame(rows, "g string, ratio double")
    want = {r.g: r.m for r in df.where("ratio > 0").groupBy("g").agg(F.median("ratio").alias("m")).collect()}
    assert {r.g: r.median for r in C.exact_medians(df, "g", "ratio").collect()} == pytest.approx(want)


def test_matchers(spark):
    texts = spark.createDataFrame([(1, "Said the AI server, C++x"), (2, "ＡＩ on"), (3, None), (4, ""), (5, "서버가 죽었다"), (6, "straße C++ _ai_")], "id long, text string")
    terms = spark.createDataFrame([(0, "AI"), (1, "server"), (2, "서버"), (3, "AI"), (4, ""), (5, "x"), (6, "C++"), (7, "STRASSE")], "ord int, term string")
    rows = lambda df: {(r.id, r.ord, r.term) for r in df.collect()}
    assert rows(C.substring_matches(texts, terms)) == {(1, 0, "AI"), (1, 1, "server"), (1, 6, "C++"), (5, 2, "서버"), (6, 6, "C++"), (6, 0, "AI")}
    assert rows(C.substring_matches(texts, terms, case_sensitive=True)) == {(1, 0, "AI"), (1, 1, "server"), (1, 6, "C++"), (5, 2, "서버"), (6, 6, "C++")}
    bound = {(1, 0, "AI"), (1, 1, "server"), (1, 6, "C++"), (5, 2, "서버")}
    assert rows(C.boundary_matches(texts, terms, 2)) == bound  # C++ needs a word character behind it
    assert rows(C.match(texts, terms)) == {(1, 0, "AI"), (1, 1, "server"), (1, 6, "C++"), (2, 0, "AI"), (5, 2, "서버"), (6, 6, "C++"), (6, 0, "AI"), (6, 7, "STRASSE")}
    assert C.find_terms(spark, "the server's AI", terms) == ["AI", "server"]
    many = terms.union(spark.createDataFrame([(100 + i, f"unused{i}") for i in range(150)], terms.schema))
    assert rows(C.boundary_matches(texts, many, 2)) == bound  # by automaton
    assert rows(C.substring_matches(texts, many)) == rows(C.substring_matches(texts, terms))
    assert rows(C.match(texts, terms.limit(0))) == set() == rows(C.boundary_matches(texts, terms.limit(0)))
    with pytest.raises(ValueError):
        C.automaton_matches(texts, terms, most_chars=3)
    one = texts.where("id = 1").select(*(X.bounded(F.lower("text"), F.lit(t)).alias(t) for t in ("ai", "said", "c++", "")))
    assert tuple(one.first()) == (True, True, True, False)


def test_strategies(spark):
    rows = [(1, "Said it", "AI", "0"), (2, "the AI", "AI", "1"), (3, "an ox", "ox", "yes"), (4, "서버가", "서버", "True"), (5, None, "x", None), (6, "a server", "server", "true")]
    held = T.predictions(spark.createDataFrame(rows, "id long, text string, term string, gold string"), T.strategies(3))
    got = {r.strategy: (r.tp, r.fp, r.fn, r.tn) for r in T.confusion(held, list(T.strategies(3))).collect()}
    assert got == {"substring": (4, 1, 0, 1), "word_boundary": (4, 0, 0, 2), "word_boundary+min3": (2, 0, 2, 2)}
    out = T.significance(held, list(T.strategies(3)), draws=200)
    assert [x["strategy"] for x in out["ranked"]] == ["word_boundary", "substring", "word_boundary+min3"] and (out["only_first"], out["only_second"], out["p"], out["significant"]) == (1, 0, 1.0, False)
    low, high = ST.bootstrap_rows(held.select("id", "gold", F.col("substring").alias("predicted")), 200)
    assert 0 <= low <= 8 / 9 <= high <= 1


def test_vocabulary(spark):
    terms = spark.createDataFrame([(0, "Cool"), (1, "cooldown"), (2, "loot"), (3, "ＡＩ"), (4, "COOL"), (5, "")], "ord int, term string")
    asked = spark.createDataFrame([("co",), ("",), ("zz",), ("AI",), (None,)], "prefix string")
    got = {}
    for r in V.with_prefix(asked, terms).collect():
        got.setdefault(r.prefix, set()).add(r.term)
    assert got == {"co": {"COOL", "cooldown"}, "": {"COOL", "cooldown", "loot", "ＡＩ"}, "AI": {"ＡＩ"}}
    texts = spark.createDataFrame([(1, "COOLDOWNS", 0), (2, "xloot", 1), (3, "nothing", 0), (4, None, 0), (5, "ai", 0)], "id long, text string, start int")
    assert {r.id: r.term for r in V.longest_prefix(texts, terms).collect()} == {1: "cooldown", 2: "loot", 3: None, 4: None, 5: "ＡＩ"}
    assert {r.id for r in V.members(texts, terms).where("known").collect()} == {5}
    words = ["kitten", "sitting", "mitten", "a", "", "ab", "abc", "loot", "lot"]
    near = spark.createDataFrame(list(enumerate(words)), "ord int, term string")
    queries = ["kitte", "sittin", "", "b", "loo", "zzzzzz", "abcd", "KITTEN"]
    dist = lambda a, b: spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0]
    want = {}
    for q in queries:
        best = min(((dist(q.lower(), w), i) for i, w in enumerate(words)), default=None)
        if best and best[0] <= 2:
            want[q] = (words[best[1]], best[0])
    assert {r.query: (r.term, r.distance) for r in V.closest(spark.createDataFrame([(q,) for q in queries], "query string"), near).collect()} == want
    capped = spark.createDataFrame([("kitten", "sitting")], "a string, b string").select(X.bounded_distance(F.col("a"), F.col("b"), 2).alias("x"), X.bounded_distance(F.col("a"), F.col("b"), 3).alias("y")).first()
    assert tuple(capped) == (3, 3)


def test_fuzzy(spark):
    terms = spark.createDataFrame(list(enumerate(["cooldown", "respawn", "loot", "AI Director", "checkpoint", "inventory"])), "ord int, term string")
    asked = spark.createDataFrame([(q,) for q in ("cooldown", "cool-down", "cooldwn", "cooldowns", "AI director", "banana")], "query string")
    got = {r.query: (r.term, round(r.score, 2)) for r in C.fuzzy_match(asked, terms).collect()}
    assert got == {"cooldown": ("cooldown", 1.0), "cool-down": ("cooldown", 0.86), "cooldwn": ("cooldown", 0.78), "cooldowns": ("cooldown", 0.96), "AI director": ("AI Director", 1.0)}
    maps = spark.sql("SELECT map('a', 3.0D, 'b', 4.0D) AS x, map('a', 3.0D, 'c', 1.0D) AS y, CAST(map() AS map<string,double>) AS z")
    assert tuple(maps.select(X.cosine(F.col("x"), F.col("y")), X.cosine(F.col("x"), F.col("z"))).first()) == (pytest.approx(9 / (5 * 10**0.5)), 0.0)


def test_build(spark):
    rows = [("", "Loot", "전리품", "", "plunder | spoils"), ("item", "Item", None, None, None), (None, " ", None, "item", None), ("sub", "Sub", None, "gone", "")]
    concepts, warned = L.built(spark.createDataFrame(rows, "id string, en string, ko string, broader string, synonyms string").select("*", F.lit("d").alias("domain"), F.lit(None).cast("string").alias("pos")), ["en", "ko"])
    assert {r.id for r in concepts.collect()} == {"Loot", "item", "sub"}
    assert sorted((r.id, "skipped" in r.warning) for r in warned.where("id IS NULL").collect()) == [(None, True)] and [r.id for r in warned.where("id IS NOT NULL").collect()] == ["sub"]
    index = V.surfaces(concepts, ["en", "ko"])
    got = {r.query: r.concept for r in V.lookup(spark.createDataFrame([(" SPOILS",), ("전리품",), ("no",)], "query string"), index).collect()}
    assert got == {" SPOILS": "Loot", "전리품": "Loot", "no": None}
    assert {r.name: r.n for r in L.stats(concepts, ["en", "ko"]).collect()} == {"concepts": 3, "languages": 2, "broader": 1, "triples": 13, "synonyms": 2, "surfaces": 6, "domain:d": 3}
    lines = [json.loads(r.json) for r in L.export(concepts, ["en", "ko"]).collect()]
    assert {"id": "Loot", "labels": {"en": "Loot", "ko": "전리품"}, "domain": "d", "synonyms": ["plunder", "spoils"]} in lines and {"surface": "item", "concept": "item"} in lines
    assert "`ko`: 전리품" in L.card(concepts, ["en", "ko"], "loot") and "not in" in L.card(concepts, ["en", "ko"], "zzz")


def test_hierarchy(spark):
    up = {"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "x": "x", "r": None, "s": "r", "t": "s", "u": "gone"}
    c = spark.createDataFrame(list(up.items()), "id string, broader string")
    assert {tuple(r.members) for r in L.cycles(c).collect()} == {("a", "b", "c"), ("x",)}
    assert {r.id: r.level for r in L.leveled(c).collect()} == {"a": None, "b": None, "c": None, "d": None, "e": None, "x": None, "r": 0, "s": 1, "t": 2, "u": 0}
    down = lambda n: {(r.id, r.depth) for r in L.descendants(c, n).collect()}
    assert down("a") == {("c", 1), ("b", 2), ("d", 1), ("e", 2), ("a", 3)} and down("r") == {("s", 1), ("t", 2)} and down("x") == {("x", 1)} and down("e") == set()
    assert L.cycles(c.limit(0)).isEmpty() and L.leveled(c.limit(0)).isEmpty()
    edges = spark.createDataFrame([("s", "a", 1.0), ("a", "g", 9.0), ("s", "b", 1.0), ("b", "c", 1.0), ("c", "g", 1.0)], "src string, dst string, w double")
    assert G.shortest_path(edges, "s", "g") == ["s", "a", "g"] and G.shortest_path(edges, "s", "g", "w") == ["s", "b", "c", "g"] and G.shortest_path(edges, "g", "s") is None


def test_merge(spark):
    cells = spark.createDataFrame([(0, 1, "k", "ko", "a"), (0, 2, "k", "ko-KR", "b"), (1, 1, "k", "en", "x"), (1, 2, "m", "ko", "c"), (1, 3, "k", "ko", "z"), (1, 4, "k", "ja", " ")], "source int, row_no int, key string, lang string, value string")
    merged, conflicts = C.merge_sources(cells)
    assert {r.source: r.n for r in C.provenance(merged).collect()} == {0: 2, 1: 2} and conflicts.count() == 1
    assert {(r.key, r.lang): r.value for r in C.fold_base(merged).collect()} == {("k", "ko-KR"): "b", ("k", "en"): "x", ("m", "ko-KR"): "c"}
    tags = spark.createDataFrame([(1, "zh_cn", "a"), (2, "zh-TW", "b")], "ord int, lang string, value string")
    assert {r.lang: r.value for r in G.registered(tags).collect()} == {"zh-CN": "a", "zh-TW": "b", "zh": "b"}
    people = spark.createDataFrame([(1, "Cool-down"), (2, " ｃｏｏｌｄｏｗｎ "), (3, "other")], "id long, name string")
    assert {r.id: r.cluster for r in G.clusters(people, "id", ["name"], folded=True).collect()} == {1: 1, 2: 1, 3: 3}
    files = spark.createDataFrame([("a.mdx", "x"), ("a.en.mdx", "y"), ("b.txt", "z")], "name string, raw string")
    assert [r.slug for r in P.listing(files).collect()] == ["a"]
    blank = P.localised(P.parsed(files.where("name = 'a.mdx'")), spark.createDataFrame([("a", "---\nt: 1\n---\n ")], "slug string, raw string")).first()
    assert blank.content == " " and blank.data == {"t": "1"}
    glossary, segments = spark.createDataFrame([("a", "b", "c")], "term string, ko string, ja string"), spark.createDataFrame([("a", "c")], "source string, ja string")
    assert A.languages(glossary, segments) == ["ja"]
    with pytest.raises(ValueError):
        A.languages(glossary, segments.drop("ja"))


def test_intents(spark, tmp_path):
    spec = {"intents": {"buy": {"en": ["buy {item}", "get {what}"], "ko": ["{item} 사기"]}, "hi": {"en": ["hello"]}}, "slots": {"item": {"en": ["a", "b"], "ko": ["가"]}}}
    (tmp_path / "spec.json").write_text(json.dumps(spec, indent=1, ensure_ascii=False), encoding="utf-8")
    made = ST.fill_templates(*N.read_spec(spark, str(tmp_path / "spec.json")), 10)
    assert {(r.lang, r.text) for r in made.collect()} == {("en", "buy a"), ("en", "buy b"), ("ko", "가 사기"), ("en", "hello")}
    rows = {(r.level, r.lang, r.intent): (r.n, r.thin) for r in N.balance(made.union(made.where("text = 'buy a'")).union(made.where("text = 'buy a'"))).collect()}
    assert rows["cell", "en", "buy"] == (4, False) and rows["cell", "ko", "buy"] == (1, False) and rows["lang", "en", None] == (5, False)
    demo = {"give": ["sword", "gold", "potion"], "receive": ["sword", "gold", "potion"], "with": ["Ada", "Bjorn"]}
    assert N.node_counts(spark, demo, {"receive": N.all_distinct(["give", "receive"])}) == (12, 24, 18)


def test_budgets(spark):
    items = spark.createDataFrame([("g", "a", 3, 4.0), ("g", "b", 4, 5.0), ("g", "c", 5, 8.0), ("h", "d", 9, 1.0)], "g string, item string, cost int, value double")
    assert {r.g: (r.total, r.taken) for r in S.allocated(items, "g", "item", "cost", "value", 8).collect()} == {"g": (12.0, ["a", "c"]), "h": (0.0, [])}
    t = spark.createDataFrame([(100,), (20,), (10,), (0,), (None,)], "t int")
    assert [r.p for r in t.select(S.pieces(F.col("t"), [50, 30, 20]).alias("p")).collect()] == [[50, 50], [20], None, [], None]
    old, new = (F.array(*map(F.lit, x.split())) for x in ("a b c d", "a x c d e"))
    assert tuple(spark.range(1).select(S.diff_marks(old, new).alias("m")).select("m.*").first()) == (["b"], ["x", "e"])
    assert spark.range(1).select(X.multiset_minus(F.expr("array('a', 'a', 'b', 'c')"), F.expr("array('a', 'c', 'd')")).alias("m")).first().m == ["a", "b"]
    rates = [r.rate for r in ST.inclusion_rates(20, 5, 400, spark).collect()]
    assert len(rates) == 20 and all(abs(r - 0.25) < 0.1 for r in rates) and sum(rates) == pytest.approx(5)
    assert ST.reached(items, "value", 4.0) == 3


def test_shards(spark):
    shards = [spark.createDataFrame([(x,) for x in xs], "value long").coalesce(1) for xs in ([1, 4, 4, 9], [2, 4], [], [0, 10])]
    got = [(r.value, r.shard) for r in ST.merged_shards(shards, "value").collect()]
    assert got == [(0, 3), (1, 0), (2, 1), (4, 0), (4, 0), (4, 1), (9, 0), (10, 3)]


@pytest.mark.parametrize("odd", [False, True])
def test_merged_order(spark, tmp_path, odd):
    """Bounds of the ranges that another run draws otherwise, ties, and ids and values that are null, negative or not numbers."""
    nan, rnd = float("nan"), random.Random(5)
    rows = [(i, float(rnd.randrange(300))) for i in range(20_000)]
    if odd:
        rows += [(-i, rnd.choice([None, nan, 7.0, -0.0, 0.0])) for i in range(1, 300)] + [(None, 7.0), (None, None)]
    spark.createDataFrame(rows, "event_id long, value double").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    last = lambda x: (x is None, x != x, 0 if x is None or x != x else x)
    rest = lambda i: None if i is None else math.copysign(abs(i) % 3, i)
    want = sorted(rows, key=lambda r: (last(r[1]), last(rest(r[0])), last(r[0])))
    few = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        got = registry.QUERIES["merged_order"](spark, str(tmp_path)).collect()
    finally:
        for k in few:
            spark.conf.unset(k)
    assert [r.event_id for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in want] and {r.place for r in got} == set(range(1, len(rows) + 1))


def test_numbered(spark):
    assert ST.numbered(spark.range(0), "n").isEmpty()
    assert sorted(tuple(r) for r in ST.numbered(spark.range(10, numPartitions=4).where("id > 3"), "n").collect()) == [(i, i - 3) for i in range(4, 10)]


def test_longest_ok_run(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for s, most in itertools.product(range(12), [2]):
        flags = [rnd.random() < 0.3 for _ in range(rnd.randrange(1, 15))]
        rows += [(s, i, b) for i, b in enumerate(flags)]
        n = len(flags)
        best = max((j - i, -i) for i in range(n + 1) for j in range(i, n + 1) if sum(flags[i:j]) <= most)
        want[s] = (best[0], -best[1] if best[0] else 0)
    got = C.longest_ok_run(spark.createDataFrame(rows, "s long, i int, bad boolean"), "s", "i", "bad", 2).collect()
    assert {r.s: (r.run_length, r.run_start) for r in got} == want and all(r.run_end == r.run_start + r.run_length for r in got)


def test_field_notes(spark):
    """Cases that have gone wrong elsewhere."""
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c).first()[0]
    assert one(X.fold(F.col("a")), a="ＡＩ Straße") == "ai strasse" and one(X.strip(F.col("a")), a="　 x \n") == "x"
    assert one(X.has_mojibake(F.col("a")), a="ë³´íµ") and not one(X.has_mojibake(F.col("a")), a="보통 café")
    assert one(X.whitespace_issue(F.col("a")), a="a﻿b") == "embedded BOM" and one(X.whitespace_issue(F.col("a")), a="a\x07b") == "control character"
    assert one(X.content_disposition(F.col("a")), a='용"어*!~.csv') == "attachment; filename=\"___*!~.csv\"; filename*=UTF-8''%EC%9A%A9%22%EC%96%B4%2A!~.csv"
    assert one(X.cluster_fold(F.col("a")), a="  Cool-Down\t x") == "cooldown x" and one(X.printable(F.col("a")), a="a\x00b​") == "a·b·"
