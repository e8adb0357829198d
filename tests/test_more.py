"""Sources, sinks, sequences and statistics on small fixtures."""

import collections
import itertools
import random

import pytest

from glotspark.operators import graph as G
from glotspark.operators import sequences as Q
from glotspark.operators import stats as S
from glotspark.plans.registry import QUERIES
from glotspark.sources import readers, sinks
from glotspark.streaming import windows as W


def test_sequences():
    rnd = random.Random(3)
    assert Q.longest_increasing([0.55, 0.7, 0.66, 0.68, 0.6, 0.74, 0.79]) == [0.55, 0.66, 0.68, 0.74, 0.79]
    for _ in range(50):
        xs = [rnd.randrange(6) for _ in range(7)]
        subs = [s for k in range(8) for s in itertools.combinations(xs, k)]
        assert len(Q.longest_increasing(xs)) == max(len(s) for s in subs if all(a < b for a, b in zip(s, s[1:])))
        ys = [rnd.randrange(6) for _ in range(7)]
        other = {s for k in range(8) for s in itertools.combinations(ys, k)}
        assert len(Q.common_subsequence(xs, ys)) == max(len(s) for s in subs if s in other)
        costs, vals, room = [rnd.randrange(1, 6) for _ in range(6)], [rnd.randrange(9) for _ in range(6)], rnd.randrange(12)
        best = max(sum(vals[i] for i in c) for k in range(7) for c in itertools.combinations(range(6), k) if sum(costs[i] for i in c) <= room)
        value, taken = Q.knapsack(costs, vals, room)
        assert value == best == sum(vals[i] for i in taken) and sum(costs[i] for i in taken) <= room
    assert Q.fewest_pieces([50, 30, 20], 100) == [50, 50]
    assert Q.fewest_pieces([50, 30], 20) is None and Q.fewest_pieces([5], 0) == []


def test_rising_values(spark):
    held = collections.defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect():
        held[r.user_id].append((r.ts, r.event_id, r.value))
    want = {}
    for user, rows in held.items():
        ends = []  # of each event the longest run that ends there
        for k, (*_, v) in enumerate(rows := sorted(rows)):
            ends.append(1 + max((n for n, (*_, u) in zip(ends, rows[:k], strict=True) if u < v), default=0))
        want[user] = max(ends)
    got = QUERIES["rising_values"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want) and {r.user_id: r.longest for r in got} == want
    assert any((rows[-1][0] - rows[0][0]).days for rows in held.values()) and max(want.values()) > 5


def test_segments(spark):
    texts = spark.createDataFrame([(1, "Cooldown loot!"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.tokens for r in Q.segments(texts, ["cool", "cooldown", "loot"]).collect()}
    assert got == {1: ["cooldown", " ", "loot", "!"], 2: None, 3: []}


def test_statistics(spark):
    assert S.mcnemar(2, 0) == pytest.approx(0.5) and S.mcnemar(0, 0) == 1.0 and S.mcnemar(54, 0) < 1e-4
    pairs = spark.createDataFrame([(i % 3 == 0, i % 3 == 0 or i % 7 == 0) for i in range(210)], "gold boolean, predicted boolean")
    low, high = S.bootstrap_f1(pairs)
    assert low < 2 * 70 / (2 * 70 + 20) < high
    ids = spark.range(10_000).selectExpr("id", "0 AS label")
    assert abs(S.flipped(ids, "label", "id", 0.3).where("label = 1").count() - 3000) < 200


def test_templates(spark):
    t = spark.createDataFrame([("buy", "en", "buy {item}"), ("hi", "en", "hello"), ("buy", "ko", "{item} x")], "intent string, lang string, template string")
    v = spark.createDataFrame([("item", "en", w) for w in "abc"], "slot string, lang string, value string")
    rows = S.fill_templates(t, v, 2).collect()
    assert len(rows) == 3 and {r.text for r in rows} <= {"hello", "buy a", "buy b", "buy c"}


def test_graph(spark):
    concepts = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "gone"), ("e", None)], "id string, broader string")
    got = {(r.id, r.ancestor) for r in G.ancestors(concepts).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "a"), ("c", "a"), ("c", "b"), ("d", "gone")}
    with pytest.raises(ValueError):
        G.distances(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, w double"), 1, "w")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffkey,ko\nattack,공격\n".encode())
    (tmp_path / "b.csv").write_bytes("key,ko\nattack,어택\n".encode("cp949"))
    rows, used = readers.read_csv(spark, str(tmp_path))
    assert {(r.key, r.ko) for r in rows.collect()} == {("attack", "공격"), ("attack", "어택")}
    assert {r.path[-5:]: r.encoding for r in used.collect()} == {"a.csv": "utf-8-sig", "b.csv": "cp949"}
    seen = {r.path[-5:]: (r.head[:6], r.verdict) for r in readers.inspect(spark, str(tmp_path)).collect()}
    assert seen["a.csv"] == ("efbbbf", "UTF-8 BOM") and seen["b.csv"][1] == "cp949"
    assert readers.decode("가".encode("cp949")) == ("가", "cp949")
    (tmp_path / "c.csv").write_bytes(b"key,ko\nx,\xff\xff\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path))


def test_sinks(spark):
    df = spark.createDataFrame([(2, 'say "hi"'), (1, "a,b"), (3, None)], "id long, t string")
    assert b"".join(sinks.csv_pages(df, ["id"], 2)) == '\ufeffid,t\r\n1,"a,b"\r\n2,"say ""hi"""\r\n3,\r\n'.encode()
    assert "| 1 | a,b |" in sinks.markdown(df, "T")
    assert '"id": 3' in sinks.report_json(df)
    assert sinks.gate(df, "t IS NULL") == 1 and sinks.gate(df, "id > 5") == 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "b", 5.0)], "t string, k string, v double").selectExpr("CAST(t AS TIMESTAMP) AS ts", "k", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = W.tumbling(stream, "ts", "v", ["k"], "1 hour").writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.k, r.n, r["mean"]) for r in spark.table("hourly").collect()} == {("a", 2, 2.0), ("b", 1, 5.0)}
