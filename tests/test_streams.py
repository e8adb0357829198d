"""Streams, sources, sinks and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from glotspark.__main__ import main
from glotspark.operators import stats
from glotspark.sources import readers, sinks, synthetic
from glotspark.streaming import windows as W

SCHEMA = "n long, k string, v double, bad boolean"


def run(spark, tmp_path, made, mode, parts=((range(0, 6)), (range(6, 11)))):
    """Two micro-batches through ``made``; the rows that came out, in order of batches."""
    for b, part in enumerate(parts):
        spark.createDataFrame([(n, "ab"[n % 2], float(n), n % 4 == 3) for n in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{b}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = f"out{abs(hash(str(tmp_path)))}"
    q = made(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_row_means(spark, tmp_path):
    got = {(r.key, r.place, r.mean) for r in run(spark, tmp_path, lambda s: W.row_means(s, "k", ["n"], "v", 3), "append")}
    want = set()
    for k in range(2):
        own = [float(n) for n in range(11) if n % 2 == k]
        want |= {("ab"[k], i + 3, sum(own[i : i + 3]) / 3) for i in range(len(own) - 2)}
    assert got == want
    with pytest.raises(ValueError):
        W.row_means(spark.createDataFrame([], SCHEMA), "k", ["n"], "v", 0)


def test_reservoir(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: W.reservoir(s, "k", "n", 2), "update")
    marks = {r.n: r.m for r in spark.range(11).select(F.col("id").alias("n"), F.xxhash64("id", F.lit(0)).alias("m")).collect()}
    last = {r.key: r["items"] for r in got}
    assert last == {"ab"[k]: sorted(str(n) for n in sorted((n for n in marks if n % 2 == k), key=marks.get)[:2]) for k in range(2)}


def test_ok_runs(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: W.ok_runs(s, "k", ["n"], "bad", 1), "update")
    last = {r.key: (r.run_length, r.run_start, r.run_end) for r in got}  # b: 1, 3 bad, 5, 7 bad, 9
    assert last == {"a": (6, 0, 6), "b": (3, 0, 3)}


def test_aggregates(spark, tmp_path):
    got = {r.k: (r.n, r["mean"]) for r in run(spark, tmp_path / "m", lambda s: W.moments(s, ["k"], "v"), "complete")}
    assert got == {"a": (6, 5.0), "b": (5, 5.0)}
    top = run(spark, tmp_path / "t", lambda s: W.top_terms(s, "k", 1), "complete")
    assert [(r.k, r.n) for r in top] == [("a", 6)]
    cells = run(spark, tmp_path / "c", lambda s: W.coverage(s.select(F.col("k").alias("lang"), F.when(F.col("bad"), " ").otherwise("x").alias("value"))), "complete")
    assert {r.lang: (r.n_rows, r.filled) for r in cells} == {"a": (6, 6), "b": (5, 3)}


def test_zscores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "k string, v double")
    got = sorted((r.k, r.v, round(r.zscore, 6)) for r in W.zscores(df, W.moments(df, ["k"], "v"), ["k"], "v").collect())
    assert got == [("a", 1.0, -0.707107), ("a", 3.0, 0.707107), ("b", 7.0, 0.0)]


def test_outputs(spark, tmp_path):
    cells = spark.createDataFrame([("k1", "ko", "가"), ("k1", "en", 'a "b"'), ("k2", "ko", "나")], "key string, lang string, value string")
    wide = sinks.wide(cells, "key", ["ko", "en"])
    assert {tuple(r) for r in wide.collect()} == {("k1", "가", 'a "b"'), ("k2", "나", "")}
    sinks.write_csv_bom(wide, str(tmp_path / "w.csv"), ["key"])
    assert (tmp_path / "w.csv").read_bytes() == '﻿key,ko,en\r\nk1,가,"a ""b"""\r\nk2,나,\r\n'.encode()
    sinks.write_csv(wide, str(tmp_path / "all"))
    assert sorted(map(tuple, readers.strings(readers.read_csv(spark, str(tmp_path / "all"))[0]).collect())) == sorted(map(tuple, wide.collect()))
    sinks.jsonl(cells.withColumn("no", F.lit(None).cast("string")), str(tmp_path / "l"))
    assert {json.loads(r.value)["value"] for r in spark.read.text(str(tmp_path / "l")).collect()} == {"가", 'a "b"', "나"}
    sinks.triples(spark.createDataFrame([("a", "b", "c")], "s string, p string, o string"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a b c ."]
    with pytest.raises(ValueError):
        sinks.markdown(cells, "T", 2)
    assert sinks.markdown(cells, "T", None).count("\n") == 7


def test_inputs(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿가".encode())
    (tmp_path / "b.txt").write_bytes("나".encode("cp949"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xff")
    assert {r.path[-5:]: (r.text, r.encoding) for r in readers.read_texts(spark, str(tmp_path)).collect()} == {"a.txt": ("가", "utf-8-sig"), "b.txt": ("나", "cp949"), "c.txt": (None, None)}
    assert tuple(readers.strings(spark.createDataFrame([(1, None)], "a long, b string")).first()) == ("1", "")
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    (tmp_path / "x.csv").write_bytes('key,ko\na,"가,나\n다"\nb,\n'.encode("cp949"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "x.csv"))[0].collect()] == [("a", "가,나\n다"), ("b", None)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_synthetic(spark):
    wide = synthetic.corpus(spark, 1000, ["ko", "en"], 0.5)
    assert wide.where("ko = ''").isEmpty() and 400 < wide.where("en <> ''").count() < 600
    assert [r.value for r in stats.merged_shards(synthetic.shards(spark, 10, 3), "value").collect()] == list(range(10))
    assert abs(synthetic.ratios(spark, 4000).agg(F.avg("ratio")).first()[0] - 1) < 0.02
    assert synthetic.segments(spark, 50, 20).where("text LIKE '%term%'").count() > 40 and synthetic.terms(spark, 20).distinct().count() == 20
    got = {r.rate: r.accuracy for r in stats.noise_sweep(synthetic.intents(spark, 600), [0.0, 0.5]).collect()}
    assert got[0.0] > 0.8 and got[0.5] < got[0.0]


@pytest.mark.parametrize("command", ["adherence", "ab", "lexicon", "lookup", "ancestors", "descendants", "topo", "link", "triples", "json", "bias", "merge", "cluster", "top-k", "nlu", "noise", "both"])
def test_commands(spark, tmp_path, capsys, command):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8") and str(tmp_path / name)
    wide = put("w.csv", "key,ko,en,ja_JP\na,가,x,\nb,나,나,い\nc,다다다다다다다다,x,\n")
    lexicon = put("l.csv", "id,en,ko,broader,domain,synonyms\nloot,loot,전리품,item,game,spoils|plunder\nitem,item,,,,\n")
    glossary, segments = put("g.csv", "term,ja\nloot,品\nAI,AI\n"), put("s.csv", "source,ja\nthe loot,品\nan AI,x\n")
    gold, spec = put("gold.csv", "text,term,gold\nSaid,AI,0\nan AI,AI,1\n"), put("spec.json", '{"intents": {"buy": {"en": ["buy {x}"]}}, "slots": {"x": {"en": ["a", "b"]}}}')
    calls = {
        "adherence": (["adherence", "--glossary", glossary, "--segments", segments], 1, "0.5"), "ab": (["ab", gold, "--significance", "--n-boot", "50"], 0, '"only_first"'), "lexicon": (["lexicon", lexicon], 0, "| concepts | 2 |"),
        "lookup": (["lexicon", lexicon, "--lookup", "spoils"], 0, "concept `loot`"), "ancestors": (["lexicon", lexicon, "--ancestors", "loot"], 0, "item"), "descendants": (["lexicon", lexicon, "--descendants", "item"], 0, "loot"),
        "topo": (["lexicon", lexicon, "--topo"], 0, "item\nloot"), "link": (["lexicon", lexicon, "--link", "the spoils"], 0, "| loot | spoils |"), "triples": (["lexicon", lexicon, "--format", "triples"], 0, "loot skos:broader item ."),
        "json": (["lexicon", lexicon, "--format", "json"], 0, '"id":"loot"'), "bias": (["bias", wide], 1, "ja_JP"), "merge": (["merge", wide, put("v.csv", "key,ko\na,또\n"), "--merge-base"], 1, "또"),
        "cluster": (["cluster", wide, "--id-col", "key", "--signal-cols", "en"], 1, "a, c"), "top-k": (["top-k", wide, "--k", "1"], 0, "| 가 | 1 |"), "nlu": (["nlu", spec], 0, '"buy a"'), "noise": (["noise", "--n", "200", "--rates", "0"], 0, "| 0.0 |"),
        "both": (["audit", wide, "--format", "both"], 1, '"base": "ko"'),
    }
    argv, code, part = calls[command]
    assert main(argv, spark) == code
    assert part in capsys.readouterr().out
