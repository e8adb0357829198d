"""The audit, adherence, the lexicon and the command line on small fixtures."""

import pytest

from glotspark.__main__ import main
from glotspark.operators import audit, lexicon

ROWS = [
    (0, "start", "시작", "Start", "スタート"),
    (1, "defense", "방어", "Defense", " "),
    (2, "name", "{name}님 안녕하세요 반갑습니다", "Hi", "{이름}さん"),
    (3, "start", "시작", "Start", "開始"),
    (4, "ok", "확인", "OK " * 30, "決定"),
    (5, "cancel", "취소", "Cancel\t", "キャンセ"),
    (6, "bad", "공격", "ë³´íµ", "攻撃"),
    (7, "nfd", "커피", "Café", "珈琲"),
]


def test_findings(spark):
    wide = spark.createDataFrame(ROWS, "row long, key string, ko string, en string, ja string")
    got = {tuple(r) for r in audit.findings(wide, "row", "key", ["ko", "en", "ja"], "ko").collect()}
    assert {(3, None, "duplicate_key"), (5, "en", "whitespace"), (4, "en", "length_outlier"), (6, "en", "mojibake"), (7, "en", "not_nfc"), (1, "ja", "whitespace")} <= got
    assert {(r, x) for r, x, k in got if k == "placeholder_mismatch"} == {(2, "en"), (2, "ja")}
    assert audit.findings(wide.limit(0), "row", "key", ["ko", "en", "ja"], "ko").isEmpty()


def test_adherence(spark):
    seg = spark.createDataFrame([(1, "ja", "AI Director on", "AIディレクター"), (2, "ja", "Said it", "x"), (3, "ja", "the loot", "品"), (4, "ko", "loot", None)], "id long, lang string, source string, target string")
    glo = spark.createDataFrame([("ja", "AI Director", "AIディレクター"), ("ja", "AI", "AI"), ("ja", "loot", "戦利品"), ("ko", "loot", "전리품"), ("ko", "x", None)], "lang string, term string, expected string")
    rates, misses = audit.adherence(seg, glo)
    assert {r.lang: (r.applicable, r.adherent) for r in rates.collect()} == {"ja": (3, 1), "ko": (1, 0)}
    assert {(r.id, r.term) for r in misses.collect()} == {(1, "AI"), (3, "loot"), (4, "loot")}
    assert {(r.lang, r.term, r.n) for r in audit.top_misses(misses).collect()} == {("ja", "AI", 1), ("ja", "loot", 1), ("ko", "loot", 1)}


def test_lexicon(spark):
    c = spark.createDataFrame([("loot", "item", "game", "noun", "loot", "plunder|spoils"), ("item", "object", None, "", "item", None), ("object", "gone", None, None, "object", ""), ("a", "b", None, None, "a", None), ("b", "a", None, None, "", None), ("s", "s", None, None, "s", None)], "id string, broader string, domain string, pos string, en string, synonyms string")
    assert [tuple(r) for r in lexicon.warnings(c).collect()] == [("object", "gone")]
    got = {tuple(r) for r in lexicon.triples(c.where("id = 'loot'"), ["en"]).collect()}
    assert got == {("loot", "rdf:type", "skos:Concept"), ("loot", "skos:prefLabel", '"loot"@en'), ("loot", "skos:altLabel", '"plunder"'), ("loot", "skos:altLabel", '"spoils"'), ("loot", "dct:subject", '"game"'), ("loot", "lexinfo:partOfSpeech", '"noun"'), ("loot", "skos:broader", "item")}
    assert {tuple(r.members) for r in lexicon.cycles(c).collect()} == {("a", "b"), ("s",)}
    assert lexicon.ordered(c) == ["object", "item", "loot", "a", "b", "s"]
    texts = spark.createDataFrame([(1, "Rare spoils and loot"), (2, "looter"), (3, "戦利品だ")], "id long, text string")
    s = spark.createDataFrame([("loot", "loot"), ("loot", "spoils"), ("loot", "戦利品")], "concept string, surface string")
    assert {tuple(r) for r in lexicon.link(texts, s).collect()} == {(1, "loot", "spoils"), (3, "loot", "戦利品")}


@pytest.mark.parametrize("command", ["audit", "coverage", "inspect"])
def test_command(spark, tmp_path, capsys, command):
    (tmp_path / "x.csv").write_text("key,ko,ja_JP,ja\na,가,ア,\na,나,イ,い\n", encoding="utf-8")
    code = main([command, str(tmp_path / "x.csv")], spark)
    out = capsys.readouterr().out
    assert {"audit": code == 1 and "duplicate key" in out and "mixed lang-code forms" in out, "coverage": code == 1 and "0.5" in out, "inspect": code == 0 and "UTF-8" in out}[command]
