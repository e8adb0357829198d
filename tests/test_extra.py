"""Posts, repairs and templates on small cases."""

from pyspark.sql import functions as F

from glotspark.functions import repair as R
from glotspark.operators import posts as P
from glotspark.operators import stats as S


def test_repairs(spark):
    broken = "보통".encode().decode("latin-1")
    df = spark.createDataFrame([(1, broken), (2, "plain"), (3, None), (4, "")], "id int, t string")
    got = {r.id: r for r in df.select("id", R.repairs(F.col("t")).alias("a"), R.traced(F.col("t")).alias("b"), R.traced(F.col("t"), every=True).alias("c")).collect()}
    assert ("latin-1", "utf-8", "보통") in [tuple(x) for x in got[1].a]
    assert ("latin-1", "utf-8", "보통") in [tuple(x) for x in got[1].b]
    assert {tuple(x) for x in got[1].c} == set(R.candidates(broken, R.WRONG_WIDE))
    assert [len(x.text) for x in got[1].c] == sorted((len(x.text) for x in got[1].c), reverse=True)
    assert all(got[i].a == [] and got[i].b == [] for i in (2, 3, 4))


def test_posts(spark):
    rows = [("a.mdx", "---\nt: x: y\nt:  z \nno\n---\n![i](u) body\n---\n"), ("b", "no matter"), ("c.mdx", None), ("d", "---\n\n---"), ("e", "")]
    got = {r.slug: r for r in P.parsed(spark.createDataFrame(rows, "name string, raw string")).collect()}
    assert got["a"].data == {"t": "z"} and got["a"].content == "![i](u) body\n---\n" and got["a"].thumbnail == "u"
    assert got["b"].data == {} and got["b"].content == "no matter" and got["b"].thumbnail is None
    assert got["c"].data is None and got["c"].content is None
    assert got["d"].data == {} and got["d"].content == "" and got["e"].content == ""


def test_spans(spark):
    t = spark.createDataFrame([("i", "en", "a {x}{y} {x}"), ("i", "en", "{z}"), ("j", "en", "none")], "intent string, lang string, template string")
    v = spark.createDataFrame([("x", "en", "a"), ("x", "ko", "k"), ("y", "en", "bé"), ("y", "en", "c")], "slot string, lang string, value string")
    rows = S.fill_templates(t, v, 10).collect()
    assert {r.text for r in rows} == {"a abé a", "a ac a", "none"} and len(rows) == 3
    for r in rows:
        assert [r.text[s.start : s.end] for s in r.spans] == ([] if r.text == "none" else ["a", r.text[3:-2], "a"])
    assert len(S.fill_templates(t, v, 1).collect()) == 2
