"""Every registered query against its SQL oracle, on the smallest tables."""

import math

import duckdb
import pytest

from glotspark.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rounded(rows, got.columns) == rounded(want.fetchall(), names)


def test_tags(spark):
    forms = {r.tag: (r.normal, r.canon, r.aliases) for r in registry.QUERIES["tag_forms"](spark, DIR).collect()}
    assert forms["zh_Hans_CN"] == ("zh-Hans-CN", "zh-HANS-CN", "zh-Hans-CN,zh")
    assert forms["KO"] == ("ko", "ko", "ko")
    assert forms["es-419"] == ("es-419", "es-419", "es-419,es")
