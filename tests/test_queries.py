"""Every query runs on the smallest tables, and gives what its SQL gives."""

import datetime
import decimal
import math

import duckdb
import pytest

from lectern.plans import slate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return round(v, 5) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(slate.queries()))
def test_query(spark, sf, db, name):
    df = slate.queries()[name](spark, sf)
    rows = df.collect()
    sql = slate.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["expansion_reason", "earliest_occurrence"])
def test_every_query_of_the_set_is_asked(spark, sf, db, name):
    asked = {r.query_id for r in slate.queries()[name](spark, sf).collect()}
    want = {x // 100 for x, in db.execute("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    if name == "expansion_reason":  # lexical rows alone are never as good as a first place by vectors
        want |= {x for x, in db.execute("SELECT item_id FROM benchmark").fetchall()}
    assert len(want) > 1 and want <= asked


@pytest.mark.parametrize(
    "name, texts",
    [
        ("running_header_window", ["ción mid ñ\x0bü.\nmême éd, DIX"] * 4),
        ("stream_null_fill", ["sea light", "light sea sea light", "\n", "\t ", "  ", "", None, "words"]),  # the first two's signs cancel
    ],
)
def test_query_over_texts_that_the_tables_lack(spark, tmp_path, name, texts):
    rows = [(n, t, "en", "src0", len(t or "")) for n, t in enumerate(texts)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/sf/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/sf/documents.parquet/*.parquet'")
    got = con.execute(slate.oracle_sql()[name])
    want = got.fetchall()
    df = slate.queries()[name](spark, f"{tmp_path}/sf").select(*[d[0] for d in got.description])
    assert want and sorted(map(tuple, df.collect())) == sorted(want)
