"""Every query with SQL agrees with DuckDB on the smallest tables, at two numbers of partitions."""

import math
import os

import duckdb
import pytest

from fieldloom.plans import suite

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows, columns):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    spark.conf.set("spark.sql.shuffle.partitions", str(1 + len(name) % 8))
    found = suite.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    cursor = duck.execute(suite.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(names) == columns
    assert plain([r.asDict() for r in found.collect()], columns) == plain(want, columns)


def test_page_queries_match_sql_on_cut_references(spark, tmp_path):
    cut = ["A &amp; B", "A &amp; B &amp", "A &quot;B&quot", "&copy", "&am", "&ampx;", "A&amp;amp", "R&D &middot; &"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, f'<nav><a href="/?q={t}&copy=1">x</a></nav><article><h1>{t}</h1><p>y</p><div class="ad">{t}</div></article>') for i, t in enumerate(cut + cut[::-1])])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    for name in ("q_html_title", "q_html_links", "q_diff_anchor"):
        found = suite.queries()[name](spark, str(tmp_path))
        cursor = con.execute(suite.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        want = plain([dict(zip(names, r, strict=True)) for r in cursor.fetchall()], names)
        assert want and plain([r.asDict() for r in found.collect()], names) == want
