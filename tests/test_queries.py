"""Every query with SQL against DuckDB over the same rows."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order(tuple(map(plain, r)) for r in got.select(*names).collect()) == order(tuple(map(plain, r)) for r in want.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.entries > 0 for r in rows)


def test_rdf_entries_takes_all_nations(spark, tmp_path):
    nations = [(i, f"n{i}") for i in range(1500)]
    spark.createDataFrame(nations, "n_nationkey long, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, f"s{i}", i) for i in range(1500)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.s_suppkey: r.author for r in entry.queries()["rdf_entries"](spark, str(tmp_path)).collect()}
    assert got == dict(nations)


def test_sniff_reject_reads_whole_pages(spark, tmp_path, monkeypatch):
    from wireloom import queries as feeds

    seen = []
    parse = feeds.parse_documents
    monkeypatch.setattr(feeds, "parse_documents", lambda docs: seen.append(docs) or parse(docs))
    html = "<html><body>page " + "x" * 3000
    spark.createDataFrame([(i, html) for i in range(3)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    entry.queries()["sniff_reject"](spark, str(tmp_path))
    content = {r.page_id: r.content for r in seen[0].collect()}
    assert content[0] == html and content[2].endswith(html)


def test_html_to_texts_where_the_cut_goes_through_a_reference(spark, tmp_path):
    from wireloom.functions.text import html_to_text

    # the 2,048 characters end after 0 to 6 characters of a reference
    pages = [(i, f"<p>{'<b></b>' * 286}{'x' * (2043 - 2002 - i)}  {r} &quot;&lt; more</p>") for i, r in ((i, r) for r in ("&amp;", "&lt;", "&copy;", "&middot;") for i in range(9))]
    spark.createDataFrame([(k, html) for k, (_, html) in enumerate(pages)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.execute(entry.oracle_sql()["html_to_texts"]).fetchall())
    assert {t.split(" ")[-1] for _, t in want} >= {"&amp", "&lt", "&middot"}
    assert sorted(map(tuple, entry.queries()["html_to_texts"](spark, str(tmp_path)).collect())) == want
    # a feed's descriptions keep HTML's rule
    df = spark.createDataFrame([("<b>a &amp b &notit; c</b>",)], "t string")
    assert df.select(html_to_text(F.col("t")), html_to_text(F.col("t"), ended=True)).first() == ("a & b ¬it; c", "a &amp b ¬it; c")
