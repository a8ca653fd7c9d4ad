import json

import pytest

from wireloom.plans.api import parse_documents
from wireloom.plans import report


def parse(spark, *contents, **options):
    kind = "binary" if isinstance(contents[0], bytes) else "string"
    p = parse_documents(spark.createDataFrame(list(enumerate(contents)), f"n int, content {kind}"), **options)
    feeds = {r.n: r for r in p.feeds.collect()}
    return [(feeds[i], [e for e in p.entries.where(f"n = {i}").orderBy("pos").collect()]) for i in range(len(contents))]


RSS = '<rss xmlns:atom="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:itunes="i"><channel>{}</channel></rss>'


def test_first_local_name_counts(spark):
    (_, [e]), = parse(spark, RSS.format("<item><itunes:title/><title>late</title><atom:link href='http://l'/><link>http://hidden</link><itunes:author>A</itunes:author><author>B</author></item>"))
    assert (e.title, e.link, e.author, [x.href for x in e.links]) == ("", None, "A", ["http://l"])
    assert e.author_detail.name == "A" and [a.name for a in e.authors] == ["A"]


def test_text_before_a_comment(spark):
    (f, [e]), = parse(spark, RSS.format("<title>A<!-- x -->B</title><item><title>C<!-- --></title><description>  </description></item>"))
    assert (f.title, e.title, e.description) == ("A", "C", "")


def test_media(spark):
    thumbs = '<item><media:thumbnail url="t" width="5" height="x"/></item>'
    own = '<item><media:group><media:content url="u" width="7"><media:description>own</media:description></media:content><media:content/><media:description>group</media:description><media:credit scheme="s">c</media:credit></media:group></item>'
    beside = '<item><media:content url="v"/><media:description> beside </media:description></item>'
    (_, (a, b, c)), = parse(spark, RSS.format(thumbs + own + beside))
    assert [(m.url, m.type, m.width, m.height) for m in a.media_content] == [("t", "image/jpeg", 5, None)]
    assert [(m.url, m.width, m.description, m.credit, m.credit_scheme) for m in b.media_content] == [("u", 7, "own", "c", "s"), (None, None, "group", "c", "s")]
    assert c.media_content[0].description == "beside"
    (_, [e]), = parse(spark, '<rss xmlns:m="http://search.yahoo.com/mrss/"><channel><item><m:x/></item></channel></rss>')
    assert e.media_content is None


def test_atom_versions_and_content(spark):
    one = '<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en" xml:base="http://b/"><title>T</title><generator uri="http://g" version="2">G</generator><category term="c" label="l"/><entry><id/><id>i</id><link href=" http://first " rel="self"/><link rel="enclosure" href="http://enc"/><author><name/></author><author><name> N </name></author><published>soon</published><issued>2024-01-02</issued><content type="xhtml" xml:lang="fr"><div>x <b>y</b></div></content><category term=""/><category term="z" scheme="s"/></entry></feed>'
    old = '<feed xmlns="http://purl.org/atom/ns#"><title>T</title><modified>2024</modified><entry><title>t</title><issued>2024-01-01T00:00:00Z</issued><modified>2024-01-02T00:00:00Z</modified></entry></feed>'
    (f, [e]), (g, [h]) = parse(spark, one, old)
    assert (f.feed_type, f.language, f.title_detail.base, f.generator_detail.version, f.generator_detail.href, f.tags[0].label) == ("atom", "en", "http://b/", "2", "http://g", "l")
    assert (e.id, e.link, e.author, e.published, [t.term for t in e.tags]) == ("i", "http://first", "N", "2024-01-02T00:00:00+00:00", ["z"])
    assert [x.rel for x in e.links] == ["enclosure"]
    assert e.content[0].value.startswith("<content ") and "<b>y</b>" in e.content[0].value and e.content[0].language == "fr" and e.description == "x y"
    assert (g.updated, h.published, h.updated) == ("2024", "2024-01-01T00:00:00+00:00", "2024-01-02T00:00:00+00:00")


def test_rdf(spark):
    doc = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:t="http://purl.org/rss/1.0/modules/taxonomy/"><channel><title> C </title><link>http://c</link></channel><item rdf:about="http://i"><title>x</title><link>http://l</link><dc:date>never</dc:date><description> d </description><dc:creator>me</dc:creator><t:topic rdf:resource="r"/><t:topic>w</t:topic></item></rdf:RDF>'
    (f, [e]), = parse(spark, doc)
    assert (f.feed_type, f.title, f.link) == ("rdf", "C", "http://c")
    assert (e.id, e.link, e.published, e.description, e.author, e.content) == ("http://i", "http://l", None, "d", "me", None)
    assert [(t.term, t.scheme) for t in e.tags] == [("r", "r"), ("w", None)]


def test_json(spark):
    item = {"url": "http://u", "external_url": "http://x", "content_text": "t" * 600, "date_modified": "2024-01-01", "author": {"name": "old"}, "image": "i", "attachments": [{"url": ""}, {"url": "f", "size_in_bytes": 0}], "tags": ["a", "b"]}
    feed = {"version": "https://jsonfeed.org/version/1", "title": "T", "home_page_url": "http://h", "feed_url": "http://f", "icon": "", "favicon": "v", "authors": [{"name": "A"}], "items": [item, {"id": 7, "content_html": "<p>"}]}
    plain = '  {"items": [{"title": " kept "}]}'
    (f, (a, b)), (_, [c]), (bad, none), (other, _) = parse(spark, json.dumps(feed), plain, '{"items": 3}', "{broken")
    assert (f.feed_type, f.title, f.id, f.icon, f.favicon, f.author, [x.rel for x in f.links]) == ("json", "T", "http://f", None, "v", "A", ["alternate", "self"])
    assert (a.id, a.link, len(a.description), a.published, a.updated, a.author, a.image) == ("http://u", "http://u", 512, None, "2024-01-01T00:00:00+00:00", "old", "i")
    assert ([x.rel for x in a.links], [t.term for t in a.tags], [(x.url, x.type, x.length) for x in a.enclosures], a.content[0].type) == (["alternate", "related"], ["a", "b"], [("f", "", None)], "text/plain")
    assert (b.id, b.description, b.content[0].value) == ("7", "", "<p>") and c.title == " kept "
    assert bad.error is not None and other.error is not None and none == []


def test_errors_and_modes(spark):
    docs = spark.createDataFrame([(1, "<rss><channel><title>t</title></channel></rss>"), (2, "<html>"), (3, None), (4, ""), (5, "plain")], "n int, content string")
    feeds = {r.n: r for r in parse_documents(docs).feeds.collect()}
    assert feeds[1].error is None and "HTML" in feeds[2].error.message and feeds[3].error.message == feeds[4].error.message == "Empty content" and "couldn't be parsed" in feeds[5].error.message
    assert [r.n for r in parse_documents(docs, mode="DROPMALFORMED").feeds.collect()] == [1]
    with pytest.raises(Exception, match="Empty content|HTML|parsed"):
        parse_documents(docs, mode="FAILFAST").feeds.collect()
    with pytest.raises(ValueError):
        parse_documents(docs, mode="SOME")


def test_keys_and_clashing_columns(spark):
    docs = spark.createDataFrame([("x", 1, "t", "<rss><channel><title>T</title><item/></channel></rss>")], "feed string, pos_ int, extra string, body string")
    p = parse_documents(docs, "body", ["feed"])
    assert p.feeds.columns[0] == "feed" and "extra" not in p.entries.columns and p.entries.count() == 1


def test_no_shuffle_and_one_python_pass(spark):
    docs = spark.createDataFrame([(1, "<rss/>")], "n int, content string")
    plan = parse_documents(docs).entries._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_stream(spark, tmp_path):
    from wireloom.streaming import document_stream, entries_by_window, parse_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(RSS.format("<item><pubDate>Mon, 01 Jan 2024 12:00:00 GMT</pubDate></item><item/>"))
    entries = parse_stream(document_stream(spark, str(tmp_path / "in"), "*.xml")).entries
    q = entries.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("streamed").count() == 2
    counts = entries_by_window(entries).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    counts.awaitTermination(120)
    assert [r.entries for r in spark.table("windows").collect()] == [1]


def test_reports(spark):
    rows = [(1, "a", 1.0, 2), (1, "a", 3.0, 2), (1, "a", 2.0, 2), (1, "b", 4.0, 3), (2, "a", 0.0, 0), (2, "b", 1.0, 1), (3, "a", 1.0, 1), (3, "b", 1.0, 1)]
    c = report.compare(report.per_feed(spark.createDataFrame(rows, "feed_id int, system string, secs double, entries int")), "a", "b")
    assert {r.feed_id: (r.our_secs, r.speedup) for r in c.collect()} == {1: (2.0, 2.0), 2: (0.0, None), 3: (1.0, 1.0)}
    assert [(r.feed_id, r.difference) for r in report.mismatches(c).orderBy("feed_id").collect()] == [(1, -1), (2, -1)]
    assert [r.feed_id for r in report.slowest(c).collect()] == [3]
    t = report.totals(c).collect()[0]
    assert (t.feeds, t.our_secs, t.speedup) == (2, 3.0, 5.0 / 3.0)


def test_records(spark):
    from wireloom.plans.records import records

    docs = spark.createDataFrame([(1, RSS.format("<title>T</title><item><title>a \"b\"</title><category>c</category><media:content url='u'/></item><item/>")), (2, "<html>"), (3, '{"items": []}')], "n int, content string")
    p = parse_documents(docs)
    got = {r.n: json.loads(r.record) for r in records(p.feeds, p.entries, ["n"]).collect()}
    assert set(got) == {1, 3}
    assert got[1]["feed"]["title"] == "T" and got[1]["feed"]["language"] is None and got[1]["feed"]["links"] == [] and "link" not in got[1]["feed"]
    first, second = got[1]["entries"]
    assert first == {"title": 'a "b"', "description": "", "links": [], "tags": [{"term": "c", "scheme": None, "label": None}], "media_content": [{"url": "u"}]}
    assert second == {"title": "", "description": "", "links": []} and got[3]["entries"] == []
