import gzip
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from wireloom.sources import fetch
from wireloom.sources.prepare import Rejected, encode_text, prepare
from wireloom.sources.xmltree import read, read_html, read_strict


def test_junk_and_marks():
    assert prepare(b"\n\xef\xbb\xbf<?xml version='1.0'?><a/>") == b"<?xml version='1.0'?><a/>"
    assert prepare(b"junk <RSS><x/></RSS>") == b"<RSS><x/></RSS>"
    assert prepare(b"  <other/>") == b"  <other/>"
    assert prepare("<?xml?><a>x y</a>".encode()) == b"<?xml?><a>x\ny</a>"
    for bad in (b"", b"<!DOCTYPE HTML><p>", b" <html>", b"text <body> text"):
        with pytest.raises(Rejected):
            prepare(bad)


def test_mending():
    got = prepare(b'<?xml?xml version="1.0" encoding="UTF-16" ??>\n<rss a=1><link href="x">\n <b/></rss>')
    assert got == b'<?xml version="1.0" encoding="utf-8" ?><rss a="1"><link href="x"/>\n <b/></rss>'
    assert encode_text('<?xml version="1.0" encoding="latin-1"?><a>é</a>') == '<?xml version="1.0" encoding="utf-8"?><a>é</a>'.encode()


def test_text_ends_at_the_first_child():
    root = read_strict(b"<a>x<![CDATA[ <y>]]><!-- c -->z<b>q</b>t</a>")
    assert root.text == "x <y>" and root.children[0].text == "q" and root.children[0].tail == "t"


def test_namespaces_and_serialising():
    root = read(b'<a xmlns="u" xmlns:p="v"><p:b p:c="1" d="2">x &amp; <i>y</i></p:b>tail</a>')
    b = root.children[0]
    assert (root.tag, b.tag, b.attrs) == ("{u}a", "{v}b", {"{v}c": "1", "d": "2"})
    assert b.serialise() == '<p:b xmlns="u" xmlns:p="v" p:c="1" d="2">x &amp; <i>y</i></p:b>tail'


@pytest.mark.parametrize(("raw", "want"), [
    (b"<a><b>x & y</b></a>", ["a", "b"]), (b"<a><p:b>1</p:b></a> junk <c/>", ["a", "p:b"]), (b"<a><b><c>x</a>", ["a", "b", "c"]), (b"<a></b><c/></a>", ["a", "c"]),
    (b"<a>\x01<b x=1 y='2'/></a>", ["a", "b"]), (b"<a>&nbsp;<b/></a>", ["a", "b"]), (b'<!DOCTYPE a [<!ENTITY e "v">]><a>&e;<b/></a>', ["a", "b"]),
])
def test_tolerance(raw, want):
    assert [e.tag for e in read(raw).iter()] == want


def test_what_cannot_be_read():
    assert read(b"no markup") is None
    assert [e.tag for e in read_html(b"<BODY><P>x<Br>y</p>").iter()] == ["html", "body", "p", "br"]


def test_bodies():
    raw = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    assert fetch.decode_body(gzip.compress(b"x"), "gzip") == b"x"
    assert fetch.decode_body(raw.compress(b"y") + raw.flush(), "deflate") == b"y"
    assert fetch.decode_body("é".encode("latin-1"), None, "latin-1") == "é".encode()
    assert fetch.decode_body(b"\xff", None, "utf-8") == b"\xff" == fetch.decode_body(b"\xff", None, "no-such")
    if fetch.brotli is None:
        assert "br" not in fetch.accepted_encodings()
        with pytest.raises(ValueError, match="brotli"):
            fetch.decode_body(b"x", "br")


REFRESHES = [
    ('<META http-equiv="Refresh" content="0; url=https://e.x/feed">', "https://e.x/feed"), ("<meta http-equiv=refresh content='0;URL=feed.xml'>", "https://b.x/a/feed.xml"),
    ("<p>none</p>", None), ('<meta http-equiv="refresh" content="0;url=https://b.x/a/">', None),
    ('<meta http-equiv="refresh" content="0;url=https://b.x/a/"><meta http-equiv="refresh" content="9;url=/z">', "https://b.x/z"),
]


@pytest.mark.parametrize(("html", "want"), REFRESHES)
def test_refresh(html, want):
    assert fetch.refresh_target(html, "https://b.x/a/") == want == fetch.refresh_target(html.encode(), "https://b.x/a/")


PAGES = {"/a": b'<html><meta http-equiv="refresh" content="0;url=/b"></html>', "/b": b'<html><meta http-equiv="refresh" content="0;url=/feed"></html>', "/feed": b"<rss><channel><title>T</title></channel></rss>",
         "/loop": b'<html><meta http-equiv="refresh" content="0;url=/pool"></html>', "/pool": b'<html><meta http-equiv="refresh" content="0;url=/loop"></html>'}


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = PAGES.get(self.path)
            self.send_response(200 if body else 404)
            if body:
                body = gzip.compress(body)
                self.send_header("Content-Encoding", "gzip")
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_fetching(spark, server):
    import json

    fetch.register(spark)
    got = spark.read.format("feed_url").option("urls", json.dumps([server + "/feed", server + "/gone"])).load().orderBy("source").collect()
    assert [(bytes(r.content) if r.content else None, bool(r.error)) for r in got] == [(PAGES["/feed"], False), (None, True)]
    df = spark.createDataFrame([(server + "/feed", 1), (server + "/gone", 2)], "source string, n int")
    assert [(r.n, r.error is None) for r in fetch.fetch_documents(df).orderBy("n").collect()] == [(1, True), (2, False)]


def test_following(spark, server):
    docs = spark.createDataFrame([(1, server + "/a", PAGES["/a"]), (2, server + "/feed", PAGES["/feed"]), (3, "no address", PAGES["/a"]), (4, server + "/loop", PAGES["/loop"])], "n int, source string, content binary")
    got = {r.n: (r.source, bytes(r.content)) for r in fetch.follow_refreshes(docs).collect()}
    assert got[1] == (server + "/feed", PAGES["/feed"]) and got[2] == (server + "/feed", PAGES["/feed"]) and got[3] == ("no address", PAGES["/a"]) and len(got) == 4


def test_cache(spark, tmp_path):
    import hashlib

    urls = ["http://a/1", "http://a/2"]
    (tmp_path / hashlib.sha256(urls[0].encode()).hexdigest()[:16]).write_bytes(b"x")
    have, lack = fetch.cached(spark.createDataFrame([(u,) for u in urls], "source string"), str(tmp_path))
    assert [(r.source, bytes(r.content)) for r in have.collect()] == [(urls[0], b"x")] and [r.source for r in lack.collect()] == urls[1:]


def test_columns(spark):
    from wireloom.functions.text import html_to_text, lenient_int, local_name, url_join, ustrip

    df = spark.createDataFrame([("  <p>a&amp;b</p>\n c ", " 12 ", "{u}Na:me"), ("a &amp; b", "12.5", "P:Name"), (None, None, None)], "t string, n string, tag string")
    got = df.select(html_to_text(F.col("t")), lenient_int(F.col("n")), local_name(F.col("tag")), ustrip(F.col("n")), url_join(F.lit("http://a/b/c"), F.lit("../d"))).collect()
    assert [tuple(r)[:4] for r in got] == [("a&b c", 12, "na:me", "12"), ("a &amp; b", None, "name", "12.5"), (None, None, None, None)] and got[0][4] == "http://a/d"


def test_addresses_and_documents(spark, server):
    from wireloom.plans.api import parse_sources

    rows = [(1, server + "/a"), (2, server + "/gone"), (3, "<rss><channel><title>inline</title><item/></channel></rss>"), (4, None)]
    p = parse_sources(spark.createDataFrame(rows, "n int, where string"), "where")
    got = {r.n: r for r in p.feeds.collect()}
    assert (got[1].title, got[1]["where"], got[3].title, got[3]["where"]) == ("T", server + "/feed", "inline", None)
    assert got[2].error.message.startswith("HTTPError") and got[4].error.message == "Empty content"
    assert [r.n for r in p.entries.collect()] == [3]


def test_each_address_is_fetched_once(spark, tmp_path):
    from wireloom.plans.api import parse_sources

    log = str(tmp_path / "log")

    def get(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        return PAGES["/" + url.rsplit("/", 1)[1]]

    rows = [(1, "http://h/a"), (2, "http://h/gone"), (3, "<rss><channel><title>inline</title></channel></rss>")]
    p = parse_sources(spark.createDataFrame(rows, "n int, source string"), get=get)
    assert {r.n: (r.title, r.source) for r in p.feeds.collect()} == {1: ("T", "http://h/feed"), 2: (None, "http://h/gone"), 3: ("inline", None)}
    assert p.feeds.count() == 3 and p.entries.count() == 0
    assert sorted(open(log).read().split()) == [f"http://h/{x}" for x in ("a", "b", "feed", "gone")]


def test_fill_cache(spark, tmp_path):
    folder, log = tmp_path / "cache", str(tmp_path / "log")
    folder.mkdir()

    def get(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if "gone" in url:
            raise OSError("gone")
        return url.encode()

    urls = spark.createDataFrame([(1, "http://a/1"), (2, "http://a/2"), (3, "http://a/2"), (4, "http://a/gone"), (5, None)], "n int, source string")
    for _ in range(2):
        got = {r.n: (r.content and bytes(r.content).decode(), r.error) for r in fetch.fill_cache(urls, str(folder), get).collect()}
        assert got == {1: ("http://a/1", None), 2: ("http://a/2", None), 3: ("http://a/2", None), 4: (None, "OSError: gone")}
    assert sorted(open(log).read().split()) == ["http://a/1", "http://a/2", "http://a/gone", "http://a/gone"]
    assert len([x for x in folder.iterdir() if not x.name.startswith((".", "_"))]) == 2
