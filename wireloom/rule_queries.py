"""Queries for single rules, registered beside those of queries.py."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from .functions.dates import normalize_date
from .plans.api import parse_documents, parse_sources
from .plans.records import records
from .queries import ATOM, RSS, _cat, _documents, _el, _id, _table, _x, query
from .sources.fetch import decode_body


def _links(column: str = "links"):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(" ", x["rel"], x["type"], x["href"])), "|")


@query("""SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'urn:' || n_nationkey END AS id, n_name AS title, 'text/plain' AS title_type, CASE n_nationkey % 2 WHEN 0 THEN 'en' END AS language,
  CASE n_nationkey % 2 WHEN 0 THEN 'http://b/' END AS base, CASE n_nationkey % 2 WHEN 1 THEN 'about' END AS subtitle FROM nation""")
def feed_details(spark, sf_dir):
    """Details of titles and subtitles, the feed's id, and texts that end at a comment."""
    k, n = F.col("n_nationkey"), _x("n_name")
    atom = _cat('<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en" xml:base="http://b/"><id>urn:', k, "</id><!-- note --><title>", n, "<!-- cut -->rest</title></feed>")
    rss = _cat(RSS[0].replace("<title>t</title>", ""), "<title>", n, "</title><description>about</description><id>no</id>", RSS[1])
    f = parse_documents(_table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 2 == 0, atom).otherwise(rss).alias("content"))).feeds
    return f.select("n_nationkey", "id", F.col("title_detail.value").alias("title"), F.col("title_detail.type").alias("title_type"), F.col("title_detail.language").alias("language"),
                    F.col("title_detail.base").alias("base"), F.col("subtitle_detail.value").alias("subtitle"))


@query("""SELECT p_partkey, 'http://p/' || p_partkey AS id, 'alternate http://p/' || p_partkey || '|enclosure audio/mpeg http://f/' || p_partkey AS links, p_brand AS term, 's' AS scheme, 'L' AS label, 1 AS tags,
  'http://e/' || p_partkey AS url, p_size::BIGINT AS length, 'html' AS content_type, p_type AS content, p_brand AS author FROM part""")
def atom_details(spark, sf_dir):
    """Atom entries without id, with categories, links and elements that are enclosures, contents and authors."""
    k = F.col("p_partkey")
    entry = _el("entry", _cat('<link rel="alternate" href="http://p/', k, '"/><link rel="enclosure" type="audio/mpeg" href="http://f/', k, '"/><category term="', _x("p_brand"), '" scheme="s" label="L"/><category term=""/>'),
                _cat('<enclosure xmlns="" url="http://e/', k, '" length="', F.col("p_size"), '"/>'), _el('content type="html"', _x("p_type")), _el("author", _el("name", _x("p_brand"))))
    e = parse_documents(_documents(_table(spark, sf_dir, "part"), "p_partkey", entry, *ATOM)).entries
    tag, file, content = F.get("tags", F.lit(0)), F.get("enclosures", F.lit(0)), F.get("content", F.lit(0))
    return e.select(_id().alias("p_partkey"), "id", _links().alias("links"), tag["term"].alias("term"), tag["scheme"].alias("scheme"), tag["label"].alias("label"), F.size("tags").alias("tags"),
                    file["url"].alias("url"), file["length"].alias("length"), content["type"].alias("content_type"), content["value"].alias("content"), F.get("authors", F.lit(0))["name"].alias("author"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'M ' || p_name ELSE p_name END AS title, CASE WHEN p_partkey % 3 <> 0 THEN 'http://l/' || p_partkey END AS link,
  'http://c/' || p_partkey AS comments, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'maker' END AS author FROM part""")
def rss_first_local(spark, sf_dir):
    """Of the elements with one local name the first counts, whatever its namespace; an Atom link hides a link after it."""
    k = F.col("p_partkey")
    title = F.when(k % 2 == 0, F.concat(_el("media:title", "M ", _x("p_name")), F.lit("<title>plain</title>"))).otherwise(F.concat(_el("title", _x("p_name")), F.lit("<media:title>M</media:title>")))
    author = F.when(k % 2 == 0, F.concat(_el("author", _x("p_brand")), F.lit("<dc:creator>maker</dc:creator>"))).otherwise(F.lit("<dc:creator>maker</dc:creator>"))
    link = F.concat(F.when(k % 3 == 0, F.lit('<atom:link rel="self" href="http://s"/>')).otherwise(F.lit("")), _el("link", "http://l/", k))
    item = _el("item", _el("guid", "p", k), title, link, _el("comments", "http://c/", k), author)
    e = parse_documents(_documents(_table(spark, sf_dir, "part"), "p_partkey", item, *RSS)).entries
    return e.select(_id().alias("p_partkey"), "title", "link", "comments", "author")


@query("""SELECT n_nationkey, 'json' AS feed_type, n_name AS title, 'http://h/' || n_nationkey AS link, 'about' AS subtitle, 'http://f/' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'en' END AS language,
  'http://i' AS icon, 'http://v' AS favicon, 'boss' AS author, 'alternate text/html http://h/' || n_nationkey || '|self application/json http://f/' || n_nationkey AS links FROM nation""")
def json_meta(spark, sf_dir):
    """JSON Feeds' own fields and links."""
    k = F.col("n_nationkey")
    fields = [F.lit("https://jsonfeed.org/version/1").alias("version"), F.col("n_name").alias("title"), _cat("http://h/", k).alias("home_page_url"), _cat("http://f/", k).alias("feed_url"), F.lit("about").alias("description"),
              F.when(k % 2 == 0, F.lit("en")).alias("language"), F.lit("http://i").alias("icon"), F.lit("http://v").alias("favicon"), F.array(F.struct(F.lit("boss").alias("name")), F.struct(F.lit("clerk").alias("name"))).alias("authors"),
              F.array().cast("array<string>").alias("items")]
    f = parse_documents(_table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(*fields)).alias("content"))).feeds
    return f.select("n_nationkey", "feed_type", "title", "link", "subtitle", "id", "language", "icon", "favicon", "author", _links().alias("links"))


@query("""SELECT p_partkey, 'http://i/' || p_partkey AS image, CASE WHEN p_partkey % 3 = 0 THEN 'http://b/' || p_partkey END AS banner_image,
  'alternate text/html http://u/' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '|related text/html http://x/' || p_partkey ELSE '' END AS links FROM part""")
def json_links(spark, sf_dir):
    """JSON items' images, which no flag turns off, and links."""
    k = F.col("p_partkey")
    item = F.to_json(F.struct(_cat("p", k).alias("id"), _cat("http://u/", k).alias("url"), F.when(k % 2 == 0, _cat("http://x/", k)).alias("external_url"), _cat("http://i/", k).alias("image"),
                              F.when(k % 3 == 0, _cat("http://b/", k)).alias("banner_image")))
    rows = _table(spark, sf_dir, "part").select(F.floor(k / 50).alias("feed_id"), item.alias("x"))
    docs = rows.groupBy("feed_id").agg(F.concat(F.lit('{"version": "https://jsonfeed.org/version/1.1", "items": ['), F.array_join(F.collect_list("x"), ","), F.lit("]}")).alias("content"))
    e = parse_documents(docs, include_media=False).entries
    return e.select(_id().alias("p_partkey"), "image", "banner_image", _links().alias("links"))


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN n_name WHEN 2 THEN n_name || chr(10) || 'b' END AS title, CASE n_nationkey % 6 WHEN 1 THEN 'Unknown feed type: note' WHEN 3 THEN 'Empty content' WHEN 5 THEN 'Empty content'
  WHEN 4 THEN 'Failed to parse XML: received content that couldn''t be parsed as XML (first 200 chars: words of ' || n_name || ')' END AS message FROM nation""")
def odd_starts(spark, sf_dir):
    """A byte order mark behind spaces, unknown roots behind spaces, line separators, nothing, and words."""
    k, n = F.col("n_nationkey") % 6, _x("n_name")
    rss = lambda *title: _cat("<rss><channel><title>", *title, "</title></channel></rss>")
    content = (F.when(k == 0, F.concat(F.lit(" \n﻿"), rss(n))).when(k == 1, F.lit("  <note/>")).when(k == 2, rss(n, " b")).when(k == 3, F.lit("")).when(k == 4, F.concat(F.lit("words of "), F.col("n_name"))))
    f = parse_documents(_table(spark, sf_dir, "nation").select("n_nationkey", F.encode(content, "UTF-8").alias("content"))).feeds
    return f.select("n_nationkey", "title", F.col("error.message").alias("message"))


@query("SELECT n_nationkey, n_name AS title, 'http://x/' || n_nationkey AS link, 'v ' || n_nationkey AS summary FROM nation")
def unclosed_links(spark, sf_dir):
    """Links left open before the next line's tag, in a document whose declaration is doubled."""
    k, n = F.col("n_nationkey"), _x("n_name")
    atom = _cat("<?xml?xml version='1.0' ??>\n<feed xmlns='http://www.w3.org/2005/Atom'><title>t</title><entry>\n<link href=\"http://x/", k, "\">\n  <title>", n, "</title><summary>v ", k, "</summary></entry></feed>")
    e = parse_documents(_table(spark, sf_dir, "nation").select("n_nationkey", F.encode(atom, "UTF-8").alias("content"))).entries
    return e.select("n_nationkey", "title", "link", F.col("description").alias("summary"))


def _served(url: str) -> bytes:
    """Made-up servers: compressed Latin-1 with a declared charset, raw deflate, a page that sends the reader on, an error."""
    host, key = url.split("/")[2:4]
    if host == "gone":
        raise OSError("gone")
    if host == "moved":
        return f'<html><head><meta http-equiv="refresh" content="0; url=http://feeds/{key}"></head></html>'.encode()
    feed = f'<?xml version="1.0" encoding="iso-8859-1"?><rss><channel><title>é {key}</title><item><title>i</title></item></channel></rss>'
    return decode_body(gzip.compress(feed.encode("latin-1")), "gzip", "iso-8859-1")


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 3 THEN NULL ELSE 'é ' || n_nationkey END AS title, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 'http://gone/' || n_nationkey ELSE 'http://feeds/' || n_nationkey END AS source,
  CASE WHEN n_nationkey % 4 = 3 THEN 'OSError: gone' END AS message FROM nation""")
def fetched_sources(spark, sf_dir):
    """Addresses and documents in one column: bodies are decompressed and decoded, pages that send the reader on are followed."""
    k = F.col("n_nationkey")
    given = _cat("<rss><channel><title>", _x("n_name"), "</title></channel></rss>")
    source = F.when(k % 4 == 0, given).when(k % 4 == 1, _cat("http://feeds/", k)).when(k % 4 == 2, _cat("http://moved/", k)).otherwise(_cat("http://gone/", k))
    f = parse_sources(_table(spark, sf_dir, "nation").select("n_nationkey", source.alias("source")), get=_served).feeds
    return f.select("n_nationkey", "title", "source", F.col("error.message").alias("message"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '2024-01-' || (30 + c_custkey % 60) || 'T12:61:00+00:00' WHEN 1 THEN '2024-01-05T15:00:00+00:00' WHEN 2 THEN '2024-01-02T04:30:00+00:00'
  WHEN 3 THEN '2024-01-15T10:30:00+00:00' ELSE '2024-03-01T05:30:07+00:00' END AS iso FROM customer""")
def loose_dates(spark, sf_dir):
    """Impossible moments at offset zero, loose shapes, names of zones, fractions of zero, and hour 24 in a zone."""
    k = F.col("c_custkey") % 5
    text = (F.when(k == 0, _cat("Mon, ", 30 + F.col("c_custkey") % 60, " Jan 2024 12:61:00 GMT")).when(k == 1, F.lit("January 5, 2024 3pm")).when(k == 2, F.lit("Tue, 02 Jan 2024 10:00:00 IST"))
            .when(k == 3, F.lit("2024-01-15T10:30:00.000000Z")).otherwise(F.lit("Thu, 29 Feb 2024 24:30:07 -0500")))
    return _table(spark, sf_dir, "customer").select("c_custkey", normalize_date(text).alias("iso"))


@query("""SELECT r_regionkey, '{"feed":{"title":"' || r_name || '","link":"http://h","language":null,"id":null,"title_detail":{"type":"text/plain","language":null,"base":null,"value":"' || r_name
  || '"},"links":[{"rel":"alternate","type":"text/html","href":"http://h"},{"rel":"alternate","type":null,"href":"http://h","title":null}]},"entries":[{"id":"g","title":"' || r_name || '","description":"d","content":[{"type":"text/html","language":null,"base":null,"value":"d"}],"links":[]}]}' AS record FROM region""")
def feed_records(spark, sf_dir):
    """Nested records: absent fields are left out, and links made up by the rules have no title."""
    doc = _cat(RSS[0].replace("<title>t</title>", ""), "<title>", _x("r_name"), '</title><atom:link rel="alternate" href="http://h"/><item><guid>g</guid><title>', _x("r_name"), "</title><description>d</description></item>", RSS[1])
    p = parse_documents(_table(spark, sf_dir, "region").select("r_regionkey", doc.alias("content")))
    return records(p.feeds, p.entries, ["r_regionkey"])
