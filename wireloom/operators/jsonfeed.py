"""JSON Feed, in built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import with_first_dates
from ..functions.text import first_nonempty, lenient_int, nonempty
from ..names import ENCLOSURE, LINK, TAG, TEXT_DETAIL
from . import nested
from .entries import ENTRY, Flags
from .feeds import FEED

#: Scalars of any type are read as text.
_AUTHOR = "struct<name:string>"
_ATTACHMENT = "struct<url:string,mime_type:string,size_in_bytes:string>"
_ITEM = (
    f"struct<id:string,url:string,external_url:string,title:string,content_html:string,content_text:string,summary:string,date_published:string,date_modified:string,"
    f"image:string,banner_image:string,authors:array<{_AUTHOR}>,author:{_AUTHOR},tags:array<string>,attachments:array<{_ATTACHMENT}>>"
)
SCHEMA = (
    f"struct<version:string,title:string,home_page_url:string,feed_url:string,description:string,language:string,icon:string,favicon:string,authors:array<{_AUTHOR}>,items:array<{_ITEM}>>"
)
#: How much of a text serves as description.
TEXT_CHARS = 512


def is_json_feed(text: Column) -> Column:
    """Whether a text is a JSON object with a version of JSON Feed or a list of items."""
    starts = text.rlike(r"^[ \t\n\r\x0b\f]*+\{")
    value = F.try_parse_json(F.when(starts, text))
    version, items = F.try_variant_get(value, "$.version", "string"), F.schema_of_variant(F.try_variant_get(value, "$.items", "variant"))
    kind = F.schema_of_variant(F.try_variant_get(value, "$.version", "variant"))
    return F.coalesce(((kind == "STRING") & version.contains("jsonfeed.org")) | items.startswith("ARRAY"), F.lit(False))


def parse_json(text: Column) -> Column:
    """A JSON Feed's fields; what does not fit its type is null."""
    return F.from_json(text, SCHEMA)


def _link(rel: str, kind: str, href: Column) -> Column:
    return F.when(nonempty(href).isNotNull(), nested.struct(LINK, rel=F.lit(rel), type=F.lit(kind), href=href))


def json_feeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, json) -> keys, feed_type, atom_ns, error and the fields of a feed."""
    j = F.col("json")
    text = lambda n: F.coalesce(j[n], F.lit(""))
    author = F.when(F.size(j["authors"]) > 0, F.coalesce(F.get(j["authors"], F.lit(0))["name"], F.lit("")))
    values = {
        "title": text("title"), "link": text("home_page_url"), "subtitle": text("description"), "id": text("feed_url"), "language": j["language"],
        "icon": nonempty(j["icon"]), "favicon": nonempty(j["favicon"]), "author": author,
        "links": F.array_compact(F.array(_link("alternate", "text/html", j["home_page_url"]), _link("self", "application/json", j["feed_url"]))),
    }
    fields = [(values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in FEED.items()]
    return rows.select(*keys, F.lit("json").alias("feed_type"), F.lit(None).cast("string").alias("atom_ns"), *fields, F.lit(None).cast("struct<class:string,message:string>").alias("error"))


def json_entries(rows: DataFrame, keys: list[str], flags: Flags) -> DataFrame:
    """rows (keys, json) -> keys, pos and the fields of every item. Values are not stripped, dates don't stand in for one another."""
    rows = rows.select(*keys, F.posexplode("json.items").alias("pos", "i")).where("i is not null")
    i = F.col("i")
    html, plain, summary = nonempty(i["content_html"]), nonempty(i["content_text"]), F.coalesce(i["summary"], F.lit(""))
    content = F.when(html.isNotNull(), F.array(nested.struct(TEXT_DETAIL, type=F.lit("text/html"), value=html)))
    content = content.when(plain.isNotNull(), F.array(nested.struct(TEXT_DETAIL, type=F.lit("text/plain"), value=plain)))
    described = F.when(html.isNull() & plain.isNotNull(), first_nonempty(summary, F.left(plain, F.lit(TEXT_CHARS)))).otherwise(summary)
    author = F.when(F.size(i["authors"]) > 0, F.coalesce(F.get(i["authors"], F.lit(0))["name"], F.lit(""))).otherwise(F.when(i["author"].isNotNull(), F.coalesce(i["author"]["name"], F.lit(""))))
    files = F.filter(i["attachments"], lambda a: nonempty(a["url"]).isNotNull())
    files = F.transform(files, lambda a: nested.struct(ENCLOSURE, url=a["url"], type=F.coalesce(a["mime_type"], F.lit("")), length=F.nullif(lenient_int(a["size_in_bytes"]), F.lit(0).cast("bigint"))))
    none = F.lit(None).cast("string")
    rows = with_first_dates(rows, {"published": (nonempty(i["date_published"]), none), "updated": (nonempty(i["date_modified"]), none)})
    values = {
        "id": F.coalesce(i["id"], i["url"], F.lit("")), "title": F.coalesce(i["title"], F.lit("")), "link": F.coalesce(i["url"], F.lit("")), "description": described,
        "published": F.col("published"), "updated": F.col("updated"), "author": author,
        "image": nonempty(i["image"]), "banner_image": nonempty(i["banner_image"]),
        "content": content if flags.content else nested.no(TEXT_DETAIL),
        "links": F.array_compact(F.array(_link("alternate", "text/html", i["url"]), _link("related", "text/html", i["external_url"]))),
        "tags": nested.unless_empty(F.transform(i["tags"], lambda t: nested.struct(TAG, term=t))) if flags.tags else nested.no(TAG),
        "enclosures": nested.unless_empty(files) if flags.enclosures else nested.no(ENCLOSURE),
    }
    return rows.select(*keys, "pos", *[(values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in ENTRY.items()])
