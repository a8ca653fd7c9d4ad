"""Entries of RSS, Atom and RDF feeds from their nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_timestamp, with_first_dates
from ..functions.text import first_nonempty, is_http_url, nonempty, ustrip
from ..names import ATOM, ATOM_03, CONTENT, DC, DC_TERMS, ENCLOSURE, MEDIA_ITEM, RDF, RSS_1, TAG, TEXT_DETAIL, q
from . import nested
from .nodes import Getter, attr, first, first_text, tagged, text_of, text_of_any


@dataclass(frozen=True)
class Flags:
    """Column groups that may be left out; what is out is not computed."""

    content: bool = True
    tags: bool = True
    media: bool = True
    enclosures: bool = True


#: Fields of an entry in their order, and their types.
ENTRY = {
    "id": "string", "title": "string", "link": "string", "description": "string", "published": "string", "updated": "string", "author": "string", "comments": "string",
    "image": "string", "banner_image": "string", "content": f"array<{TEXT_DETAIL}>", "links": f"array<{nested.LINK}>", "tags": f"array<{TAG}>",
    "media_content": f"array<{MEDIA_ITEM}>", "enclosures": f"array<{ENCLOSURE}>",
}


def _atom(name: str) -> Column:
    """A tag in the feed's Atom namespace."""
    return F.concat(F.lit("{"), F.coalesce("atom_ns", F.lit(ATOM)), F.lit("}" + name))


def _media(flags: Flags) -> Column:
    return F.when(F.col("has_media"), nested.media_items(F.col("item.nodes"))) if flags.media else nested.no(MEDIA_ITEM)


def _permalink(guid: Column) -> Column:
    return F.coalesce(attr(guid, "isPermaLink") == "true", F.lit(False))


#: What the rules of each vocabulary read from an entry's nodes. Dates are texts here: alt stands in for a published that
#: can't be read, alt_updated for an updated; blocked keeps updated from standing in for published. node and fallback are
#: where the content is. found: link and links by the Atom links, or null.
SOURCES = ("id", "title", "own_link", "found", "description", "published", "alt", "blocked", "updated", "alt_updated", "author", "comments", "node", "fallback", "tags")


def rss_sources(flags: Flags) -> dict[str, Column]:
    """RSS: of elements with one local name the first counts, even without text."""
    kids, item = F.col("kids"), F.col("item")
    guid, element, own = text_of(kids, "guid"), first(kids, tagged("guid")), ustrip(text_of(kids, "link"))
    links = F.filter(kids, tagged(_atom("link")))
    name = first(F.col("grand"), lambda n: (n["up"] == _atom("author")) & (n["tag"] == _atom("name")))["text"]
    return {
        "id": ustrip(F.coalesce(first(kids, tagged(_atom("id")))["text"], guid, nonempty(attr(item, q(RDF, "about"))))),
        "title": ustrip(text_of(kids, "title")),
        "own_link": F.coalesce(own, F.when(is_http_url(guid), guid)),
        "found": F.when(F.exists(kids, tagged(_atom("link"))), nested.entry_links(links, own, ustrip(element["text"]), _permalink(element))),
        "description": ustrip(text_of_any(kids, "description", "summary")),
        "published": text_of_any(kids, "pubdate", "published", "issued", "date"),
        "alt": F.when(~is_http_url(guid), guid),
        "updated": text_of_any(kids, "lastbuilddate", "updated", "modified"),
        "author": F.coalesce(ustrip(text_of_any(kids, "author", "creator")), nonempty(ustrip(name))),
        "comments": ustrip(text_of(kids, "comments")),
        "node": F.coalesce(first(kids, tagged(q(CONTENT, "encoded"))), first(kids, tagged("content"))),
        "fallback": first_text(kids, "description"),
        "tags": nested.rss_tags(kids, True) if flags.tags else nested.no(TAG),
    }


def atom_sources(flags: Flags) -> dict[str, Column]:
    """Atom: of elements with one tag the first that has text counts. Version 0.3 has other names for its dates."""
    kids = F.col("kids")
    old = F.coalesce(F.col("atom_ns") == ATOM_03, F.lit(False))
    date = lambda then, now: first_text(kids, F.when(old, _atom(then)).otherwise(_atom(now)))
    links = F.filter(kids, tagged(_atom("link")))
    own = nonempty(ustrip(attr(first(links, lambda n: nonempty(attr(n, "href")).isNotNull()), "href")))
    # the first name of an author, of the first author whose first name has text
    name = first(F.col("grand"), lambda n: (n["up"] == _atom("author")) & (n["tag"] == _atom("name")) & (n["nth"] == 0) & n["text"].isNotNull())["text"]
    return {
        "id": ustrip(first_text(kids, _atom("id"))), "title": ustrip(first_text(kids, _atom("title"))), "found": nested.entry_links(links, own),
        "description": ustrip(first_text(kids, _atom("summary"))),
        "published": date("issued", "published"), "alt": date("published", "issued"), "updated": date("modified", "updated"), "alt_updated": date("updated", "modified"),
        "author": nonempty(ustrip(name)), "node": first(kids, tagged(_atom("content"))), "tags": nested.atom_tags(kids, _atom("category")) if flags.tags else nested.no(TAG),
    }


def rdf_sources(flags: Flags) -> dict[str, Column]:
    """RDF: there is never any content; a date that is there but can't be read keeps others from taking its place."""
    kids = F.col("kids")
    get = Getter(kids, F.col("grand"))
    guid, element = nonempty(get.plain("guid")), first(kids, tagged("guid"))
    published = F.coalesce(nonempty(get.tag(q(DC, "date"))), nonempty(get.tag(q(ATOM, "issued"))))
    own = nonempty(get.tag(q(RSS_1, "link")))
    return {
        "id": ustrip(F.coalesce(nonempty(get.tag(q(ATOM, "id"))), guid, nonempty(attr(F.col("item"), q(RDF, "about"))))),
        "title": get.tag(q(RSS_1, "title")), "description": get.tag(q(RSS_1, "description")),
        "found": nested.entry_links(F.filter(kids, tagged(q(ATOM, "link"))), own, ustrip(element["text"]), _permalink(element)),
        "published": published, "alt": F.when(published.isNull() & ~is_http_url(guid), guid), "blocked": published.isNotNull(),
        "updated": F.coalesce(nonempty(get.tag(q(DC_TERMS, "modified"))), nonempty(get.tag(q(ATOM, "modified")))),
        "author": first_nonempty(get.tag(q(DC, "creator")), get.plain("author")), "tags": nested.rdf_tags(kids) if flags.tags else nested.no(TAG),
    }


def xml_entries(shredded: DataFrame, keys: list[str], flags: Flags) -> DataFrame:
    """keys, pos and the fields of every entry of shredded documents.

    Narrow, and one pass for all vocabularies: items are exploded in place, a CASE reads each by its own rules, and what the
    vocabularies share is computed once.
    """
    rows = shredded.select(*keys, "feed_type", "atom_ns", "has_media", F.posexplode("items").alias("pos", "item"))
    rows = rows.withColumns({"kids": F.filter("item.nodes", lambda n: n["depth"] == 1), "grand": F.filter("item.nodes", lambda n: n["depth"] == 2)})
    by_kind = {"rss": rss_sources(flags), "atom": atom_sources(flags), "rdf": rdf_sources(flags)}
    read = {}
    for name in SOURCES:
        case = None
        for kind, sources in by_kind.items():
            if name in sources:
                case = (F if case is None else case).when(F.col("feed_type") == kind, sources[name])
        read["s_" + name] = case
    rows = rows.withColumns(read)
    link = F.when(F.col("s_found").isNotNull(), F.col("s_found.link")).otherwise(F.col("s_own_link"))
    description = F.col("s_description")
    if flags.content:
        rows = rows.withColumn("content", nested.content_of(F.col("s_node"), F.col("s_fallback"), F.col("item")))
        description = nested.description_of(description, F.col("content"))
    # dates and description need Python for some rows: side by side, they pass it in one step
    dates = {"p": (F.col("s_published"), F.col("s_alt")), "u": (F.col("s_updated"), F.col("s_alt_updated"))}
    rows = with_first_dates(rows, dates, description=description)
    fields = {
        "id": F.coalesce("s_id", link), "title": F.coalesce("s_title", F.lit("")), "link": link, "description": ustrip(F.coalesce("description", F.lit(""))),
        "published": F.coalesce("p", F.when(~F.coalesce("s_blocked", F.lit(False)), F.col("u"))), "updated": F.col("u"), "author": F.col("s_author"), "comments": F.col("s_comments"),
        "content": F.col("content") if flags.content else nested.no(TEXT_DETAIL), "links": F.coalesce("s_found.links", F.array().cast(f"array<{nested.LINK}>")),
        "tags": F.col("s_tags"), "media_content": _media(flags), "enclosures": nested.enclosures(F.col("kids")) if flags.enclosures else nested.no(ENCLOSURE),
    }
    return rows.select(*keys, "pos", *[(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in ENTRY.items()])


def with_authors(entries: DataFrame) -> DataFrame:
    """Adds author_detail and authors where there is an author, and the dates as timestamps."""
    detail = F.when(nonempty(F.col("author")).isNotNull(), F.struct(F.col("author").alias("name")))
    return entries.withColumns({
        "author_detail": detail, "authors": F.when(detail.isNotNull(), F.array(detail)),
        "published_ts": to_timestamp(F.col("published")), "updated_ts": to_timestamp(F.col("updated")),
    })
