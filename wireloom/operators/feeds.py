"""Feeds' own fields from their channel's nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, let, nonempty
from ..names import ATOM, ATOM_03, DC, LINK, MVCB, RSS_1, TAG, q
from . import nested
from .nodes import Getter, attr, first, tagged

DETAIL = "struct<type:string,language:string,base:string,value:string>"
GENERATOR = "struct<name:string,version:string,href:string>"

#: Fields of a feed in their order, and their types.
FEED = {
    "title": "string", "link": "string", "subtitle": "string", "generator": "string", "publisher": "string", "author": "string", "updated": "string", "language": "string",
    "id": "string", "comments": "string", "icon": "string", "favicon": "string", "title_detail": DETAIL, "subtitle_detail": DETAIL, "generator_detail": GENERATOR,
    "links": f"array<{LINK}>", "tags": f"array<{TAG}>",
}

#: Relations whose links are no links of a feed to readers.
PLUMBING = ("hub", "self", "replies", "edit")


def _links(atom_links: Column, own: Column) -> Column:
    """link and links. The first alternate gives the link and stays in its place, too; a link without relation gives it if it
    comes first. The link is set before all others."""
    giving = lambda x: x["href"].isNotNull() & (x["rel"].isNull() | (x["rel"] == "alternate"))

    def chosen(x: Column) -> Column:
        # without a relation: with a link of its own it is dropped, without one it stays
        shown = F.filter(x["links"], lambda n: F.when(n["rel"].isNull(), n["href"].isNull()).otherwise(~n["rel"].isin(*PLUMBING)))
        given = F.slice(F.filter(x["links"], giving), 1, 1)
        set_first = F.transform(given, lambda n: nested.struct(LINK, rel=F.lit("alternate"), type=F.lit("text/html"), href=n["href"]))
        return F.struct(F.coalesce(F.get(given, F.lit(0))["href"], x["own"]).alias("link"), F.concat(set_first, shown).alias("links"))

    return let(F.struct(F.transform(atom_links, nested.link_struct).alias("links"), own.alias("own")), chosen)


def xml_feeds(shredded: DataFrame, keys: list[str], tags: bool = True) -> DataFrame:
    """keys, feed_type, atom_ns, error and the fields of every shredded document; those of a rejected one are null."""
    nodes = F.col("channel.nodes")
    rows = shredded.select(*keys, "feed_type", "atom_ns", "error", "channel")
    rows = rows.withColumns({"kids": F.filter(nodes, lambda n: n["depth"] == 1), "grand": F.filter(nodes, lambda n: n["depth"] == 2)})
    kids, grand, kind = F.col("kids"), F.col("grand"), F.col("feed_type")
    get = Getter(kids, grand)
    space = F.coalesce("atom_ns", F.lit(ATOM))
    atom = lambda name: F.concat(F.lit("{"), space, F.lit("}" + name))
    old = space == ATOM_03

    def resolve(rss: str, atom_value: Column, rdf: Column, last: Column) -> Column:
        lower = [nonempty(get.plain(rss.lower()))] if rss != rss.lower() else []
        by_rss = F.coalesce(nonempty(get.plain(rss)), *lower, nonempty(atom_value), *([nonempty(rdf)] if rdf is not None else []), nonempty(last))
        return F.when(kind == "rss", by_rss).when(kind == "atom", nonempty(atom_value)).when(kind == "rdf", nonempty(rdf))

    channel = q(RSS_1, "channel")
    in_channel = lambda tag: get.path(channel, tag)
    updated = F.when(old, get.tag(atom("modified"))).otherwise(get.tag(atom("updated")))
    values = {
        "title": resolve("title", get.tag(atom("title")), in_channel(q(RSS_1, "title")), get.plain("title")),
        "subtitle": resolve("description", get.tag(atom("subtitle")), in_channel(q(RSS_1, "description")), get.plain("subtitle")),
        "generator": resolve("generator", get.tag(atom("generator")), in_channel(q(MVCB, "generatorAgent")), get.plain("generator")),
        "publisher": F.coalesce(resolve("publisher", get.tag(atom("publisher")), in_channel(q(DC, "publisher")), get.plain("publisher")), nonempty(get.plain("webMaster"))),
        "author": F.coalesce(resolve("author", get.path(atom("author"), atom("name")), in_channel(q(DC, "creator")), get.path("author", atom("name"))), nonempty(get.plain("managingEditor"))),
        "updated": resolve("lastBuildDate", updated, in_channel(q(DC, "date")), F.when(old, get.plain("modified")).otherwise(get.plain("updated"))),
        "language": attr(F.col("channel"), nested.LANG), "base": attr(F.col("channel"), nested.BASE), "id": get.tag(atom("id")),
        "comments": F.when(kind == "rss", nonempty(get.plain("comments"))),
    }
    by_attribute = first_nonempty(get.attr(atom("link"), "href"), get.attr(atom("link"), "link"))
    in_rss = F.coalesce(nonempty(get.plain("link")), by_attribute)
    own_link = F.when(kind == "rss", in_rss).when(kind == "atom", by_attribute).when(kind == "rdf", nonempty(in_channel(q(RSS_1, "link"))))
    generator = first(kids, tagged(atom("generator")))
    values["generator_detail"] = F.when(generator.isNotNull(), nested.struct(GENERATOR, name=generator["text"], version=attr(generator, "version"), href=attr(generator, "uri")))
    by_kind = F.when(kind == "rss", nested.rss_tags(kids, False)).when(kind == "atom", nested.atom_tags(kids, atom("category"))).when(kind == "rdf", nested.rdf_tags(kids))
    values["tags"] = by_kind if tags else nested.no(TAG)
    rows = rows.withColumns(values).withColumn("by_links", _links(F.filter(kids, tagged(atom("link"))), own_link))
    detail = lambda n: F.when(F.col(n).isNotNull(), nested.struct(DETAIL, type=F.lit("text/plain"), language=F.col("language"), base=F.col("base"), value=F.col(n)))
    rows = rows.withColumns({"link": F.col("by_links.link"), "links": F.col("by_links.links"), "title_detail": detail("title"), "subtitle_detail": detail("subtitle")})
    return rows.select(*keys, "feed_type", "atom_ns", *[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in FEED.items()], "error")
