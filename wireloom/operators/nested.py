"""Links, contents, tags, media and enclosures: arrays of structs from node arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, html_to_text, is_http_url, lenient_int, let, nonempty, ustrip
from ..names import DC, ENCLOSURE, LINK, MEDIA, MEDIA_ITEM, RDF, TAG, TAXONOMY, TEXT_DETAIL, XML, q
from .nodes import attr, first, tagged

LANG, BASE = q(XML, "lang"), q(XML, "base")


def struct(kind: str, **fields: Column) -> Column:
    """A struct of a declared type; fields that are not given are null."""
    names = [f.split(":")[0] for f in kind.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*[(fields[n] if n in fields else F.lit(None)).alias(n) for n in names]).cast(kind)


def no(kind: str) -> Column:
    return F.lit(None).cast(f"array<{kind}>")


def unless_empty(array: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(array) > 0, array)


def href(link: Column) -> Column:
    return first_nonempty(attr(link, "href"), attr(link, "link"))


def link_struct(link: Column) -> Column:
    return struct(LINK, rel=attr(link, "rel"), type=attr(link, "type"), href=href(link), title=attr(link, "title"))


def entry_links(atom_links: Column, own: Column, guid: Column | None = None, permalink: Column | None = None) -> Column:
    """link and links of an entry from its Atom links, the link it has already (null: none) and its guid.

    The first alternate is held back and set first; later ones, and all but edit and self links, follow. A guid that is a URL
    is the link of an entry without one, and then stands in place of the alternate; else the alternate is the link.
    """
    guid = F.lit(None).cast("string") if guid is None else guid
    permalink = F.lit(False) if permalink is None else permalink
    with_href = F.filter(F.transform(atom_links, link_struct), lambda x: x["href"].isNotNull())

    def chosen(x: Column) -> Column:
        found, own, guid = x["links"], x["own"], x["guid"]
        held = F.array_position(F.transform(found, lambda n: F.coalesce(n["rel"], F.lit(""))), "alternate") - 1
        rest = F.filter(found, lambda n, i: (i != held) & ~F.coalesce(n["rel"].isin("edit", "self"), F.lit(False)))
        alternate = F.slice(F.filter(found, lambda n: n["rel"] == "alternate"), 1, 1)
        by_guid = is_http_url(guid) & own.isNull()
        from_guid = F.transform(alternate, lambda _: struct(LINK, rel=F.lit("alternate"), type=F.lit("text/html"), href=guid))
        link = F.when(by_guid, guid).otherwise(F.coalesce(F.get(alternate, F.lit(0))["href"], own, F.when(x["permalink"], guid)))
        return F.struct(link.alias("link"), F.concat(F.when(by_guid, from_guid).otherwise(alternate), rest).alias("links"))

    return let(F.struct(with_href.alias("links"), own.alias("own"), guid.alias("guid"), permalink.alias("permalink")), chosen)


def content_of(node: Column, fallback: Column | None, item: Column) -> Column:
    """The content array from a content element, or else from a description's text as it stands."""
    kind = F.coalesce(attr(node, "type"), F.lit("text/html"))
    own = struct(TEXT_DETAIL, type=kind, language=attr(node, LANG), base=attr(node, BASE), value=F.coalesce(node["whole"], node["text"], F.lit("")))
    out = F.when(node.isNotNull(), F.array(own))
    if fallback is not None:
        out = out.when(fallback.isNotNull(), F.array(struct(TEXT_DETAIL, type=F.lit("text/html"), language=attr(item, LANG), base=attr(item, BASE), value=fallback)))
    return out


def description_of(description: Column, content: Column) -> Column:
    """The description, or one made from the content."""
    return F.coalesce(description, html_to_text(F.when(description.isNull(), F.get(content, F.lit(0))["value"])))


def _terms(nodes: Column, scheme=None) -> Column:
    named = F.filter(nodes, lambda n: F.coalesce(ustrip(n["text"]) != "", F.lit(False)))
    return F.transform(named, lambda n: struct(TAG, term=ustrip(n["text"]), scheme=scheme(n) if scheme else F.lit(None)))


def rss_tags(kids: Column, any_space: bool) -> Column:
    """Categories (in any namespace for entries), then subjects."""
    categories = F.filter(kids, lambda n: n["local"] == "category") if any_space else F.filter(kids, tagged("category"))
    subjects = F.filter(kids, lambda n: n["tag"] == q(DC, "subject"))
    return unless_empty(F.concat(_terms(categories, lambda n: attr(n, "domain")), _terms(subjects)))


def atom_tags(kids: Column, category: Column) -> Column:
    named = F.filter(kids, lambda n: (n["tag"] == category) & nonempty(attr(n, "term")).isNotNull())
    return unless_empty(F.transform(named, lambda n: struct(TAG, term=attr(n, "term"), scheme=attr(n, "scheme"), label=attr(n, "label"))))


def rdf_tags(kids: Column) -> Column:
    """Subjects, then topics, whose term is their text or else their resource."""
    resource = lambda n: attr(n, q(RDF, "resource"))
    topics = F.filter(kids, tagged(q(TAXONOMY, "topic")))
    term = lambda n: nonempty(F.when(n["text"].isNotNull(), ustrip(n["text"])).otherwise(resource(n)))
    topics = F.transform(F.filter(topics, lambda n: term(n).isNotNull()), lambda n: struct(TAG, term=term(n), scheme=resource(n)))
    return unless_empty(F.concat(_terms(F.filter(kids, tagged(q(DC, "subject")))), topics))


def enclosures(kids: Column) -> Column:
    """Un-namespaced enclosures with a URL; a length that is no integer is null."""
    found = F.filter(kids, lambda n: (n["tag"] == "enclosure") & nonempty(attr(n, "url")).isNotNull())
    return unless_empty(F.transform(found, lambda n: struct(ENCLOSURE, url=attr(n, "url"), type=attr(n, "type"), length=lenient_int(attr(n, "length")))))


def media_items(nodes: Column) -> Column:
    """Media contents at any depth or, without any, thumbnails that are not in one. Items without any value go.

    A description or credit of a content's parent serves if it has none itself.
    """
    media = lambda name: q(MEDIA, name)

    def item(n: Column) -> Column:
        own = lambda name: first(nodes, lambda k: (k["parent"] == n["i"]) & (k["tag"] == media(name)))
        beside = lambda name: first(nodes, lambda k: (k["parent"] == n["parent"]) & (k["tag"] == media(name)))
        near = lambda name: F.coalesce(own(name), F.when(n["parent"] != -2, beside(name)))
        credit = near("credit")
        return struct(
            MEDIA_ITEM, url=attr(n, "url"), type=attr(n, "type"), medium=attr(n, "medium"), width=lenient_int(attr(n, "width")), height=lenient_int(attr(n, "height")),
            title=ustrip(own("title")["text"]), text=ustrip(own("text")["text"]), description=ustrip(near("description")["text"]),
            credit=ustrip(credit["text"]), credit_scheme=F.when(credit["text"].isNotNull(), attr(credit, "scheme")), thumbnail_url=attr(own("thumbnail"), "url"),
        )

    def thumb(n: Column) -> Column:
        return struct(MEDIA_ITEM, url=attr(n, "url"), type=F.lit("image/jpeg"), width=lenient_int(attr(n, "width")), height=lenient_int(attr(n, "height")))

    names = [f.split(":")[0] for f in MEDIA_ITEM.removeprefix("struct<").removesuffix(">").split(",")]
    contents = F.filter(F.transform(F.filter(nodes, tagged(media("content"))), item), lambda m: F.coalesce(*[m[n].cast("string") for n in names]).isNotNull())
    thumbs = F.transform(F.filter(nodes, lambda n: (n["tag"] == media("thumbnail")) & (F.coalesce(n["up"], F.lit("")) != media("content"))), thumb)
    return unless_empty(F.when(F.size(contents) > 0, contents).otherwise(thumbs))
