"""One nested record a document, as JSON: {"feed": {...}, "entries": [{...}, ...]}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.entries import ENTRY
from ..operators.feeds import FEED

#: Fields that a record has even when they are null, by feed type.
ALWAYS = {"feed": ("language", "id", "links"), "entry": ("title", "description", "links")}
#: Values whose own null fields are left out; all others keep them.
SPARSE = ("media_content", "enclosures")


def _json(value: Column, sparse: bool) -> Column:
    """A value as JSON."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "true" if sparse else "false"})
    # {"v":...} without its braces and key
    return F.substring(text, F.lit(6), F.length(text) - 6)


def _record(members: dict[str, tuple[Column, Column]], always: tuple[str, ...]) -> Column:
    """A JSON object of the fields (value, its JSON) that are not null, and those that always are there."""
    pairs = {n: F.concat(F.lit(f'"{n}":'), F.coalesce(text, F.lit("null"))) for n, (_, text) in members.items()}
    return F.concat(F.lit("{"), F.concat_ws(",", *[pairs[n] if n in always else F.when(value.isNotNull(), pairs[n]) for n, (value, _) in members.items()]), F.lit("}"))


def _members(names, made_up: Column, sparse: tuple[str, ...] = SPARSE) -> dict[str, tuple[Column, Column]]:
    """made_up: whether the first link was made up by the rules; such a link has no title, one that was read has one or null."""
    links = F.col("links")
    first = F.when(made_up, _json(F.get(links, F.lit(0)), True)).otherwise(_json(F.get(links, F.lit(0)), False))
    rest = F.transform(F.slice(links, 2, F.greatest(F.size(links) - 1, F.lit(0))), lambda x: _json(x, False))
    listed = F.concat(F.lit("["), F.array_join(F.when(F.size(links) > 0, F.concat(F.array(first), rest)).otherwise(F.array().cast("array<string>")), ","), F.lit("]"))
    out = {n: (F.col(n), _json(F.col(n), n in sparse)) for n in names}
    return out if "links" in sparse else out | {"links": (links, listed)}


def records(feeds: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, record of each document that was not rejected. A document's entries come together, as they were in it."""
    names = [*ENTRY, "author_detail", "authors"]
    first = F.get("links", F.lit(0))
    # an entry's first link is made up from a guid, which is its id, too
    by_guid = F.coalesce((first["rel"] == "alternate") & (first["type"] == "text/html") & first["title"].isNull() & (F.col("link") == F.col("id")) & (first["href"] == F.col("id")), F.lit(False))
    from_xml = _record(_members(names, by_guid), ALWAYS["entry"])
    from_json = _record(_members(names, by_guid, (*SPARSE, "links", "content")), ALWAYS["entry"])
    gathered = entries.select(*keys, F.struct("pos", from_xml.alias("xml"), from_json.alias("json")).alias("e")).groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("all"))
    joined = feeds.where("error is null").join(gathered, keys, "left")
    as_json = F.col("feed_type") == "json"
    empty = F.coalesce("all", F.array().cast("array<struct<pos:int,xml:string,json:string>>"))
    listed = F.array_join(F.transform(empty, lambda e: F.when(as_json, e["json"]).otherwise(e["xml"])), ",")
    # a feed's alternate with an address stands first as a copy that the rules made
    made_up = F.coalesce((first["rel"] == "alternate") & first["href"].isNotNull(), F.lit(False))
    feed = F.when(as_json, _record(_members(FEED, made_up, (*SPARSE, "links")), ALWAYS["feed"])).otherwise(_record(_members(FEED, made_up), ALWAYS["feed"]))
    return joined.select(*keys, F.concat(F.lit('{"feed":'), feed, F.lit(',"entries":['), listed, F.lit("]}")).alias("record"))
