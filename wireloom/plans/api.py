"""The public entry: documents -> feeds and entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_http_url
from ..operators.entries import Flags, with_authors, xml_entries
from ..operators.feeds import xml_feeds
from ..operators.jsonfeed import is_json_feed, json_entries, json_feeds, parse_json
from ..operators.shred import shred
from ..sources.fetch import HOPS, fetch, fetch_documents, follow_refreshes, settled


@dataclass(frozen=True)
class Feeds:
    """feeds: a row for each document. entries: a row for each entry of each document, numbered by pos."""

    feeds: DataFrame
    entries: DataFrame


def _sniffed(docs: DataFrame, keys: list[str], content: str) -> DataFrame:
    return docs.select(*keys, content).withColumn("json_text", F.when(is_json_feed(F.col(content).cast("string")), F.col(content).cast("string")))


def parse_documents(
    docs: DataFrame, content: str = "content", keys: list[str] | None = None, *, include_content: bool = True, include_tags: bool = True, include_media: bool = True,
    include_enclosures: bool = True, mode: str = "PERMISSIVE",
) -> Feeds:
    """Feeds and entries of RSS, Atom, RDF and JSON documents in a string or binary column.

    keys: columns that identify a document and go with its rows (by default all columns but content). A flag that is off
    leaves its columns null and its work undone. A rejected document has a row in feeds whose error says why and no entries;
    with mode DROPMALFORMED it has none, with FAILFAST reading its row fails.

    All steps are narrow: nothing is shuffled, and a plan that reads only feeds doesn't build the items' nodes. Works on
    streams, too. Each of the two frames parses the documents when it is run; write shredded documents to a table (see
    operators.shred) to parse once for many plans.
    """
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode}")
    keys = [c for c in docs.columns if c != content] if keys is None else list(keys)
    flags = Flags(include_content, include_tags, include_media, include_enclosures)
    rows = _sniffed(docs, keys, content)
    as_json = rows.where("json_text is not null").select(*keys, parse_json(F.col("json_text")).alias("json"))
    as_xml = rows.where("json_text is null").select(*keys, content)
    feeds = xml_feeds(shred(as_xml, content, with_items=False, media=False), keys, include_tags).unionByName(json_feeds(as_json, keys))
    if mode == "DROPMALFORMED":
        feeds = feeds.where("error is null")
    elif mode == "FAILFAST":
        feeds = feeds.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error.message")).cast("struct<class:string,message:string>")))
    entries = xml_entries(shred(as_xml, content, media=include_media), keys, flags).unionByName(json_entries(as_json, keys, flags))
    return Feeds(feeds, with_authors(entries))


def parse_sources(sources: DataFrame, source: str = "source", hops: int = HOPS, get=fetch, **options) -> Feeds:
    """Feeds and entries of a string column that holds addresses or documents.

    Addresses (http:// or https://, as written) are fetched where their rows are, and pages that send the reader on are
    followed; each address is fetched once, before this returns. An address that can't be read has a row in feeds whose error says why. Other columns are the keys; the address
    that a document came from at last is in the column named like the source, null for documents.
    """
    rows = sources.withColumn("_address", is_http_url(F.col(source)))
    names = [c for c in sources.columns if c != source]
    given = rows.where(~F.col("_address")).select(*names, F.lit(None).cast("string").alias("source"), F.encode(F.coalesce(source, F.lit("")), "UTF-8").alias("content"))
    fetched = settled(fetch_documents(rows.where("_address").select(*names, F.col(source).alias("source")), get))
    read = follow_refreshes(fetched.where("error is null").drop("error"), get, hops)
    parsed = parse_documents(given.unionByName(read), "content", [*names, "source"], **options)
    gone = fetched.where("error is not null").select(*names, "source", F.struct(F.lit("URLError").alias("class"), F.col("error").alias("message")).alias("error"))
    feeds = parsed.feeds.unionByName(gone, allowMissingColumns=True) if options.get("mode", "PERMISSIVE") == "PERMISSIVE" else parsed.feeds
    rename = lambda df: df.withColumnRenamed("source", source)
    return Feeds(rename(feeds), rename(parsed.entries))
