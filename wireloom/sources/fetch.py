"""Documents from addresses: HTTP bodies, a file cache, and pages that send the reader on."""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from urllib.request import Request, urlopen

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from ..functions.text import is_http_url, url_key
from .prepare import encode_text
from .xmltree import read_html

try:
    import brotli
except ImportError:
    brotli = None

TIMEOUT, AGENT = 30, "wireloom/1.0"
#: How often a page may send the reader on.
HOPS = 5

DOCUMENT = "source string, content binary, error string"

_REFRESH = re.compile(r"""url\s*=\s*["']?\s*([^"'>\s]+)""", re.I)


def accepted_encodings() -> str:
    """What a server may compress with: Brotli only where it can be read."""
    return "gzip, deflate" + ", br" * (brotli is not None)


def decode_body(body: bytes, encoding: str | None = None, charset: str | None = None) -> bytes:
    """A response's document: decompressed and, if the declared charset fits, as UTF-8; else its bytes as they are."""
    if encoding == "gzip":
        body = gzip.decompress(body)
    elif encoding == "deflate":
        body = zlib.decompress(body, -zlib.MAX_WBITS)
    elif encoding == "br":
        if brotli is None:
            raise ValueError("Received brotli-compressed response but 'brotli' is not installed")
        body = brotli.decompress(body)
    if charset:
        try:
            return encode_text(body.decode(charset))
        except (UnicodeDecodeError, LookupError):
            pass
    return body


def fetch(url: str) -> bytes:
    """The document at an address; redirects are followed, HTTP errors are raised."""
    with urlopen(Request(url, headers={"Accept-Encoding": accepted_encodings(), "User-Agent": AGENT}), timeout=TIMEOUT) as r:
        return decode_body(r.read(), r.headers.get("Content-Encoding"), r.headers.get_content_charset())


def _row(url: str, get: Callable[[str], bytes]) -> tuple[str, bytes | None, str | None]:
    try:
        return url, get(url), None
    except Exception as e:  # one bad address must not end the job
        return url, None, f"{type(e).__name__}: {e}"


class FeedUrls(DataSource):
    """spark.read.format("feed_url").option("urls", json list).load(): source, content, error; a partition for each address."""

    @classmethod
    def name(cls) -> str:
        return "feed_url"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("urls", "[]")))


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str]) -> None:
        self._urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self._urls] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield _row(partition.value, fetch)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedUrls)


def settled(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint where spark.checkpoint.dir names a folder, else, on one machine, kept on disk.

    What was fetched must not be fetched again by every action and branch that reads it.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        if where := spark.conf.get("spark.checkpoint.dir", None):
            spark.sparkContext.setCheckpointDir(where)
        else:
            kept = df.persist(StorageLevel.DISK_ONLY)
            kept.count()
            return kept
    return df.checkpoint(True)


def fetch_documents(urls: DataFrame, get: Callable[[str], bytes] = fetch) -> DataFrame:
    """urls (source, ...) -> all columns, content and error. Addresses are fetched where their rows are."""
    names = urls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(u, get) for u in batch.column("source").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=[*names, "content", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{fields}, content binary, error string")


def cached(urls: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """urls (source) -> (documents that the folder holds, addresses that it lacks). A file is named by its address's key."""
    spark = urls.sparkSession
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("key"), "content")
    keyed = urls.withColumn("key", url_key(F.col("source")))
    return keyed.join(files, "key").drop("key"), keyed.join(files.select("key"), "key", "left_anti").drop("key")


def fill_cache(urls: DataFrame, folder: str, get: Callable[[str], bytes] = fetch) -> DataFrame:
    """urls (source) -> all columns, content and error. What the folder lacks is fetched and, if it could be, written there
    under its address's key, each address once; executors write to the folder, so it must be shared. Null addresses go."""
    known, lacking = cached(urls.where("source is not null"), folder)
    new = fetch_documents(lacking.select("source").distinct(), get).withColumn("key", url_key(F.col("source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist()):
                if content is not None:
                    # under a name of its own first: readers of the folder never see half a file
                    with store.open_output_stream(part := f"{base}/_{key}-{uuid.uuid4().hex}", compression=None) as out:
                        out.write(content)
                    store.move(part, f"{base}/{key}")
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    got = settled(new.mapInArrow(run, fields)).select(F.col("source").alias("_address"), "content", "error")
    filled = lacking.join(got, lacking["source"] == got["_address"]).select(*[lacking[c] for c in urls.columns], "content", "error")
    return known.select(*urls.columns, "content").withColumn("error", F.lit(None).cast("string")).unionByName(filled)


def refresh_target(content: bytes | str | None, base: str | None) -> str | None:
    """Where a page's first meta refresh that leads elsewhere sends the reader."""
    if not content:
        return None
    root = read_html(content.encode("utf-8", "replace") if isinstance(content, str) else bytes(content))
    for meta in root.iter() if root is not None else ():
        if meta.tag == "meta" and meta.attrs.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.search(meta.attrs.get("content", ""))):
            url = urljoin(base or "", m[1])
            if url != base:
                return url
    return None


@F.pandas_udf(StringType())
def _refresh(content: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([refresh_target(c, b) for c, b in zip(content, base)], dtype=object)


def meta_refresh(content: Column, base: Column) -> Column:
    """The address that a page sends the reader on to; null if there is none. Only pages that name a refresh are parsed."""
    return _refresh(F.when(F.lower(content.cast("string")).contains("refresh"), content), base)


def follow_refreshes(docs: DataFrame, get: Callable[[str], bytes] = fetch, hops: int = HOPS) -> DataFrame:
    """docs (source, content, ...): documents that are no feeds and whose page sends the reader on are fetched anew, up to
    `hops` times; source becomes the last address. Only address sources are followed."""
    from ..operators.jsonfeed import is_json_feed
    from ..operators.shred import shred

    names = docs.columns
    done, todo = None, docs
    for _ in range(hops):
        judged = todo.withColumn("raw", F.col("content")).withColumn("is_json", is_json_feed(F.col("content").cast("string")))
        judged = shred(judged, with_items=False).withColumnRenamed("raw", "content")
        html = F.col("error.message").contains("HTML") | F.col("error.message").contains("not a valid RSS/Atom feed")
        # judged once: the pages to go to are counted, fetched and told from those that stay
        judged = settled(judged.withColumn("next", F.when(is_http_url(F.col("source")) & html & ~F.col("is_json"), meta_refresh(F.col("content"), F.col("source")))).select(*names, "next"))
        stays = judged.where("next is null").select(*names)
        done = stays if done is None else done.unionByName(stays)
        moved = judged.where("next is not null").select(*[F.col("next").alias("source") if c == "source" else F.col(c) for c in names if c != "content"])
        if moved.limit(1).count() == 0:
            return done
        todo = fetch_documents(moved, get).select(*names)
    return done.unionByName(settled(todo))
