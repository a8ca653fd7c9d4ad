"""Media columns: payloads in tar shards under their digest; rows carry digest, offset and length."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fresh_path, materialize, small, spread, table

#: Samples in a row of the picture, which is also what payloads are padded to.
WIDTH = 64
#: A shard is closed when it has grown beyond so many bytes.
SHARD_BYTES = 256 << 20
#: Places that a writing task remembers, to write a payload once.
KNOWN_PAYLOADS = 1_000_000
#: Up to so many payloads that several rows have (some 120 bytes each) are broadcast to the texts; beyond, texts are shuffled.
BROADCAST_COPIES = 100_000
#: zlib level of the pictures.
LEVEL = 6

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and first chunk: all that a header-only read asks for.
HEADER_BYTES = len(_SIGNATURE) + 25

INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes before padding, and the payload: padded with zeros to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_picture(payload: bytes) -> bytes:
    """The payload as an 8-bit grey PNG, WIDTH samples a row, one sample a byte, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER_BYTES of a picture."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a picture")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_picture(media: bytes) -> bytes:
    """The payload of a picture that encode_picture made; its checksums are verified."""
    width, height, _ = read_header(media)
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean sample and an average hash: a bit for each column whose mean is above that of all samples."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    columns = grid.sum(axis=0, dtype=np.int64)
    bits = "".join("1" if c * WIDTH > columns.sum() else "0" for c in columns.tolist())
    return f"{WIDTH}x{len(grid)};mean={columns.sum() / grid.size:.4f};hash={int(bits, 2):016x}"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))


class ShardWriter:
    """Appends files to tar shards under root; names are unique, so an attempt that is run again leaves nobody's shard half written."""

    def __init__(self, root: str) -> None:
        self._fs, self._base = _store(root)
        self._out, self._at, self.name = None, 0, ""

    def add(self, name: str, body: bytes) -> tuple[str, int, int]:
        if self._out is None:
            self.name, self._at = f"{uuid.uuid4().hex}.tar", 0
            self._fs.create_dir(self._base, recursive=True)
            self._out = self._fs.open_output_stream(f"{self._base}/{self.name}", compression=None)
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.PAX_FORMAT if len(body) >= 8 << 30 else tarfile.USTAR_FORMAT)
        at = self._at + len(head)
        self._out.write(head)
        self._out.write(body)
        self._out.write(bytes(-len(body) % 512))
        self._at = at + len(body) + -len(body) % 512
        place = self.name, at, len(body)
        if self._at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self._out is not None:
            self._out.write(bytes(1024))
            self._out.close()
            self._out = None


class ShardReader:
    """Range reads; keeps the shard that was read last open."""

    def __init__(self, root: str) -> None:
        self._fs, self._base = _store(root)
        self._name, self._file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self._name:
            if self._file is not None:
                self._file.close()
            self._file, self._name = self._fs.open_input_file(f"{self._base}/{shard}"), shard
        return self._file.read_at(length, offset)


def payload_digest(text: Column) -> Column:
    """The SHA-256 of a text's payload, as payload_of makes it."""
    n = F.octet_length(text)
    zeros = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.sha2(F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("00"), zeros))), 256)


def write_media(docs: DataFrame, root: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, digest, shard, offset, length; the payloads go to tar shards under root.

    One row per input row. A payload is stored once: of rows with equal payloads the one of least doc_id is written, and the
    others take its place from the index by a join of digests; no text is shuffled. The least ids of payloads that several
    rows have are broadcast if they are few enough, else joined by a shuffle. (Only rows that repeat both a doc_id and its
    text can be written more than once, by as many tasks; place_of() then takes one place.) The index is a Parquet table: it
    names the shards of the attempts that Spark committed, and only those.

    Null or empty text: a payload of WIDTH zero bytes, n_bytes 0. Null doc_id stays null, repeated rows repeat, an empty
    table gives an empty index and no shard, other columns are not looked at. Very long texts are stored whole.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumn("digest", payload_digest(F.col("text")))
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = materialize(copies.select(F.col("digest").alias("copied"), "least"), "media-copies")
    held = F.broadcast(copies) if small(copies, BROADCAST_COPIES) else copies.hint("shuffle_hash")
    marked = rows.join(held, rows["digest"] == held["copied"], "left")
    writes = F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, places = ShardWriter(root), {}
        try:
            for batch in batches:
                rows = []
                for digest, text, writes in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "writes"))):
                    n, payload = payload_of(text)
                    if writes and digest not in places:
                        if len(places) >= KNOWN_PAYLOADS:
                            places.clear()
                        places[digest] = writer.add(f"{digest}.png", encode_picture(payload))
                    rows.append((n, *(places[digest] if writes else (None, None, None))))
                names = ("n_bytes", "shard", "offset", "length")
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                columns = {c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": columns.pop("n_bytes"), "digest": batch.column("digest")} | columns)
        finally:
            writer.close()

    written = materialize(marked.select("doc_id", "digest", "text", writes.alias("writes")).mapInArrow(run, INDEX), "media-written")
    lacking = written.where("shard is null").select("doc_id", "n_bytes", "digest")
    places = place_of(written.where("shard is not null").join(spread(copies.select(F.col("copied").alias("digest")), "digest"), "digest", "left_semi"))
    return written.where("shard is not null").unionByName(lacking.join(spread(places, "digest"), "digest").select(*written.columns))


def place_of(index: DataFrame) -> DataFrame:
    """The place that stands for each digest: the least of those it has."""
    least = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return least.select("digest", "place.shard", "place.offset", "place.length")


def _by_shard(places: DataFrame) -> DataFrame:
    """Places in the order of their shards, so that a task reads forward in few of them."""
    return places.repartition("shard").sortWithinPartitions("shard", "offset")


def header_columns(places: DataFrame, root: str) -> DataFrame:
    """places (digest, shard, offset, length) -> digest, width, height, bits from reads of HEADER_BYTES each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(root)
        for batch in batches:
            heads = [read_header(reader.read(r["shard"], r["offset"], HEADER_BYTES)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest")} | {c: pa.array([h[i] for h in heads], pa.int64()) for i, c in enumerate(("width", "height", "bits"))})

    return _by_shard(places.select("digest", "shard", "offset", "length")).mapInArrow(run, "digest string, width long, height long, bits long")


def payload_columns(places: DataFrame, root: str) -> DataFrame:
    """places -> digest, and what the stored bytes give when they are read back and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(root)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                media = reader.read(r["shard"], r["offset"], r["length"])
                payload = decode_picture(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest")} | {c: pa.array([x[i] for x in rows], k) for i, (c, k) in enumerate(zip(names, kinds))})

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _by_shard(places.select("digest", "shard", "offset", "length")).mapInArrow(run, schema)


def read_text(media: bytes, n_bytes: int) -> str:
    """The text that a picture holds."""
    return decode_picture(media)[:n_bytes].decode()


def shard_members(raw: bytes) -> dict[str, bytes]:
    """The files of a shard, by any tar reader."""
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a picture, what its header says, and what its stored bytes give."""
    root = fresh_path(spark, "media-shards")
    index = materialize(write_media(table(spark, sf_dir, "documents"), root), "media-index")
    places = materialize(place_of(index), "media-places")
    heads = header_columns(places, root)
    columns = payload_columns(places, root).join(heads, "digest")
    return index.select("doc_id", "n_bytes", "digest").join(columns, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
