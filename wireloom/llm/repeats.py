"""Removal of passages that occur again: every byte of a string of LENGTH bytes that starts in two places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize, scratch, spread, table
from .deep_shallow import intervals, lcp, sort_strings
from .shingles import mix

#: Bytes of a repeated string, and of the gram by which its occurrences find one another.
LENGTH, GRAM = 400, 64
#: Bytes before an anchor that a string which has it as anchor can take in.
LEFT = LENGTH - GRAM
#: Buckets with more contexts are split by what the contexts share, into so many ranges of the string's start.
BUCKET, RANGES = 4096, 8
#: Up to so many places or ranges (some 40 bytes each) are broadcast to the texts; beyond, the texts are joined by a shuffle.
BROADCAST_ITEMS = 300_000

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each gram of a byte array: differences of sums modulo 2^64, then spread."""
    n = len(raw)
    up, down = _powers(1 << max(12, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:n], out=sums[1:])
    return mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each w consecutive values, in a few passes whatever w is."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % w, x[-1], x.dtype))).reshape(-1, w)
    ahead = pick.accumulate(padded, axis=1).ravel()
    back = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text of LENGTH bytes or more.

    An anchor is a gram with the least hash of all grams in some string of LENGTH bytes. Which grams of a string these are
    depends on the string alone, so equal strings have their anchors at the same distance from their starts.
    """
    h = gram_hashes(raw)
    w = LENGTH - GRAM + 1
    least = _sliding(h, w, np.minimum)
    # h[i] is the least of some string iff the largest of the least hashes of the strings around it is h[i]
    edge = np.zeros(w - 1, np.uint64)
    around = _sliding(np.concatenate((edge, least, edge)), w, np.maximum)
    at = np.flatnonzero(around == h)
    return at, h[at]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """d (16 bytes of the text's digest), pos, g (gram), c (context), l, r: bytes of the context before and from the anchor.

    A context that a text holds several times is one row, at its first place; own has the ranges that its places cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                if len(raw) < LENGTH or (d := hashlib.sha256(raw).digest()[:16]) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(d)
                at, h = anchors(np.frombuffer(raw, np.uint8))
                places: dict[tuple, list[int]] = {}
                for i, g in zip(at.tolist(), h.view(np.int64).tolist()):
                    left, right = min(i, LEFT), min(len(raw) - i, LENGTH)
                    c = xxhash.xxh3_64_intdigest(raw[i - left : i + right], left)
                    places.setdefault((g, c - (1 << 63), left, right), []).append(i)
                for (g, c, left, right), found in places.items():
                    own = merge_spans([(i - left, i + right) for i in found]) if len(found) > 1 and left + right >= LENGTH else None
                    out.append((d, found[0], g, c, left, right, len(found) > 1, own and [{"start": a, "end": b} for a, b in own]))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), span)
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(("d", "pos", "g", "c", "l", "r", "twice", "own"), kinds))})

    return docs.select("text").mapInArrow(run, "d binary, pos int, g long, c long, l int, r int, twice boolean, own array<struct<start:int,end:int>>")


def _with_texts(docs: DataFrame, by_digest: DataFrame, items: str) -> DataFrame:
    """The texts of the documents in by_digest (one row for each d) with its columns; items is its array column."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("d", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    if (by_digest.agg(F.sum(F.size(items))).collect()[0][0] or 0) <= BROADCAST_ITEMS:
        return texts.join(F.broadcast(by_digest), "d")
    return texts.join(by_digest.hint("shuffle_hash"), "d")


def _covered_pair(one: tuple[bytes, int, int], two: tuple[bytes, int, int]) -> list[tuple[int, int]]:
    """covered() for two contexts, which are in order as they stand: what they have in common on either side."""
    (x, left_x, right_x), (y, left_y, right_y) = one, two
    left, right = min(left_x, left_y), min(right_x, right_y)
    after = lcp(int.from_bytes(x[left_x : left_x + right], "big"), int.from_bytes(y[left_y : left_y + right], "big"), right)
    if left + after < LENGTH:
        return [(0, 0), (0, 0)]
    # common ends are common beginnings of the strings read from the end
    before = lcp(int.from_bytes(x[left_x - left : left_x], "little"), int.from_bytes(y[left_y - left : left_y], "little"), left)
    both = (before, after) if before + after >= LENGTH else (0, 0)
    return [both, both]


def covered(contexts: list[tuple[bytes, int, int]]) -> list[tuple[int, int]]:
    """contexts (bytes, l, r) around one gram -> bytes before and from the anchor that repeated strings cover; (0, 0): none.

    For each context the strings that it shares with another one reach from the anchor as far left as any context allows that
    agrees with it in LENGTH bytes or more around the anchor, and likewise right. Contexts are sorted to both sides. All that
    agree with a context in r bytes to the right are a run in the one order; of those, the ones that agree farthest to the
    left are its neighbours in the other order.
    """
    if len(contexts) == 2:
        return _covered_pair(*contexts)
    sides = []
    for strings, width in (([x[left : left + right] for x, left, right in contexts], LENGTH), ([x[:left][::-1] for x, left, _ in contexts], LEFT)):
        # past the end of a text stands a zero; lengths then bound what is common
        padded, lengths = [s.ljust(width, b"\0") for s in strings], list(map(len, strings))
        order, prefixes = sort_strings(padded, width)
        prefixes = [0] + [min(p, lengths[a], lengths[b]) for p, a, b in zip(prefixes[1:], order, order[1:])]
        sides.append((width, lengths, [int.from_bytes(s, "big") for s in padded], order, prefixes, {item: k for k, item in enumerate(order)}))
    out = []
    for near, far in (sides, sides[::-1]):
        width, lengths, numbers, _, _, rank = far
        best = [0] * len(contexts)
        for depth, first, last in intervals(near[4], LENGTH - width):
            run = sorted(near[3][first : last + 1], key=rank.__getitem__)
            for a, b in zip(run, run[1:]):
                common = min(lcp(numbers[a], numbers[b], width), lengths[a], lengths[b])
                if common + depth >= LENGTH:
                    best[a], best[b] = max(best[a], common), max(best[b], common)
        out.append(best)
    return [(a, b) if a + b >= LENGTH else (0, 0) for a, b in zip(*out)]


def _resolve(rows: DataFrame) -> DataFrame:
    """rows (g, part, share, d, pos, single, context, l, r) -> d, start, end covered in the single ones; a bucket is g, part, share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def flush() -> pa.RecordBatch:
            found = []
            if len(rows) > 1 and any(r[2] for r in rows):
                for (d, pos, single, *_), (a, b) in zip(rows, covered([r[3:] for r in rows])):
                    if single and a + b:
                        found.append((d, pos - a, pos + b))
            return pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in found], t) for k, (n, t) in enumerate((("d", pa.binary()), ("start", pa.int32()), ("end", pa.int32())))})

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("g", "part", "share", "d", "pos", "single", "context", "l", "r"))):
                if row[:3] != at:
                    if len(rows) > 1:
                        yield flush()
                    at, rows = row[:3], []
                rows.append(row[3:])
        yield flush()

    return rows.select("g", "part", "share", "d", "pos", "single", "context", "l", "r").mapInArrow(run, "d binary, start int, end int")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (g, c, d, pos, l, r, single, large) -> also context, and part and share: -1 and 0, or for a large bucket one row
    for each range of starts, with a hash of what strings that start there have in common."""
    by_doc = materialize(wanted.groupBy("d").agg(F.collect_list(F.struct("pos", "g", "c", "l", "r", "single", "large")).alias("at")), "repeats-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = -(-(LEFT + 1) // RANGES)
        for batch in batches:
            out = []
            for d, text, at in zip(*(batch.column(n).to_pylist() for n in ("d", "text", "at"))):
                raw = text.encode()
                for x in at:
                    pos, left, right = x["pos"], x["l"], x["r"]
                    row = (x["g"], x["c"], d, pos, x["single"], raw[pos - left : pos + right], left, right)
                    if not x["large"]:
                        out.append((*row, -1, 0))
                        continue
                    for j in range(RANGES):
                        a, b = j * step, min(LEFT, (j + 1) * step - 1)  # bytes before the anchor of a string that starts here
                        if a <= left and LENGTH - b <= right and a <= LEFT:
                            share = xxhash.xxh3_64_intdigest(raw[pos - a : pos + LENGTH - b])
                            out.append((*row, j, share - (1 << 63)))
            names = ("g", "c", "d", "pos", "single", "context", "l", "r", "part", "share")
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(names, kinds))})

    rows = _with_texts(docs, by_doc, "at").select("d", "text", "at")
    schema = "g long, c long, d binary, pos int, single boolean, context binary, l int, r int, part int, share long"
    # copies of a document give a context again
    return rows.mapInArrow(run, schema).repartition("g", "part", "share").dropDuplicates(["g", "part", "share", "c"]).sortWithinPartitions("g", "part", "share")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs (text) -> d, spans: for each text of which some, but not necessarily all, is covered, the covered ranges of bytes.

    1. Anchors of every text; anchors whose gram occurs once, in all texts, are dropped.
    2. Occurrences of one gram whose whole contexts (what strings with that anchor can take in) are equal are covered as far
       as the context reaches. This is a count; contexts do not move.
    3. Of each other context and one of each equal ones the bytes are fetched and sorted within the gram's bucket; common
       prefixes and suffixes say what is covered. Large buckets are split first.
    """
    rows = materialize(_anchor_rows(docs), "repeats-anchors")
    found = rows.withColumn("occ", F.xxhash64("d", "pos"))
    grams = found.groupBy("g").agg(F.min("occ").alias("lo"), F.max("occ").alias("hi"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.max("twice").alias("twice")).where("lo <> hi or twice")
    # copies of a text in several tasks give their rows again: counts below are of distinct occ
    kept = materialize(found.join(spread(grams.select("g", (F.col("c_lo") != F.col("c_hi")).alias("mixed")), "g"), "g"), "repeats-kept")
    discard(rows)
    contexts = kept.groupBy("g", "c").agg(F.min("occ").alias("lo"), F.max("occ").alias("hi"), F.max("twice").alias("twice"), F.max("mixed").alias("mixed"))
    repeated = F.col("twice") | (F.col("lo") != F.col("hi"))
    whole = kept.drop("twice").join(spread(contexts.where(repeated).select("g", "c"), "g", "c"), ["g", "c"]).where(F.col("l") + F.col("r") >= LENGTH)
    range_of = F.array(F.struct((F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end")))
    whole = whole.select("d", F.explode(F.coalesce("own", range_of)).alias("s")).select("d", "s.start", "s.end")
    sizes = contexts.where("mixed").groupBy("g").agg(F.count("*").alias("n"), F.max(~repeated).alias("any")).where("any")
    one = contexts.where("mixed").select("g", "c", F.col("lo").alias("occ"), (~repeated).alias("single"))
    wanted = kept.drop("mixed", "twice", "own").join(spread(one, "g", "c", "occ"), ["g", "c", "occ"]).join(spread(sizes.select("g", (F.col("n") > BUCKET).alias("large")), "g"), "g")
    parts = materialize(_resolve(_contexts(docs, wanted)), "repeats-parts")
    return whole.union(parts).distinct().groupBy("d").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (bytes); one row per input row.

    Removed is each byte of a string of LENGTH bytes that starts at some other place too, in the same or another document, as
    the input stands; matches do not cross documents. n_spans counts the maximal removed runs.

    Copies: a text that stands in several rows (also rows of one doc_id) is removed whole if it has LENGTH bytes, and counts
    as one text against all others. Null or empty text: nothing to remove. Null doc_id stays null. Empty table: empty result.
    Very long texts are searched whole. Cuts are made between bytes, so kept may not be valid UTF-8. Other columns are not
    looked at.
    """
    arrow_rows(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"), *([text.cast("binary").alias("text")] * keep_text))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n")).where((F.col("copies") > 1) & (F.col("n") >= LENGTH)).select("digest", F.lit(True).alias("copied"))
    with scratch(docs.sparkSession):
        spans = materialize(repeated_spans(docs), "repeats-spans", keep=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            out = []
            for d, text, at in zip(*(batch.column(n).to_pylist() for n in ("d", "text", "spans"))):
                if d in done:
                    continue
                done.add(d)
                raw, runs = text.encode(), merge_spans([(x["start"], x["end"]) for x in at])
                kept = b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)]))
                out.append((hashlib.sha256(raw).hexdigest(), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(("digest", "n_removed", "n_spans", "kept_sha256", "kept"), kinds))})

    cuts = _with_texts(docs, spans, "spans").select("d", "text", "spans").mapInArrow(cut, "digest string, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cuts = materialize(cuts if keep_text else cuts.drop("kept"), "repeats-cuts").dropDuplicates(["digest"])
    joined = rows.join(cuts, "digest", "left").join(copies, "digest", "left")
    pick = lambda all_gone, name, none: F.when(F.col("copied"), all_gone).otherwise(F.coalesce(F.col(name), none))
    zero = F.lit(0).cast("long")
    out = [
        F.col("doc_id"), F.col("n_bytes"), pick(F.col("n_bytes"), "n_removed", zero).alias("n_removed"), pick(F.lit(1).cast("long"), "n_spans", zero).alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), "kept_sha256", F.col("digest")).alias("kept_sha256"),
    ]
    return joined.select(*out, *([pick(F.lit(b""), "kept", F.col("text")).alias("kept")] * keep_text))


def op8_repeats(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
