"""Exact Jaccard links between shingle sets by a parity-sketch join, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize, small, spread, table
from .components import components
from .shingles import Bands, fold, parity_sketch, set_digest, shingle_hashes

#: Up to so many document ids (16 bytes each) are broadcast to fetch their texts; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Buckets of more sets than this are compared in square tiles of that side.
TILE = 1024
#: Block keys are joined in slices of the key space, one after the other: as many as give each so many keys, and up to SLICES.
SLICE_KEYS, SLICES = 4_000_000, 4


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, d1, d2 (a digest of the set); one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, k) for t in batch.column("text").to_pylist()]
            digests = [set_digest(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array([d[0] for d in digests], pa.int64()), "d2": pa.array([d[1] for d in digests], pa.int64()),
            })

    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _block_keys(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """key, doc_id for each block of each set; a task gives equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            keys, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                hashes = shingle_hashes(text, k)
                if not len(hashes) or (digest := set_digest(hashes)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(digest)
                keys.append(got := bands.keys(hashes))
                ids.append(np.full(len(got), doc_id, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "doc_id"])

    return docs.where("doc_id is not null").mapInArrow(run, "key long, doc_id long")


def _side(ids: DataFrame) -> DataFrame:
    """ids as the side of a join with documents, whose texts stay where they are as long as ids can be broadcast."""
    return F.broadcast(ids) if small(ids, BROADCAST_IDS) else ids.hint("shuffle_hash")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents in ids (doc_id, distinct)."""
    return docs.join(_side(ids), "doc_id", "left_semi")


def _verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b) -> those that are linked, from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            out = []
            for a, b, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))):
                if left != last:
                    last, mine = left, shingle_hashes(left, k)
                theirs = shingle_hashes(right, k)
                if linked(len(np.intersect1d(mine, theirs, assume_unique=True)), len(mine), len(theirs), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ids")
    texts = materialize(_texts(docs, ids).dropDuplicates(["doc_id", "text"]), "jaccard-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    links = materialize(both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(ids, texts)
    return links


def _hits(keyed: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """keyed (key, doc_id), written -> tables of key, doc_id of the classes that hold a key of several documents.

    Most keys are of one document. What goes through shuffles is a slice of the keys at a time, so that their files take a
    part of the keys' own size at once.
    """
    n = max(1, min(SLICES, -(-keyed.count() // SLICE_KEYS)))
    out = []
    for i in range(n):
        mine = keyed.where(F.pmod("key", F.lit(n)) == i)
        shared = mine.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("key")
        shared = materialize(shared, "jaccard-shared")
        found = mine.join(spread(shared, "key"), "key").join(classes.select("doc_id", "class_id"), "doc_id").select("key", F.col("class_id").alias("doc_id")).distinct()
        out.append(materialize(found, "jaccard-hits"))
        discard(shared)
    return out


def _sketches(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, n, sketch of the documents in ids; a sketch has four to eight bits a shingle, 64 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, k) for t in batch.column("text").to_pylist()]
            raw = [parity_sketch(s, max(64, 1 << (4 * len(s)).bit_length())).tobytes() for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array(raw, pa.binary())})

    return _texts(docs, ids).mapInArrow(run, "doc_id long, n long, sketch binary").dropDuplicates(["doc_id"])


def _near_pairs(rows: list[tuple], i: int, j: int, percent: int, forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs of a tile whose labels differ and whose sketches allow a link; rows: doc_id, component, part, n, sketch.

    forest: of these only as many, the nearest first, as join the labels of the tile to one another.
    """
    rows = list({r[0]: r for r in rows}.values())
    raw = [np.frombuffer(r[4], np.uint64) for r in rows]
    width = min(map(len, raw))
    sketch = np.stack([fold(x, width) for x in raw])
    sizes, labels, parts = (np.array([r[c] for r in rows]) for c in (3, 1, 2))
    found = []
    for x in range(len(rows) - 1):
        ok = labels[x + 1 :] != labels[x]
        if i != j:
            ok &= parts[x + 1 :] != parts[x]
        others = np.flatnonzero(ok) + x + 1
        if len(others):
            apart = np.bitwise_count(sketch[others] ^ sketch[x]).sum(axis=1)
            near = apart * (100 + percent) <= (sizes[others] + sizes[x]) * (100 - percent)
            found += zip(apart[near].tolist(), [x] * int(near.sum()), others[near].tolist())
    if forest:
        root = {c: c for c in labels.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found.sort()
    for _, x, y in found:
        if forest:
            p, q = find(rows[x][1]), find(rows[y][1])
            if p == q:
                continue
            root[p] = q
        yield min(rows[x][0], rows[y][0]), max(rows[x][0], rows[y][0])


def _tile_pairs(members: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """members (key, doc_id, component) of open buckets -> candidate pairs a, b."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    rows = members.join(spread(sizes, "key"), "key").withColumn("part", F.pmod(F.hash("doc_id"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "doc_id", "component", "part")
    tiles = rows.join(sketches, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def flush() -> pa.RecordBatch:
            pairs = list(_near_pairs(rows, at[1], at[2], percent, forest)) if at and len(rows) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "doc_id", "component", "part", "n", "sketch"))):
                if row[:3] != at:
                    if len(rows) > 1:
                        yield flush()
                    at, rows = row[:3], []
                rows.append(row[3:])
        yield flush()

    return tiles.select("key", "i", "j", "doc_id", "component", "part", "n", "sketch").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; one row per input row.

    Words are runs of non-space characters with A-Z lower-cased, a document's set its distinct k-word shingles (the whole
    sequence if it has fewer words). Documents are linked when 100 * intersection >= percent * union; component_id is the
    smallest doc_id that links reach. All links between different sets decide, none is lost:

    1. Equal sets are one class, named by its smallest doc_id.
    2. Sets are cut into blocks of the hash space by the plan of their size band, one block more than linked sets can differ
       in; a key is an equal block. Every linked pair shares a key.
    3. In each bucket of a key all members are compared, whole, with the smallest one. Links so far give labels.
    4. What may be missing are links between members of a bucket that are neither its smallest one nor of one label. Buckets
       with such members are compared in tiles of bounded size by parity sketches, whose distance never exceeds the symmetric
       difference, first along a spanning forest, then, with the labels renewed, in full; pairs within the bound are verified.

    So a bucket of near copies costs a few comparisons for each member, not for each pair.

    Null or empty text, or one without words: no shingles, linked with nothing, component_id is doc_id. Null doc_id:
    n_shingles as counted, component_id null, linked with nothing. Rows that repeat a doc_id are one document with the links
    of all its texts. Empty table: empty result. Very long texts count whole. Other columns are not looked at.
    """
    arrow_rows(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    sets = materialize(shingle_sets(docs, k), "jaccard-sets")
    named = sets.where("n_shingles > 0 and doc_id is not null")
    least = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    classes = materialize(named.join(spread(least, "d1", "d2"), ["d1", "d2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("other")), "jaccard-classes")

    # classes of a key are distinct before anything is gathered by key, and a key's rows are only ever aggregated and joined
    # with one row per key, so a hot key is spread over all tasks that met it
    keyed = materialize(_block_keys(docs, k, percent), "jaccard-keys")
    slices = _hits(keyed, classes)
    discard(keyed)
    hits = reduce(DataFrame.union, slices)
    hubs = hits.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("hi")).where("hub <> hi").select("key", "hub")
    members = materialize(hits.join(spread(hubs, "key"), "key").select("key", "doc_id", "hub"), "jaccard-members")
    discard(*slices)

    # a doc_id with several texts belongs to several classes, which are one document
    links = classes.where("class_id <> other").select(F.col("class_id").alias("a"), F.col("other").alias("b"))
    links = links.union(_verify(docs, members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), k, percent))
    labels = components(links)
    for forest in (True, False):
        known = members.where("doc_id <> hub").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        open_keys = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        todo = materialize(known.join(spread(open_keys, "key"), "key", "left_semi"), "jaccard-open")
        if todo.limit(1).count() == 0:
            break
        sketches = materialize(_sketches(docs, todo.select("doc_id").distinct(), k), "jaccard-sketches")
        pairs = materialize(_tile_pairs(todo, sketches, percent, forest), "jaccard-near")
        more = _verify(docs, pairs, k, percent)
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)

    out = named.join(classes.select("doc_id", "class_id"), "doc_id").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    return out.union(sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", "doc_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of smallest doc_id; all columns stay.

    Null or empty texts, and those without words, are linked with nothing and stay. Rows with null doc_id can't be linked and
    stay, too. Rows that share a doc_id are one document: of those that stay the one whose text is least in code point order
    (null first) is kept, and of rows alike in that any one. Very long texts count whole. Empty table: empty result.
    """
    found = jaccard_components(docs, k, percent)
    ids = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "jaccard-kept")
    not_single = _side(ids.where("doc_id <> component_id or rows > 1").select(F.col("doc_id").alias("_near_id")))
    again = _side(ids.where("doc_id = component_id and rows > 1").select(F.col("doc_id").alias("_near_id")))
    single = docs.join(not_single, docs["doc_id"] == not_single["_near_id"], "left_anti")
    # few rows as a rule; the least row of an id is found in each task before rows move
    several = docs.join(again, docs["doc_id"] == again["_near_id"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = several.groupBy(F.col("doc_id").alias("_near_id")).agg(F.min_by(row, F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit(""))).alias("_near_row"))
    return single.unionByName(least.select(*[F.col("_near_row").getField(c).alias(c) for c in docs.columns]))


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at three words and 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, hash(unnest(shingles)) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id
"""
