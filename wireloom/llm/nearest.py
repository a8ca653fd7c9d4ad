"""Approximate nearest neighbours by additive quantisation with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .quantiser import Quantiser, _kmeans

#: Vectors that the codebooks are fitted on (about so many, chosen by a hash of the id); all vectors are indexed.
SAMPLE = 16_384
#: Codebooks, and candidates of a query that are reranked by their exact cosine.
BOOKS, RERANK = 24, 320
#: A query whose last candidate's approximate score is within so many standard errors of its k-th exact one is searched
#: exactly. The standard error of a score is that of a code over the root of the dimensions.
STANDARD_ERRORS = 2.0
#: Sides of a tile of the search: indexed vectors, and queries.
CHUNK, BLOCK = 65_536, 2_048
#: The space has a cell for each CHUNK vectors, but at most so many, as their centres come from the sample.
CELLS = 4_096
#: Queries that are searched in all cells to learn how many cells a query must meet, and the share of their neighbours that
#: must lie in those.
PROBES, PROBED = 256, 0.99


def usable(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, v, norm, n (components), digest of the vectors that take part.

    v is the vector over its largest component, so that norms neither overflow nor vanish. Null, empty and zero vectors, those
    with null or non-finite components, and those with null vec_id are left out.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and size(e) > 0")
    rows = rows.where(F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    rows = rows.withColumn("most", F.array_max(F.transform("e", lambda x: F.abs(x)))).where("most > 0")
    # + 0.0: a negative zero is a zero
    rows = rows.withColumn("v", F.transform("e", lambda x: x / F.col("most") + 0.0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", "v", norm.alias("norm"), F.size("v").alias("n")).withColumn("digest", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def sample_units(vectors: DataFrame, count: int, sample: int = SAMPLE) -> np.ndarray:
    """About `sample` unit vectors, by a hash of the id, in the order of their ids."""
    part = vectors if count <= sample else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(sample / count * (1 << 30)))
    got = part.select(F.transform("v", lambda x: (x / F.col("norm")).cast("float")).alias("u"), "vec_id").toArrow()
    return _matrix(got["u"].combine_chunks())[np.argsort(got["vec_id"].to_numpy(), kind="stable")]


def cell_centres(units: np.ndarray, cells: int) -> np.ndarray:
    """Centres of cells, of unit length."""
    if cells <= 1:
        return np.zeros((1, units.shape[1]), np.float32)
    found = _kmeans(np.array(units, np.float32), cells, 8, np.random.default_rng(1))
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def encode_vectors(classes: DataFrame, quantiser: Quantiser, centres: np.ndarray) -> DataFrame:
    """classes (digest, v, norm) -> digest, codes, length (of the approximation), error (distance of the unit vectors), cell."""
    shared = classes.sparkSession.sparkContext.broadcast((quantiser.books, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, centres = shared.value
        q = Quantiser(books)
        for batch in batches:
            units = _matrix(batch.column("v")) / batch.column("norm").to_numpy()[:, None]
            codes, lengths = q.encode(units)
            errors = np.linalg.norm(units - q.decode(codes) / np.where(lengths > 0, lengths, 1)[:, None], axis=1) if len(units) else lengths
            cells = np.argmax(units.astype(np.float32) @ centres.T, axis=1) if len(units) else []
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "length": pa.array(lengths, pa.float32()), "error": pa.array(errors, pa.float32()), "cell": pa.array(cells, pa.int32())})

    return classes.select("digest", "v", "norm").mapInArrow(run, "digest string, codes binary, length float, error float, cell int")


def cell_order(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """queries (query_id, digest, v, norm) -> also cells: the numbers of the `probes` nearest cells, nearest first."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _matrix(batch.column("v")).astype(np.float32)
            cells = np.argsort(-(units @ shared.value.T), axis=1, kind="stable")[:, :probes] if len(units) else np.empty((0, probes), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return queries.select("query_id", "digest", "v", "norm").mapInArrow(run, "query_id long, digest string, v array<double>, norm double, cells array<int>")


def _search(ordered: DataFrame, index: DataFrame, books: np.ndarray, keep: int) -> DataFrame:
    """ordered (query_id, digest, v, norm, cells), index -> query_id, own, digest, about, error, rank (of the digest's cell): the
    best `keep` of each query by lookup tables.

    A tile holds a bounded number of codes of one cell and of the queries that meet this cell: large cells are cut by the
    digest, queries by their id.
    """
    spark = index.sparkSession
    asks = ordered.select("query_id", F.col("digest").alias("own"), "v", "norm", F.posexplode("cells").alias("rank", "cell"))
    sizes = {r.cell: r.n for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asked = {r.cell: r.n for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # one row for each cell, of which there are CELLS at most
    plan = F.broadcast(spark.createDataFrame([(c, -(-n // CHUNK), -(-asked[c] // BLOCK)) for c, n in sizes.items() if c in asked], "cell int, chunks int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(plan, "cell").select("cell", "rank", "query_id", "own", "v", "norm", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), every("chunks").alias("chunk"))
    right = index.join(plan, "cell").select("cell", "digest", "codes", "length", "error", F.pmod(F.xxhash64("digest"), "chunks").cast("int").alias("chunk"), every("blocks").alias("block"))
    shared = spark.sparkContext.broadcast(books)

    def tile(_, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(held):
            q = Quantiser(shared.value)
            names = np.array(held["digest"].to_pylist(), object)
            order = np.argsort(names)
            names = names[order]
            codes = np.frombuffer(b"".join(held["codes"].to_pylist()), np.uint8).reshape(len(names), -1)[order]
            lengths, errors = held["length"].to_numpy()[order], held["error"].to_numpy()[order]
            units = _matrix(asked["v"].combine_chunks()) / asked["norm"].to_numpy()[:, None]
            for unit, query_id, own, rank in zip(units, *(asked[c].to_pylist() for c in ("query_id", "own", "rank"))):
                scores = q.scores(unit, codes, lengths)
                best = np.argsort(-scores, kind="stable")[:keep] if len(scores) <= keep else np.argpartition(-scores, keep)[:keep]
                out += [(query_id, own, names[i], float(scores[i]), float(errors[i]), rank) for i in best]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32())
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(("query_id", "own", "digest", "about", "error", "rank"), kinds))})

    keys = ("cell", "chunk", "block")
    rough = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "query_id long, own string, digest string, about double, error double, rank int")
    best = Window.partitionBy("query_id", "own").orderBy(F.desc("about"), "digest")
    return rough.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).drop("place")


def probes_needed(queries: DataFrame, index: DataFrame, books: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many of its nearest cells a query must meet, so that PROBED of its neighbours lie in them.

    Learnt from PROBES queries that meet all cells: from the ranks of the cells in which their k nearest lie.
    """
    if len(centres) == 1:
        return 1
    some = queries.orderBy(F.xxhash64("query_id"), "query_id", "digest").limit(PROBES)
    found = _search(cell_order(some, centres, len(centres)), index, books, k + 1).where("digest <> own").select("rank").collect()
    ranks = sorted(r["rank"] for r in found)
    return ranks[min(len(ranks) - 1, int(PROBED * len(ranks)))] + 1 if ranks else len(centres)


def _exact_tiles(queries: DataFrame, classes: DataFrame, chunks: int, keep: int) -> DataFrame:
    """queries (query_id, own, v, norm) -> query_id, own, digest: the best `keep` classes of each tile by the exact cosine.

    The sums are taken in the order of the components, as the last scoring does; ties go to the smaller id.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    left = queries.select("query_id", "own", "v", "norm", _tiles("block", F.col("query_id"), blocks), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    right = classes.select("digest", F.col("ids")[0].alias("least"), "v", "norm", _tiles("chunk", F.col("digest"), chunks), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def tile(_, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(held):
            names, least, norms = held["digest"].to_pylist(), held["least"].to_numpy(), held["norm"].to_numpy()
            columns = np.ascontiguousarray(_matrix(held["v"].combine_chunks()).T)
            for v, norm, query_id, own in zip(_matrix(asked["v"].combine_chunks()), asked["norm"].to_pylist(), asked["query_id"].to_pylist(), asked["own"].to_pylist()):
                dots = np.zeros(len(names))
                for x, column in zip(v, columns):
                    dots += x * column
                scores = dots / (norm * norms)
                # all that reach the last score that is kept, so that its ties are told by their ids
                best = np.flatnonzero(scores >= -np.partition(-scores, keep - 1)[keep - 1]) if len(scores) > keep else np.arange(len(scores))
                best = best[np.lexsort((least[best], -scores[best]))][:keep]
                out += [(query_id, own, names[i]) for i in best]
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(zip(("query_id", "own", "digest"), kinds))})

    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(tile, "query_id long, own string, digest string")


def _tiles(name: str, key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).alias(name)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """rows (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k nearest by cosine, of all rows but its own.

    Equal vectors are one class with its k + 1 smallest ids; nothing else of a class can be among the k nearest, as ties go
    to the smaller id. All classes are encoded, and lie in the cell of the nearest centre. A query meets as many of its
    nearest cells as a sample of queries, searched in all cells, shows to hold the neighbours; so work grows with the number
    of queries and not with its product with the number of vectors. They meet tile by tile: a tile holds a bounded number of
    codes and of queries and gives the best `rerank` classes by lookup tables; the best of all tiles are scored by the exact
    cosine in double precision. Where the last of them comes so near to the k-th exact score that the quantisation's errors
    may have kept out a nearer one (groups of near copies larger than `rerank`), or where fewer than k were found, the query
    meets all classes again, by their exact cosines. With k or fewer candidates all are returned.

    Which vectors take part: see usable(). Vectors of different lengths have no cosine: each length is a space of its own.
    Rows that repeat a vec_id with the same vector count once; with other vectors they are candidates of their own, and
    queries of one id (each neighbour once, at its best score). Ties in score go to the smaller vec_id. Empty table: empty
    result. Other columns are not looked at.
    """
    vectors = materialize(usable(rows.select("vec_id", "embedding")), "nearest-vectors")
    spaces = [(r.n, r["count"]) for r in vectors.groupBy("n").count().orderBy("n").collect()]
    found = [_nearest_in_space(vectors.where(F.col("n") == n).drop("n"), count, is_query, k, rerank, sample) for n, count in spaces]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    exact = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_in_space(vectors: DataFrame, count: int, is_query: Column, k: int, rerank: int, sample: int) -> DataFrame:
    """query_id, vec_id, score of the candidates that were scored exactly; vectors are of one length, at least one."""
    units = sample_units(vectors, count, sample)
    if not len(units):  # a hash can miss all of a few vectors
        units = sample_units(vectors.limit(sample), 0, sample)
    quantiser, centres = Quantiser.fit(units, BOOKS), cell_centres(units, min(CELLS, -(-count // CHUNK)))

    # row_number with a limit is cut in each task before rows move, so a hot class is a few rows for each
    first = Window.partitionBy("digest").orderBy("vec_id")
    few = vectors.select("digest", "vec_id").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    classes = few.groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("vec_id"))
    classes = classes.join(vectors.select("digest", "vec_id", "v", "norm"), ["digest", "vec_id"]).dropDuplicates(["digest"]).drop("vec_id")
    classes = materialize(classes, "nearest-classes")
    index = materialize(encode_vectors(classes, quantiser, centres), "nearest-index")
    queries = materialize(vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "digest").distinct().join(classes.select("digest", "v", "norm"), "digest"), "nearest-queries")

    chunks = -(-count // CHUNK)
    probes = probes_needed(queries, index, quantiser.books, centres, k)
    rough = materialize(_search(cell_order(queries, centres, probes), index, quantiser.books, rerank).drop("rank"), "nearest-rough")
    asked = queries.select("query_id", F.col("digest").alias("own"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)

    def score(pairs: DataFrame) -> DataFrame:
        exact = pairs.join(classes, "digest").join(asked, ["query_id", "own"]).select("query_id", F.explode("ids").alias("vec_id"), (dot / (F.col("qn") * F.col("norm"))).alias("score"))
        return exact.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    # the query's own class may hold other rows; it is always a candidate
    exact = materialize(score(rough.select("query_id", "own", "digest").union(queries.select("query_id", "digest", "digest")).distinct()), "nearest-exact")
    spaces = F.sqrt(F.size("v"))
    last = rough.groupBy("query_id", "own").agg(F.min("about").alias("last"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("error"), F.count("*").alias("n")).where(F.col("n") >= rerank)
    kth = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    open_ = queries.withColumnRenamed("digest", "own").join(last, ["query_id", "own"]).join(kth, "query_id", "left")
    open_ = open_.where(F.col("kth").isNull() | (F.col("last") + STANDARD_ERRORS * F.col("error") / spaces >= F.col("kth")))
    open_ = materialize(open_.select("query_id", "own", "v", "norm"), "nearest-open")
    if not open_.isEmpty():
        again = score(_exact_tiles(open_, classes, chunks, max(rerank, k + 1)))
        exact = exact.unionByName(again).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return exact


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
