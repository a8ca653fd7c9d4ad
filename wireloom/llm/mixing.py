"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

#: Relative weights of the sources in code point order, repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all words.
SHARE = 1.5
#: A target is at most so many times its source's size.
CAP = 2.0
#: Sampling weight of a document by its quality label; 1.0 without a label.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
#: Ranges of the sampling key per source; only one range of each source is sorted row by row.
KEY_RANGES = 16384
#: Up to so many sources their plan is broadcast (some 100 bytes each); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Up to so many labels (some 16 bytes each) are broadcast to the documents; beyond, whole rows are joined to them by a shuffle.
BROADCAST_LABELS = 500_000

WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the id: the smallest keys are a weighted sample without replacement."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / weight


def source_targets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with one row a source -> also target.

    Water level: targets are min(cap * size, level * weight). Sources sorted by the level at which they fill up; the first
    that is not full at its level fixes it. One row per source passes one task, never rows of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    left = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(left)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
    final = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("weight")).alias("fill"), F.col("level").alias("level")))).over(everything)
    return levels.withColumn("target", F.least(F.col("most"), F.coalesce(final["level"] * F.col("weight"), F.col("most")))).select("source", "source_size", "target")


def _mixed_rows(docs: DataFrame, quality: DataFrame | None, seed: str, weights, share: float, cap: float, carry: bool) -> DataFrame:
    """mix_sources, with carry also the rows themselves as a struct, row. Each row is decided where it is: rows move only to
    meet their quality label and, those of one key range of each source, to be sorted."""
    text = F.col("text")
    rows = docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("tie"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry))
    if quality is None:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    else:
        best = quality.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(F.broadcast(best) if small(quality, BROADCAST_LABELS) else best, "doc_id", "left")
    weight = F.lit(1.0)
    for label, value in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == label, F.lit(value)).otherwise(weight)
    rows = rows.withColumn("key", sampling_key(F.col("doc_id"), weight, seed))
    rows = rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * KEY_RANGES).cast("int")).drop("quality")
    # texts are read twice: a few seconds of counting words cost less than keeping a row per document
    ranges = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    plan = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ranges.withColumn("up_to", F.sum("range_size").over(up_to)).alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source"))
    # the range in which the rest ends: the first that reaches it
    edge = ends.where(F.col("up_to") >= F.col("rest")).groupBy("p.source").agg(F.min(F.struct("range", (F.col("up_to") - F.col("range_size")).alias("before"))).alias("edge"))
    plan = plan.alias("p").join(edge.alias("e"), F.expr("p.source <=> e.source"), "left")
    plan = materialize(plan.select("p.source", "source_size", "target", "epochs", "rest", F.coalesce("edge.range", F.lit(KEY_RANGES + 1)).alias("edge_range"), F.coalesce("edge.before", F.lit(0)).alias("edge_before")), "mix-plan")

    if small(plan, BROADCAST_SOURCES):
        plan = F.broadcast(plan)
    joined = rows.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).drop(F.col("p.source"))
    inside = joined.where(F.col("range") != F.col("edge_range")).withColumn("selected", F.col("range") < F.col("edge_range"))
    by_key = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ending = joined.where(F.col("range") == F.col("edge_range")).withColumn("through", F.col("edge_before") + F.sum("size").over(by_key))
    ending = ending.withColumn("selected", 2 * F.col("through") - F.col("size") <= 2 * F.col("rest")).drop("through")
    times = F.col("epochs") + F.col("selected").cast("long")
    out = inside.unionByName(ending)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "epochs", "selected", *["row"] * carry)


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", weights=SOURCE_WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken, epochs, selected; one row per input row.

    Each source is taken in whole epochs as often as its target holds; the rest of the target is filled with the documents
    of smallest sampling key, up to the document whose middle lies beyond the target. taken = size * (epochs + selected).
    quality: doc_id, quality; scales the sampling weight.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: sampled by the hash of "". Equal keys: by doc_id,
    then size, then the text's hash. Repeated rows count as often as they occur. Empty table: empty result. Other columns are
    not looked at. Reruns agree: the key depends on doc_id and seed alone. The sort by row is confined to the one key range in
    which a source's target ends; the ranges before and after are settled by sums per range.
    """
    return _mixed_rows(docs, quality, seed, weights, share, cap, False)


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken (not at all, once, twice, ...), with the columns of docs.

    Rows are decided one by one, as mix_sources says, so null or repeated doc_ids, repeated rows and unlike texts under one id
    stand as often as each of them is taken. Documents of size 0 (null, empty, without words) go: the mix takes no words of
    them. Very long texts are taken whole or not at all. Empty table: empty result. Extra columns go through untouched.
    """
    mixed = _mixed_rows(docs, quality, seed, SOURCE_WEIGHTS, SHARE, CAP, True)
    copies = mixed.where(F.col("taken") > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs") + F.col("selected").cast("long"))).alias("copy"))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """All of documents, mixed with the quality labels."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(CAST(documents.doc_id AS VARCHAR) || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / (CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS k
  FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM s),
v AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, most / weight) FROM v WHERE level * weight < most) * weight, most)) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN 2 * through - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
