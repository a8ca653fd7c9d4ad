"""Reports over parsing runs: medians, rates, ratios and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_feed(runs: DataFrame) -> DataFrame:
    """runs (feed_id, system, secs, entries) -> feed_id, system, median_secs, entries, runs, ok (whether any run gave entries)."""
    return runs.groupBy("feed_id", "system").agg(
        F.median("secs").alias("median_secs"), F.max("entries").alias("entries"), F.count("*").alias("runs"), (F.max(F.coalesce("entries", F.lit(0))) > 0).alias("ok"))


def entry_counts(feeds: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of each feed, 0 for those without."""
    return feeds.select(*keys).join(entries.groupBy(*keys).agg(F.count("*").alias("entries")), keys, "left").fillna(0, ["entries"])


def compare(feeds: DataFrame, ours: str, theirs: str) -> DataFrame:
    """per_feed rows of two systems side by side, with the ratio of their times."""
    side = lambda s, p: feeds.where(F.col("system") == s).select("feed_id", F.col("median_secs").alias(f"{p}_secs"), F.col("entries").alias(f"{p}_entries"), F.col("ok").alias(f"{p}_ok"))
    both = side(ours, "our").join(side(theirs, "their"), "feed_id")
    return both.withColumn("speedup", F.try_divide("their_secs", "our_secs"))


def totals(compared: DataFrame) -> DataFrame:
    """Sums over the feeds that both read, feeds a second, seconds a feed and the ratio of the summed times."""
    both = F.col("our_ok") & F.col("their_ok")
    out = compared.agg(
        F.count_if(both).alias("feeds"), F.coalesce(F.sum(F.when(both, F.col("our_secs"))), F.lit(0.0)).alias("our_secs"), F.coalesce(F.sum(F.when(both, F.col("their_secs"))), F.lit(0.0)).alias("their_secs"))
    return out.withColumns({"feeds_per_sec": F.try_divide("feeds", "our_secs"), "secs_per_feed": F.try_divide("our_secs", "feeds"), "speedup": F.try_divide("their_secs", "our_secs")})


def mismatches(compared: DataFrame) -> DataFrame:
    """Feeds in which the two find another number of entries, with the difference."""
    return compared.where("our_entries <> their_entries").select("feed_id", "our_entries", "their_entries", (F.col("our_entries") - F.col("their_entries")).alias("difference"))


def slowest(compared: DataFrame, below: float = 1.1) -> DataFrame:
    """Feeds whose ratio is below a threshold, the lowest first."""
    return compared.where(F.col("speedup") < below).orderBy("speedup", "feed_id")
