"""Secret scans over a ledger of blobs: a content is scanned once per rule version, whatever paths it stands at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, spread, table
from .spans import blanked, count_kind, digest_text, spans_of

#: Kinds in their order.
KINDS = ("assign", "access", "hex")
#: Goes up whenever a rule changes; blobs scanned under another version count as unseen.
RULES_VERSION = 1

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

FOUND = "array<struct<kind:int,start:int,end:int>>"


def find_secrets(text: Column) -> Column:
    """The spans of all rules in a text that is not null, as an array of kind, start, end."""
    low = F.lower(text)
    named = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.filter(spans_of(text, 0, ASSIGN, named, 1), lambda s: F.length(s["hit"]) >= 12)
    access = F.filter(spans_of(text, 1, ACCESS, text.contains("AKIA")), lambda s: F.length(s["hit"]) >= 18)
    hexes = spans_of(text, 2, HEX, F.regexp_like(text, F.lit("[0-9a-f]{16}")))
    return F.transform(F.concat(assign, access, hexes), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


@dataclass(frozen=True)
class Ledger:
    """A Parquet table in shared storage: one row per blob and rule version that was scanned, with its findings."""

    path: str
    SCHEMA = f"digest string, found {FOUND}, rules_version int"

    def scanned(self, spark, rules_version: int) -> DataFrame:
        """digest, found of the pairs with this rule version; none if the ledger was never written."""
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.createDataFrame([], self.SCHEMA).drop("rules_version")
        rows = spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("rules_version") == rules_version)
        # a batch that was appended twice (a job that was started again) counts once
        return rows.groupBy("digest").agg(F.first("found").alias("found"))

    def scan(self, versions: DataFrame, rules_version: int = RULES_VERSION) -> None:
        """Scans the contents in versions (path, text) that have no row under this rule version, and appends their rows.

        The text of a content moves once, to where its digest was found at the smallest path: the other copies of it are
        dropped by a join with one row per new digest, in which the copies of a hot content were already counted together.
        """
        spark = versions.sparkSession
        blobs = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
        new = blobs.groupBy("digest").agg(F.min("path").alias("path"))
        new = new.join(self.scanned(spark, rules_version).select("digest"), "digest", "left_anti")
        new = new.select(F.col("digest").alias("new_digest"), F.col("path").alias("new_path"))
        one = blobs.join(new.hint("shuffle_hash"), (F.col("digest") == F.col("new_digest")) & F.col("path").eqNullSafe(F.col("new_path")), "left_semi")
        found = one.select("digest", find_secrets(F.col("text")).alias("found"), F.lit(rules_version).alias("rules_version"))
        found.write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, rules_version: int = RULES_VERSION) -> DataFrame:
        """versions -> path, found: the ledger's findings at every path that a content stands at."""
        at = versions.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        dirty = spread(self.scanned(versions.sparkSession, rules_version).where(F.size("found") > 0), "digest")
        return at.join(dirty, "digest", "left").select("path", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def scan_secrets(docs: DataFrame, ledger_path: str | None = None, rules_version: int = RULES_VERSION) -> DataFrame:
    """docs (doc_id, text) -> doc_id, found; one row per input row. Built-in functions only.

    Each row is a version of the blob at path doc_id. The ledger at ledger_path (a new one in the shared folder by default)
    keeps what was scanned: a second run over the same or more rows scans only new contents, and a new rules_version all.

    Null or empty text: scanned as the empty text, nothing found. Null doc_id: a path like any other. Repeated rows and
    copies under many ids: scanned once, found at each. Empty table: empty result. Very long texts are scanned whole.
    Other columns are not looked at.
    """
    ledger = Ledger(ledger_path or fresh_path(docs.sparkSession, "secret-ledger"))
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    ledger.scan(versions, rules_version)
    return ledger.findings(versions, rules_version).withColumnRenamed("path", "doc_id")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", ledger_path: str | None = None) -> DataFrame:
    """docs with each secret in text replaced by a mark, overlapping ones by one mark; all columns stay, n_chars follows.

    Findings belong to a content, so each row is redacted by its own text, whatever its doc_id: null and repeated ids, and
    unlike texts under one id, make no difference, and doc_id need not exist. Texts without a secret stay as they are, with
    their n_chars; null stays null, empty stays empty, repeated rows repeat. Very long texts are redacted whole. Empty table:
    empty result. Columns of any other name go through untouched.
    """
    ledger = Ledger(ledger_path or fresh_path(docs.sparkSession, "secret-ledger"))
    ledger.scan(docs.select(F.lit(None).cast("long").alias("path") if "doc_id" not in docs.columns else F.col("doc_id").alias("path"), "text"))
    dirty = ledger.scanned(docs.sparkSession, RULES_VERSION).where(F.size("found") > 0).select(F.col("digest").alias("_secret_digest"), F.col("found").alias("_secret_found"))
    dirty = spread(dirty, "_secret_digest")
    joined = docs.join(dirty, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == dirty["_secret_digest"], "left")
    hit = dirty["_secret_found"].isNotNull()
    text = F.when(hit, blanked(docs["text"], dirty["_secret_found"], mark)).otherwise(docs["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(text)).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    rows = scan_secrets(table(spark, sf_dir, "documents"))
    joined = digest_text(F.col("found"), KINDS)
    return rows.select("doc_id", *[count_kind(F.col("found"), k).alias(f"n_{n}") for k, n in enumerate(KINDS)], F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def _sql_kind(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    """The spans of a kind: gaps and matches give the offsets."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {kind} AS kind, '{name}' AS name, begins AS start, begins + length(hit) AS stop, value FROM (
    SELECT doc_id, hit, value, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) + sum(length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) AS begins
    FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{quoted}', 0)) AS hit, unnest(regexp_extract_all(t, '{quoted}', {group})) AS value,
      unnest((string_split_regex(t, '{quoted}'))[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, '{quoted}', 0), 1) AS i FROM d WHERE regexp_matches(t, '{quoted}')))
  WHERE length(value) >= {least}"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join([
    _sql_kind(0, "assign", r'''(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 1, 12),
    _sql_kind(1, "access", "AKIA[A-Z0-9]+", 0, 18),
    _sql_kind(2, "hex", "[0-9a-f]+", 0, 16),
])}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
