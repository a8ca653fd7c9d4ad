"""What the operators of this subpackage share: table reading, stage tables and Arrow batch size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: With it Spark deletes the shuffle files of a query at the query's end, else when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows per Arrow batch in the Python operators: whole texts of up to some MB still fit a worker.
ARROW_ROWS = 512

_own_dir: dict[str, str] = {}
#: Paths made within each open scratch().
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own on one machine; an error on a cluster,
    whose executors would each write their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="wireloom-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path in the shared folder; within scratch() it goes with it, unless it is kept."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, and any executor may be lost after it.

    The write is a query of its own, so nothing else reads its shuffle files; they go with its end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label, keep)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() gave and that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._stage_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made within are deleted at its end, unless they are kept: what leaves it must have been written as a kept table."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of an Arrow batch, so that a batch of whole texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, one row for each key, as the side of a join whose other side may hold a hot key.

    The keys become equal, computed columns. An aggregate's rows stay where they are for a join on its own keys, and then
    Spark can't split the other side's large partitions; computed keys are dealt anew, and it can.
    """
    computed = {k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) if df.schema[k].dataType.simpleString() == "bigint" else F.concat(F.col(k), F.lit("")) for k in keys}
    return df.withColumns(computed)
