"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word class of every operator: runs of anything but these ASCII blanks.
BLANKS = "\\x20\\x09-\\x0D"
#: Rows a Python worker looks at together; keeps a batch of very long texts small.
SLICE = 512
#: Bytes of such a slice, about.
SLICE_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver see: ``spark.checkpoint.dir``.

    Only where that is unset (tests in one process) a temporary folder is made and
    stored in the session, so one session uses one folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='textspan-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/textspan/{label}-{uuid.uuid4().hex}"


#: Spark drops a query's shuffle files at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Paths of the tables of each session's work, until they are released.
_MADE: dict[str, list[str]] = {}


def table(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs
    no more than the stages since. (Compressed columns, where checkpoint() keeps raw rows.)
    The shuffle files behind it are of no more use and go. ``keep``: release_all() leaves it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    if not keep:
        _MADE.setdefault(shared_folder(spark), []).append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._textspan_path = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that are of no more use: whatever came of them has been written."""
    for t in tables:
        path = getattr(t, "_textspan_path", None)
        if path:
            _delete(t.sparkSession, path)
            made = _MADE.get(shared_folder(t.sparkSession), [])
            if path in made:
                made.remove(path)


def release_all(spark: SparkSession) -> None:
    """Delete all tables made so far: for a caller that has written its results."""
    for path in _MADE.pop(shared_folder(spark), []):
        _delete(spark, path)


def unambiguous(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns of a table which may hold clashing names; the first exact match counts,
    then the first that differs in case only."""
    lower = [c.lower() for c in df.columns]
    spread = df.toDF(*(f"__{i}" for i in range(len(df.columns))))
    at = [df.columns.index(n) if n in df.columns else lower.index(n.lower()) for n in names]
    return spread.select(*(F.col(f"__{i}").alias(n) for i, n in zip(at, names, strict=True)))


#: Bytes of an Arrow batch that Spark sends to a worker, and what it is where nobody has set it.
_SENT, _SENT_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def by_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE) -> DataFrame:
    """Map Arrow batches in slices of bounded row count and bytes, so that memory follows a slice. What
    Spark sends at once is bounded too, unless the session says otherwise."""
    if df.sparkSession.conf.get(_SENT) == _SENT_DEFAULT:
        df.sparkSession.conf.set(_SENT, "8m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                out = work(batch.slice(at, step))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{BLANKS}]+|[{BLANKS}]+\\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))


def word_count(text: Column) -> Column:
    """Number of words without building them: blank runs removed inside a trimmed text."""
    return F.size(words(text)).cast("long")


#: Rows of one group that one task ranks; larger groups are cut by hash into more buckets.
RANKED_TOGETHER = 256


def spread_rank(df: DataFrame, keys: list[str], order: Column, then: list[str], out: str = "rank") -> DataFrame:
    """Give each row its 0-based rank in its group without one task seeing a whole group.

    A group of n rows is cut into ceil(n / RANKED_TOGETHER) buckets by ``order``, a 64-bit hash
    made of the row's own values; its rows are ranked by (bucket, hash, then). Counts of
    buckets, not rows, are summed along a group. Equal rows may swap ranks among themselves.
    Null keys form groups like any other value. df is read twice: it should be a table.
    """
    h, b, n, k = "__hash", "__bucket", "__n", "__many"
    df = df.withColumn(h, order)
    many = df.groupBy(*keys).agg(F.ceil(F.count("*") / RANKED_TOGETHER).cast("long").alias(k))

    def match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        renamed = right.select(*(F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns))
        cond = F.lit(True)
        for c in on:
            cond = cond & left[c].eqNullSafe(renamed[f"__r_{c}"])
        return left.join(renamed, cond).drop(*(f"__r_{c}" for c in on))

    cut = match(df, many, keys).withColumn(b, F.pmod(F.col(h), F.col(k))).drop(k)
    counts = cut.groupBy(*keys, b).agg(F.count("*").alias(n))
    before = counts.select(
        *keys,
        b,
        (F.sum(n).over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)).alias("__before"),
    )
    own = F.row_number().over(Window.partitionBy(*keys, b).orderBy(h, *then))
    ranked = cut.withColumn("__own", own)
    return match(ranked, before, [*keys, b]).withColumn(out, F.col("__before") + F.col("__own") - 1).drop(h, b, "__own", "__before")
