"""What the training-data operators share: reading, shared scratch tables, exact slot numbering, hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold while a scratch table is written; keeps a batch of long documents small in a Python worker.
ARROW_ROWS = 1000
#: Bytes of input that one task of a shuffle is to have at most (about).
TASK_BYTES = 256 << 20

_scratch: list[tuple[SparkSession, str]] = []


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ARROW_ROWS rows within; the session's own setting comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or a local one where that is unset and all is one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that the executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended and with it the means to delete
            return


class Scratch:
    """A folder of intermediate tables under :func:`shared_dir`; it goes with :meth:`drop`, or when the program ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        _scratch.append((spark, self.path))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table and returns it read back: cuts lineage and survives lost executors."""
        at = f"{self.path}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def buckets(self, name: str, df: DataFrame, key: str, then: Callable[[DataFrame], DataFrame] = lambda df: df, by: str | None = None) -> DataFrame:
        """Writes a table in hash buckets of ``key``: later joins on ``key`` don't move its rows. ``then`` works on rows dealt to buckets.
        ``by``: a column that ``then`` adds, to bucket by in place of ``key``; few of its values are to differ from ``key``, as others take a file each."""
        n = partitions(self.spark, df)
        table = f"{name}_{uuid.uuid4().hex}"
        with small_batches(self.spark):
            writer = then(df.repartition(n, key)).write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
            writer.bucketBy(n, by or key).saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def release(self) -> None:
        """Lets Spark delete shuffle files of jobs whose tables are written: it does so when the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            _delete(self.spark, f"{self.path}/{name}")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that on pure ASCII texts, and is much faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Tasks of a shuffle: those of the session, or more where the tables that ``df`` reads have over TASK_BYTES a task."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is None:
        return n
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    return max(n, -(-sum(x for x in sizes if x < 1 << 60) // TASK_BYTES))  # a leaf of unknown size counts as 2^63 - 1


def with_slots(df: DataFrame, groups: list[str], order: list[str], slot: str, rows: int, bucket_rows: int = 4096) -> DataFrame:
    """Adds ``slot``: gapless numbers from 0 within each of ``groups``, without bringing a group into one task.

    Rows are dealt to hash buckets of about ``bucket_rows`` rows of the whole table; each (group, bucket) is numbered
    by itself and moved by the count of the buckets before it. Counts are summed in two steps, over ranges of buckets
    and within each range, so that no task has more than about the square root of the buckets of a group.
    """
    n = max(1, -(-rows // bucket_rows))
    span = max(1, int(n**0.5))
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.floor(F.col("_bucket") / span))
    names = ", ".join(groups)
    ranges = counts.groupBy(*groups, "_range").agg(F.sum("_n").alias("_m"))
    ranges = ranges.withColumn("_base", F.expr(f"sum(_m) OVER (PARTITION BY {names} ORDER BY _range) - _m")).drop("_m")
    counts = counts.withColumn("_from", F.expr(f"sum(_n) OVER (PARTITION BY {names}, _range ORDER BY _bucket) - _n")).join(ranges, [*groups, "_range"])
    counts = counts.select(*groups, "_bucket", (F.col("_from") + F.col("_base")).alias("_from"))
    inner = F.expr(f"row_number() OVER (PARTITION BY {names}, _bucket ORDER BY {', '.join(order)}) - 1")
    numbered = bucketed.withColumn("_at", inner)
    return numbered.join(counts, [*groups, "_bucket"]).withColumn(slot, (F.col("_at") + F.col("_from")).cast("long")).drop("_bucket", "_at", "_from")
