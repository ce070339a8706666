"""Exact deduplication over a log-structured merge index of digests.

``DigestIndex.flush`` writes memtables: runs of (digest, identifier, count) sorted by digest, each Parquet file with a
Bloom filter on the digest. ``compact`` merges FAN_IN runs at a time, level by level, into one sorted run that keeps one
identifier (smallest, or largest) and a count for each digest. ``find`` looks up a few digests by pushed equality filters, which consult the Bloom
filters; ``lookup`` probes all runs by a join. ``deduplicate`` verifies every hit byte by byte: least and greatest text of a
digest have to be the same.

Only DataFrame operations are used. Defined results: a null text counts as empty; of equal texts one row stays, one only
where rows repeat; rows that share an identifier but not the text are members of different groups; a null identifier is
the least one (-2^63 stands for it); an empty table gives an empty table; other columns of the input are not read. Rows with equal digests but different texts (never seen) form groups by their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, ascii_lower

#: Rows of one memtable, unless that makes over MAX_RUNS of them; runs that are merged at a time.
MEMTABLE_ROWS = 1 << 16
MAX_RUNS = 1024
FAN_IN = 8
#: Groups of more members than this, and than this share of all rows, are joined by a broadcast: no more groups than one over the share.
HOT_ROWS = 10_000
HOT_SHARE = 1e-4
#: Digests that one query of ``find`` looks up.
PROBES = 100
#: Stands for a null identifier.
NO_KEY = -(1 << 63)


def normalised(text: Column) -> Column:
    """The text that decides equality: A-Z in lower case, null as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


class DigestIndex:
    """Runs of digests in a shared folder. ``keep`` is "smallest" or "largest" identifier."""

    schema = "digest binary, id long, n long, run int"

    def __init__(self, spark: SparkSession, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS):
        if keep not in ("smallest", "largest"):
            raise ValueError(keep)
        self.spark, self.keep, self.memtable_rows = spark, keep, memtable_rows
        self.scratch = Scratch(spark, "digest-index")
        #: Tables of runs and the number of runs in each.
        self.levels: list[tuple[str, int]] = []
        self.made = 0

    def _best(self, col: str) -> Column:
        return F.min(col) if self.keep == "smallest" else F.max(col)

    def _write(self, merged: DataFrame, runs: int) -> None:
        name = f"runs-{self.made}"
        self.made += 1
        writer = merged.sortWithinPartitions("run", "digest").write.partitionBy("run")
        writer.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(self.memtable_rows)).parquet(f"{self.scratch.path}/{name}")
        self.levels.append((name, runs))

    def _merged(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, "digest").agg(self._best("id").alias("id"), F.sum("n").alias("n"))

    def flush(self, entries: DataFrame, rows: int) -> None:
        """Writes (digest, id) or (digest, id, n) as sorted runs, one for each memtable."""
        n = max(1, -(-rows // max(self.memtable_rows, -(-rows // MAX_RUNS))))
        # A memtable merges entries of its own before it is written: a digest with very many rows is one entry in a run.
        count = F.col("n") if "n" in entries.columns else F.lit(1).cast("long")
        run = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        self._write(self._merged(entries.select("digest", "id", count.alias("n"), run.alias("run")), "run"), n)

    def read(self) -> DataFrame:
        """(digest, id, n, run) of all runs."""
        tables, first = [], 0
        for name, runs in self.levels:
            tables.append(self.spark.read.schema(self.schema).parquet(f"{self.scratch.path}/{name}").select("digest", "id", "n", (F.col("run") + first).alias("run")))
            first += runs
        return reduce(DataFrame.union, tables)

    def compact(self) -> None:
        """Merges runs level by level until one is left."""
        while (runs := sum(n for _, n in self.levels)) > 1:
            old, left = self.levels, -(-runs // FAN_IN)
            merged = self._merged(self.read().withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")), "run")
            self.levels = []
            self._write(merged, left)
            self.scratch.drop(*[name for name, _ in old])

    def found(self) -> DataFrame:
        """(digest, keep_id, group_size) of every digest."""
        rows = self.read()
        rows = rows if sum(n for _, n in self.levels) == 1 else self._merged(rows)
        return rows.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))

    def find(self, digests: list[bytes]) -> dict[bytes, tuple[int, int]]:
        """(keep_id, group_size) of those digests that the index has."""
        out = {}
        for i in range(0, len(digests), PROBES):
            wanted = reduce(Column.__or__, [F.col("digest") == F.lit(bytearray(d)) for d in digests[i : i + PROBES]])
            out |= {bytes(r["digest"]): (r["id"], r["n"]) for r in self._merged(self.read().where(wanted)).collect()}
        return out

    def lookup(self, entries: DataFrame) -> DataFrame:
        """Adds keep_id and group_size to entries whose digest is in the index."""
        found = self.found()
        total = found.agg(F.sum("group_size")).first()[0] or 0
        hot = F.col("group_size") > max(HOT_ROWS, int(HOT_SHARE * total))
        crowded = F.broadcast(self.scratch.write(f"hot-{self.made}", found.where(hot)))
        rest = entries.join(crowded.select("digest"), "digest", "left_anti").join(found.where(~hot), "digest")
        return rest.unionByName(entries.join(crowded, "digest"))


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``documents``."""
    spark = documents.sparkSession
    index = DigestIndex(spark, keep, memtable_rows)
    base = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), normalised(F.col(text)).alias("body")).withColumn("digest", digest(F.col("body")))
    entries = index.scratch.write("entries", base.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")))
    index.flush(entries, entries.count())
    index.compact()
    probed = index.scratch.write("probed", index.lookup(entries))
    bad = _unverified(index.scratch, base, probed.where("group_size > 1").select("id", "digest"))
    if not bad.isEmpty():
        probed = _by_text(index, base, probed, bad)
    rows = probed.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))  # rows that repeat
    known = [F.when(F.col(c) != NO_KEY, F.col(c)).alias(to) for c, to in (("id", "doc_id"), ("keep_id", "keep_id"))]
    return rows.select(*known, "group_size", ((F.col("id") == F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _unverified(scratch: Scratch, base: DataFrame, members: DataFrame) -> DataFrame:
    """Digests of ``members`` (id, digest) that stand for more than one text. Texts move once; groups are merged before they move again."""
    bodies = base.join(members, ["id", "digest"], "left_semi")
    ends = bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return scratch.write("unverified", ends.where("low <> high").select("digest"))


def _by_text(index: DigestIndex, base: DataFrame, probed: DataFrame, bad: DataFrame) -> DataFrame:
    """Groups rows of digests that stand for more than one text by the text itself."""
    own = base.join(bad, "digest", "left_semi").groupBy("digest", "body", "id").agg(F.count(F.lit(1)).alias("n"))
    groups = own.groupBy("digest", "body").agg(index._best("id").alias("keep_id"), F.sum("n").alias("group_size"))
    columns = ["digest", "id", "n", "keep_id", "group_size"]
    return probed.join(bad, "digest", "left_anti").select(*columns).unionByName(own.join(groups, ["digest", "body"]).select(*columns))
