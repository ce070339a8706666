"""Sequence tables: construction, validation, packing and persistence.

The canonical table is long: ``session INT, seq BIGINT, t INT, y ARRAY<DOUBLE>, u ARRAY<DOUBLE>, visible BOOLEAN``, one
row for each valid step, ``t`` from 0 without gaps. A hidden step keeps its row, its inputs and its place in the chain;
only its observation doesn't count, so a null ``y`` is a hidden step. There are no padding rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session int, seq long, t int, y array<double>, u array<double>, visible boolean"


def from_events(events: DataFrame, observation: Column | None = None, session: Column | None = None, inputs: Column | None = None, hidden: Column | None = None) -> DataFrame:
    """Sequences of an event table: one for each ``user_id``, ordered by (ts, event_id).

    ``observation`` is an array column (default: the value); ``hidden`` marks steps whose observation doesn't count
    (default: errors).
    """
    y = F.array("value") if observation is None else observation
    t = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1")
    visible = ~(F.col("event_type") == "error" if hidden is None else hidden)
    return events.select(
        (F.lit(0) if session is None else session).cast("int").alias("session"), F.col("user_id").alias("seq"), t.cast("int").alias("t"),
        y.alias("y"), (F.array().cast("array<double>") if inputs is None else inputs).alias("u"), (visible & y.isNotNull()).alias("visible"),
    )


def numbered(rows: DataFrame, order: list[str], number: str = "t") -> DataFrame:
    """Adds ``number``: gapless from 0 in ``order`` over the whole table, without bringing it into one task.

    Rows are sorted by ranges; each range is numbered by itself and moved by the counts of the ranges before it, of which the
    driver sees one number a range. The sorted rows are held in memory and on disk, as both passes have to see the same ranges;
    ``order`` has to tell all rows apart.
    """
    place = F.monotonically_increasing_id()  # range * 2^33 + place within it
    kept = rows.orderBy(*order).withColumn("_place", place).persist(StorageLevel.MEMORY_AND_DISK)
    counts = kept.groupBy(F.shiftright("_place", 33).alias("_range")).count().orderBy("_range").collect()
    moved, before = [], 0
    for r in counts:
        moved.append((r["_range"], before))
        before += r["count"]
    begins = rows.sparkSession.createDataFrame(moved, "_range long, _before long")
    inner = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = kept.withColumn("_range", F.shiftright("_place", 33)).join(F.broadcast(begins), "_range")  # one row a range
    return joined.withColumn(number, F.col("_before") + inner).drop("_place", "_range", "_before")


def single(events: DataFrame, order: list[str], observation: Column, inputs: Column | None = None, hidden: Column | None = None) -> DataFrame:
    """All rows of a table as one sequence, in ``order``; it may be longer than a task can hold (see ``block`` of the models)."""
    rows = numbered(events, order)
    visible = F.lit(True) if hidden is None else ~hidden
    u = F.array().cast("array<double>") if inputs is None else inputs
    return rows.select(F.lit(0).alias("session"), F.lit(0).cast("long").alias("seq"), F.col("t").cast("int").alias("t"), observation.alias("y"), u.alias("u"), (visible & observation.isNotNull()).alias("visible"))


def from_arrays(spark: SparkSession, sessions: Sequence[Sequence[np.ndarray]], inputs: Sequence[Sequence[np.ndarray]] | None = None, visible: Sequence[Sequence[np.ndarray]] | None = None) -> DataFrame:
    """Sequences of in-memory arrays: ``sessions[s][n]`` is (T, D); for small data and tests."""
    rows = []
    for s, seqs in enumerate(sessions):
        for n, y in enumerate(seqs):
            y = np.atleast_2d(np.asarray(y, float).T).T
            for t in range(len(y)):
                u = [] if inputs is None else np.atleast_1d(np.asarray(inputs[s][n][t], float)).tolist()
                rows.append((s, n, t, y[t].tolist(), u, True if visible is None else bool(visible[s][n][t])))
    return spark.createDataFrame(rows, SCHEMA)


def from_padded(padded: DataFrame, values: str = "values", length: str = "length") -> DataFrame:
    """Rows (session, seq, t, y) of packed padded arrays and their lengths."""
    long = padded.select("session", "seq", F.col(length).alias("_n"), F.posexplode(values).alias("t", "y"))
    return long.where("t < _n").drop("_n")


def stack(*tables: DataFrame) -> DataFrame:
    """Sessions of several tables, numbered in order."""
    out = None
    for k, table in enumerate(tables):
        own = table.withColumn("session", F.lit(k).cast("int"))
        out = own if out is None else out.unionByName(own)
    return out


def lengths(sequences: DataFrame) -> DataFrame:
    """(session, seq, length)."""
    return sequences.groupBy("session", "seq").agg((F.max("t") + 1).alias("length"))


def one_session(sequences: DataFrame, session: int | None = None) -> DataFrame:
    """Rows of one session; which one may be left out only where there is one."""
    if session is None:
        found = [r[0] for r in sequences.select("session").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError("name a session: there isn't exactly one")
        session = found[0]
    return sequences.where(F.col("session") == session)


def violations(sequences: DataFrame) -> DataFrame:
    """One row of counts; all are 0 for a valid table.

    gaps (steps missing or repeated within sequences), ragged_y and ragged_u (sequences whose arrays change size), sizes_y
    (sessions with more than one observation size), sizes_u (input sizes beyond the first), not_finite, visible_nulls.
    """
    bad = "exists({0}, x -> isnan(x) or x in (double('infinity'), double('-infinity')))"
    per_seq = sequences.groupBy("session", "seq").agg(
        (F.count(F.lit(1)) - F.countDistinct("t") + F.max("t") + 1 - F.countDistinct("t")).alias("gaps"),
        F.min(F.size("y")).alias("y0"), F.max(F.size("y")).alias("y1"), F.min(F.size("u")).alias("u0"), F.max(F.size("u")).alias("u1"),
        F.sum(F.expr(f"cast({bad.format('y')} or {bad.format('u')} as int)")).alias("nf"), F.sum(F.expr("cast(visible and y is null as int)")).alias("vn"),
    )
    per_session = per_seq.groupBy("session").agg(
        F.sum("gaps").alias("gaps"), F.sum((F.col("y0") != F.col("y1")).cast("long")).alias("ry"), F.sum((F.col("u0") != F.col("u1")).cast("long")).alias("ru"),
        (F.max("y1") != F.min("y0")).cast("long").alias("sy"), F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.sum("nf").alias("nf"), F.sum("vn").alias("vn"),
    )
    total = per_session.agg(
        F.sum("gaps").alias("gaps"), F.sum("ry").alias("ragged_y"), F.sum("ru").alias("ragged_u"), F.sum("sy").alias("sizes_y"),
        (F.max("u1") != F.min("u0")).cast("long").alias("sizes_u"), F.sum("nf").alias("not_finite"), F.sum("vn").alias("visible_nulls"),
    )
    return total.select([F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in total.columns])


def validate(sequences: DataFrame) -> DataFrame:
    """The table itself; raises ValueError where :func:`violations` counts any."""
    found = {k: v for k, v in violations(sequences).first().asDict().items() if v}
    if found:
        raise ValueError(f"invalid sequences: {found}")
    return sequences


def packed(sequences: DataFrame) -> DataFrame:
    """(session, seq, length, y, u, visible) with one array element a step, in order of t."""
    steps = F.sort_array(F.collect_list(F.struct("t", "y", "u", "visible")))
    rows = sequences.groupBy("session", "seq").agg(steps.alias("s"))
    return rows.select("session", "seq", F.size("s").alias("length"), F.col("s.y").alias("y"), F.col("s.u").alias("u"), F.col("s.visible").alias("visible"))


def save(sequences: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes the table by session; fails where something is at ``path``, unless ``overwrite``."""
    sequences.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("session").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
