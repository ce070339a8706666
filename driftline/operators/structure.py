"""Structural operators over sequence tables: time slices, lags, pairs, weights, nearest visible steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def order() -> WindowSpec:
    """Steps of a sequence in order of time."""
    return Window.partitionBy("session", "seq").orderBy("t")


def before() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def after() -> WindowSpec:
    return order().rowsBetween(0, Window.unboundedFollowing)


def select_time(sequences: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Steps start <= t < stop, renumbered from 0."""
    kept = sequences.where((F.col("t") >= start) & (F.lit(True) if stop is None else F.col("t") < stop))
    return kept.withColumn("t", (F.col("t") - start).cast("int"))


def transitions(sequences: DataFrame) -> DataFrame:
    """Steps that have a step before them, with their inputs: input t acts on the move from t-1 to t."""
    return sequences.where("t >= 1")


def weighted(sequences: DataFrame) -> DataFrame:
    """Adds ``w``: 1 where the observation counts, else 0."""
    return sequences.withColumn("w", F.col("visible").cast("double"))


def safe(value: Column, weight: Column | str = "w", neutral: Column | None = None) -> Column:
    """The value where its weight isn't 0; hidden values never reach arithmetic."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    return F.when(weight != 0, value).otherwise(F.lit(0.0) if neutral is None else neutral)


def adjacent_visible(sequences: DataFrame) -> DataFrame:
    """Steps that are visible along with the next one."""
    return sequences.withColumn("next_visible", F.lead("visible").over(order())).where("visible and next_visible").drop("next_visible")


def lagged(sequences: DataFrame, lags: int) -> DataFrame:
    """Adds ``lags`` (array of the last observations, most recent first), and makes ``visible`` whole-window visibility.

    The first ``lags`` steps of each sequence are history; ``r = t - lags`` numbers the others.
    """
    values = F.array(*[F.lag("y", k).over(order()) for k in range(1, lags + 1)])
    seen = reduce(lambda a, b: a & b, [F.lag("visible", k).over(order()) for k in range(1, lags + 1)], F.col("visible"))
    out = sequences.withColumns({"lags": values, "_seen": seen}).where(F.col("t") >= lags)
    return out.withColumns({"r": (F.col("t") - lags).cast("int"), "visible": F.col("_seen")}).drop("_seen")


def nearest_visible(sequences: DataFrame) -> DataFrame:
    """Adds left_t and right_t: nearest visible steps at or before, and at or after, each step."""
    at = F.when(F.col("visible"), F.col("t"))
    return sequences.withColumns({"left_t": F.last(at, True).over(before()), "right_t": F.first(at, True).over(after())})


def interpolated(sequences: DataFrame, baseline: list[float] | None = None) -> DataFrame:
    """Adds ``completed``: hidden observations filled linearly in gaps, by the nearest at the ends, else by ``baseline``."""
    at, value = F.when(F.col("visible"), F.col("t")), F.when(F.col("visible"), F.col("y"))
    edges = {"_lt": F.last(at, True).over(before()), "_ly": F.last(value, True).over(before()), "_rt": F.first(at, True).over(after()), "_ry": F.first(value, True).over(after())}
    out = sequences.withColumns(edges)
    share = (F.col("t") - F.col("_lt")) / (F.col("_rt") - F.col("_lt"))
    between = F.zip_with("_ly", "_ry", lambda a, b: a + (b - a) * share)
    rest = F.array(*[F.lit(float(x)) for x in baseline]) if baseline else F.transform("y", lambda x: F.lit(0.0))
    filled = F.when(F.col("visible"), F.col("y")).when(F.col("_lt").isNotNull() & F.col("_rt").isNotNull(), between)
    return out.withColumn("completed", F.coalesce(filled, "_ly", "_ry", rest)).drop(*edges)


def visible_fraction(sequences: DataFrame) -> DataFrame:
    """(session, seq, n_steps, n_visible, fraction)."""
    n = F.sum(F.col("visible").cast("long"))
    return sequences.groupBy("session", "seq").agg(F.count(F.lit(1)).alias("n_steps"), n.alias("n_visible"), (n / F.count(F.lit(1))).alias("fraction"))


def displacement_bins(pairs: DataFrame, x: Column, y: Column, dx: Column, dy: Column, limits: tuple[tuple[float, float], tuple[float, float]], bins: int) -> DataFrame:
    """(i, j, n, dx, dy): mean displacement in each cell of a plane; upper edges belong to the last cell."""

    def cell(v: Column, lo: float, hi: float) -> Column:
        k = F.floor((v - lo) / ((hi - lo) / bins))
        return F.when(v == hi, F.lit(bins - 1)).when((v >= lo) & (v < hi), F.least(k, F.lit(bins - 1))).cast("int")

    rows = pairs.select(cell(x, *limits[0]).alias("i"), cell(y, *limits[1]).alias("j"), dx.alias("dx"), dy.alias("dy")).where("i is not null and j is not null")
    return rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
