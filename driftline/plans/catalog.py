"""Registered engine queries over the event tables, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import columns
from driftline.functions.dists import Affine
from driftline.operators import align, cluster, grid, learning, moments, posteriors, structure
from driftline.functions.observations import BernoulliLikelihood, CategoricalStates, NegativeBinomialLikelihood
from driftline.functions.processes import HermiteBasis
from driftline.plans import starts, truth
from driftline.plans.collections import Collection, SessionRestarts
from driftline.plans.curves import CurveModel
from driftline.plans.models import ARHMM, HMM, LDS, POISSON, SLDS
from driftline.plans.walks import GatedWalk
from driftline.sources import sequences as source
from driftline.streaming import online

PI, P = [0.6, 0.4], np.array([[0.9, 0.1], [0.2, 0.8]])
MEAN, VAR = [20.0, 90.0], [400.0, 3600.0]
RATES = [math.log(2.0), math.log(8.0)]
AR = {"coefficients": [0.3, 0.1], "bias": [15.0, 70.0], "variance": [500.0, 4000.0]}
LDS1 = {"m0": 50.0, "s0": 2500.0, "a": 0.8, "b": 10.0, "q": 900.0, "c": 1.0, "d": 0.0, "r": 1600.0, "input": 0.5}
CENTERS = [5.0, 40.0, 150.0]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r(col: Column | str, name: str, digits: int = 6) -> Column:
    return (F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)).alias(name)


# Sources


def k_input() -> Column:
    return F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("double")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str, counts: bool = False, sessions: bool = False) -> DataFrame:
    y = F.array(F.floor(F.col("value") / 10).cast("double")) if counts else None
    return source.from_events(events(spark, sf_dir), y, F.col("user_id") % 3 if sessions else None, F.array(k_input()))


E = """e AS (SELECT 0 AS session, user_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, value AS y,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS u, event_type <> 'error' AS visible, floor(value / 10) AS c FROM events)"""
KEYS = ["session", "seq"]


@query(f"WITH {E} SELECT session::INT AS session, seq, t, y, u, visible FROM e")
def seq_build(spark, sf_dir):
    return seqs(spark, sf_dir).select("session", "seq", "t", F.col("y")[0].alias("y"), F.col("u")[0].alias("u"), "visible")


@query(f"WITH {E} SELECT session::INT AS session, seq, (max(t) + 1)::INT AS length FROM e GROUP BY ALL")
def seq_lengths(spark, sf_dir):
    return source.lengths(seqs(spark, sf_dir))


@query(f"WITH {E} SELECT session::INT AS session, seq, count(*)::INT AS length, round(list(y ORDER BY t)[1], 6) + 0.0 AS first_y, round(list(y ORDER BY t)[-1], 6) + 0.0 AS last_y FROM e GROUP BY ALL")
def seq_pack(spark, sf_dir):
    packed = source.packed(seqs(spark, sf_dir))
    return packed.select("session", "seq", "length", r(F.element_at("y", 1)[0], "first_y"), r(F.element_at("y", -1)[0], "last_y"))


@query(f"""WITH {E}, s AS (SELECT session, seq, count(*) - count(DISTINCT t) + max(t) + 1 - count(DISTINCT t) AS gaps, count(*) FILTER (isnan(y) OR isinf(y) OR isnan(u) OR isinf(u)) AS nf,
    count(*) FILTER (visible AND y IS NULL) AS vn FROM e GROUP BY ALL)
    SELECT sum(gaps)::BIGINT AS gaps, 0::BIGINT AS ragged_y, 0::BIGINT AS ragged_u, 0::BIGINT AS sizes_y, 0::BIGINT AS sizes_u, sum(nf)::BIGINT AS not_finite, sum(vn)::BIGINT AS visible_nulls FROM s""")
def dataset_validate(spark, sf_dir):
    return source.violations(seqs(spark, sf_dir))


@query("""SELECT (user_id % 3)::INT AS session, count(DISTINCT user_id) AS n_seqs, count(*) AS n_steps FROM events GROUP BY ALL""")
def sessions_by_key(spark, sf_dir):
    return seqs(spark, sf_dir, sessions=True).groupBy("session").agg(F.countDistinct("seq").alias("n_seqs"), F.count(F.lit(1)).alias("n_steps"))


@query(f"WITH {E}, s AS (SELECT 0 AS session, t FROM e WHERE t < 20 UNION ALL SELECT 1, t - 20 FROM e WHERE t >= 20) SELECT session::INT AS session, count(*) AS n_steps, max(t)::INT AS last_t FROM s GROUP BY ALL")
def dataset_stack(spark, sf_dir):
    e = seqs(spark, sf_dir)
    both = source.stack(structure.select_time(e, 0, 20), structure.select_time(e, 20))
    return both.groupBy("session").agg(F.count(F.lit(1)).alias("n_steps"), F.max("t").alias("last_t"))


# Structure


@query(f"WITH {E} SELECT session::INT AS session, seq, count(*) AS n_steps, count(*) FILTER (visible) AS n_visible, round(count(*) FILTER (visible) / count(*), 6) + 0.0 AS fraction FROM e GROUP BY ALL")
def visible_fraction(spark, sf_dir):
    return structure.visible_fraction(seqs(spark, sf_dir)).withColumn("fraction", r("fraction", "f"))


@query(f"WITH {E} SELECT session::INT AS session, seq, round(coalesce(sum(y) FILTER (visible), 0), 4) + 0.0 AS total FROM e GROUP BY ALL")
def weighted_sum(spark, sf_dir):
    w = structure.weighted(seqs(spark, sf_dir))
    return w.groupBy(*KEYS).agg(r(F.sum(F.col("w") * structure.safe(F.col("y")[0])), "total", 4))


@query(f"WITH {E} SELECT session::INT AS session, seq, (t - 10)::INT AS t, y FROM e WHERE t >= 10 AND t < 20")
def select_time(spark, sf_dir):
    return structure.select_time(seqs(spark, sf_dir), 10, 20).select(*KEYS, "t", F.col("y")[0].alias("y"))


@query(f"WITH {E} SELECT session::INT AS session, seq, t, u FROM e WHERE t >= 1")
def transitions(spark, sf_dir):
    return structure.transitions(seqs(spark, sf_dir)).select(*KEYS, "t", F.col("u")[0].alias("u"))


@query(f"WITH {E}, p AS (SELECT *, lead(visible) OVER (PARTITION BY seq ORDER BY t) AS n FROM e) SELECT session::INT AS session, seq, t FROM p WHERE visible AND n")
def adjacent_visible(spark, sf_dir):
    return structure.adjacent_visible(seqs(spark, sf_dir)).select(*KEYS, "t")


@query(f"""WITH {E}, p AS (SELECT *, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(visible, 1) OVER w AS v1, lag(visible, 2) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY seq ORDER BY t))
    SELECT session::INT AS session, seq, (t - 2)::INT AS r, y, y1, y2, visible AND v1 AND v2 AS visible FROM p WHERE t >= 2""")
def lag_windows(spark, sf_dir):
    out = structure.lagged(seqs(spark, sf_dir), 2)
    return out.select(*KEYS, "r", F.col("y")[0].alias("y"), F.col("lags")[0][0].alias("y1"), F.col("lags")[1][0].alias("y2"), "visible")


_NEAR = """n AS (SELECT *, last_value(CASE WHEN visible THEN t END IGNORE NULLS) OVER b AS lt, first_value(CASE WHEN visible THEN t END IGNORE NULLS) OVER a AS rt,
    last_value(CASE WHEN visible THEN y END IGNORE NULLS) OVER b AS ly, first_value(CASE WHEN visible THEN y END IGNORE NULLS) OVER a AS ry FROM e
    WINDOW b AS (PARTITION BY seq ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY seq ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {E}, {_NEAR} SELECT session::INT AS session, seq, t, coalesce(lt, -1)::INT AS left_t, coalesce(rt, -1)::INT AS right_t FROM n")
def nearest_visible(spark, sf_dir):
    return structure.nearest_visible(seqs(spark, sf_dir)).select(*KEYS, "t", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("left_t", "right_t")])


@query(f"""WITH {E}, {_NEAR} SELECT session::INT AS session, seq, t, round(CASE WHEN visible THEN y WHEN lt IS NOT NULL AND rt IS NOT NULL THEN ly + (ry - ly) * ((t - lt) / (rt - lt)) ELSE coalesce(ly, ry, 0) END, 6) + 0.0 AS completed FROM n""")
def interpolate_hidden(spark, sf_dir):
    return structure.interpolated(seqs(spark, sf_dir)).select(*KEYS, "t", r(F.col("completed")[0], "completed"))


@query(f"""WITH {E}, p AS (SELECT *, lead(y) OVER (PARTITION BY seq ORDER BY t) - y AS dy, lead(u) OVER (PARTITION BY seq ORDER BY t) - u AS du FROM e), b AS (
    SELECT least(floor(y / 20), 9)::INT AS i, least(floor(u / 10), 9)::INT AS j, dy, du FROM p WHERE dy IS NOT NULL AND y BETWEEN 0 AND 200 AND u BETWEEN 0 AND 100)
    SELECT i, j, count(*) AS n, floor((200 * sum(round(100 * dy)::BIGINT) + count(*))::DOUBLE / (2 * count(*))) / 10000 + 0.0 AS dx,
        floor((200 * sum(round(100 * du)::BIGINT) + count(*))::DOUBLE / (2 * count(*))) / 10000 + 0.0 AS dy FROM b GROUP BY i, j""")
def binned_displacement(spark, sf_dir):
    """Values have two decimals: displacements are summed as whole hundredths, and means rounded half up to four digits as whole numbers."""
    e = seqs(spark, sf_dir).select(*KEYS, "t", F.col("y")[0].alias("y"), F.col("u")[0].alias("u"))
    p = e.withColumns({"dy": F.lead("y").over(structure.order()) - F.col("y"), "du": F.lead("u").over(structure.order()) - F.col("u")}).where("dy is not null")
    out = structure.displacement_bins(p, F.col("y"), F.col("u"), F.round(100 * F.col("dy")).cast("long"), F.round(100 * F.col("du")).cast("long"), ((0.0, 200.0), (0.0, 100.0)), 10)
    whole = {c: F.floor((200 * F.round(F.col(c) * F.col("n")) + F.col("n")) / (2 * F.col("n"))) / 10000.0 for c in ("dx", "dy")}
    return out.select("i", "j", "n", *[v.alias(c) for c, v in whole.items()])


# Densities, moments, regressions


def _gauss_sql(y: str, m: float, v: float) -> str:
    return f"(-0.5 * (({y} - {m}) * ({y} - {m}) / {v} + {math.log(v) + columns.LOG_2PI!r}))"


@query(f"WITH {E} SELECT seq, t, round({_gauss_sql('y', MEAN[0], VAR[0])}, 6) + 0.0 AS l0, round({_gauss_sql('y', MEAN[1], VAR[1])}, 6) + 0.0 AS l1 FROM e")
def gauss_loglik_states(spark, sf_dir):
    y = F.col("y")
    return seqs(spark, sf_dir).select("seq", "t", *[r(columns.gaussian_log_prob(y, [m], [v]), f"l{k}") for k, (m, v) in enumerate(zip(MEAN, VAR, strict=True))])


@query(f"WITH {E} SELECT seq, t, round(c * {RATES[0]!r} - 2 - lgamma(c + 1), 6) + 0.0 AS l0, round(c * {RATES[1]!r} - 8 - lgamma(c + 1), 6) + 0.0 AS l1 FROM e")
def poisson_loglik_states(spark, sf_dir):
    e = seqs(spark, sf_dir, counts=True).withColumn("lf", columns.log_factorial(F.col("y")[0]))
    return e.select("seq", "t", *[r(columns.poisson_log_prob(F.col("y")[0], rate, F.col("lf")), f"l{k}") for k, rate in enumerate(RATES)])


_COV2 = np.array([[500.0, 40.0], [40.0, 900.0]])
_P2 = np.linalg.inv(_COV2)


@query(f"""WITH {E}, d AS (SELECT seq, t, y - 40 AS a, u - 50 AS b FROM e) SELECT seq, t, round(-0.5 * (a * a * {float(_P2[0, 0])!r} + 2 * a * b * {float(_P2[0, 1])!r} + b * b * {float(_P2[1, 1])!r} + {float(np.linalg.slogdet(_COV2)[1]) + 2 * columns.LOG_2PI!r}), 6) + 0.0 AS lp FROM d""")
def full_gaussian_loglik(spark, sf_dir):
    e = seqs(spark, sf_dir)
    return e.select("seq", "t", r(columns.full_gaussian_log_prob(F.concat("y", "u"), [40.0, 50.0], _COV2), "lp"))


@query("SELECT vec_id, round(0.5 * embedding[1]::DOUBLE - 0.25 * embedding[2]::DOUBLE + 1, 6) + 0.0 AS z0, round(2 * embedding[3]::DOUBLE + embedding[1]::DOUBLE - 1, 6) + 0.0 AS z1 FROM embeddings")
def affine_apply(spark, sf_dir):
    x = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    z = columns.affine(x, np.array([[0.5, -0.25, 0.0], [1.0, 0.0, 2.0]]), [1.0, -1.0])
    return table(spark, sf_dir, "embeddings").select("vec_id", r(z[0], "z0"), r(z[1], "z1"))


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore(spark, sf_dir):
    return moments.zscore(events(spark, sf_dir), "value", ["event_type"]).select("event_id", r("z", "z"))


_FIT_SQL = """WITH d AS (SELECT l_returnflag, {w} AS w, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem),
    s AS (SELECT l_returnflag, sum(w) AS n, sum(w * a) / sum(w) AS m0, sum(w * b) / sum(w) AS m1, sum(w * a * a) / sum(w) AS q00, sum(w * a * b) / sum(w) AS q01, sum(w * b * b) / sum(w) AS q11 FROM d GROUP BY ALL)
    SELECT l_returnflag, round(n, 4) + 0.0 AS n, round(m0, 4) + 0.0 AS m0, round(m1, 4) + 0.0 AS m1, round(q00 - m0 * m0, 4) + 0.0 AS c0_0, round(q01 - m0 * m1, 4) + 0.0 AS c0_1, round(q11 - m1 * m1, 4) + 0.0 AS c1_1 FROM s"""


def _lineitem_fit(spark, sf_dir, weight):
    out = moments.weighted_moments(table(spark, sf_dir, "lineitem"), [F.col("l_quantity"), F.col("l_extendedprice") / 1000], weight, ["l_returnflag"])
    return out.select("l_returnflag", *[r(c, c, 4) for c in ("n", "m0", "m1", "c0_0", "c0_1", "c1_1")])


@query(_FIT_SQL.format(w="1 - l_discount"))
def weighted_gaussian_fit(spark, sf_dir):
    return _lineitem_fit(spark, sf_dir, 1 - F.col("l_discount"))


@query(_FIT_SQL.format(w="1.0"))
def grouped_gaussian_fit(spark, sf_dir):
    return _lineitem_fit(spark, sf_dir, F.lit(1.0))


@query("SELECT l_returnflag, count(*)::DOUBLE AS n, round(ln(greatest(avg(l_quantity), 1e-8)), 6) + 0.0 AS log_rate FROM lineitem GROUP BY ALL")
def grouped_poisson_fit(spark, sf_dir):
    out = moments.weighted_poisson(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.lit(1.0), ["l_returnflag"])
    return out.select("l_returnflag", "n", r("log_rate", "log_rate"))


_REG_SQL = f"""WITH {E}, p AS (SELECT y, lag(y) OVER w AS x, visible AND lag(visible) OVER w AS v FROM e WINDOW w AS (PARTITION BY seq ORDER BY t)),
    s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(y * y) - avg(y) * avg(y) AS yy FROM p WHERE v AND x IS NOT NULL),
    f AS (SELECT *, xy / (xx * (1 + 1e-6)) AS w FROM s)"""


@query(f"{_REG_SQL} SELECT round(w, 5) + 0.0 AS coefficient, round(my - w * mx, 4) + 0.0 AS bias, round(yy - 2 * w * xy + w * w * xx + 1e-6 * yy, 2) + 0.0 AS variance FROM f")
def ridge_regression(spark, sf_dir):
    rows = structure.lagged(seqs(spark, sf_dir), 1).where("visible").withColumn("x", F.flatten("lags"))
    w, b, c = moments.regression(rows, F.col("x"), F.col("y"), (1, 1))[()]
    return spark.createDataFrame([(round(float(w[0, 0]), 5), round(float(b[0]), 4), round(float(c[0, 0]), 2))], "coefficient double, bias double, variance double")


@query("""SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) + 0.0 AS m0, round(avg(embedding[2]::DOUBLE), 6) + 0.0 AS m1, round(avg(embedding[1]::DOUBLE * embedding[2]::DOUBLE) - avg(embedding[1]::DOUBLE) * avg(embedding[2]::DOUBLE), 6) + 0.0 AS c0_1 FROM embeddings GROUP BY ALL""")
def lda_class_moments(spark, sf_dir):
    x = [F.col("embedding")[i].cast("double") for i in range(2)]
    out = moments.weighted_moments(table(spark, sf_dir, "embeddings"), x, F.lit(1.0), ["label"])
    return out.select("label", F.col("n").cast("long").alias("n"), r("m0", "m0"), r("m1", "m1"), r("c0_1", "c0_1"))


@query("""SELECT round(avg(embedding[1]::DOUBLE), 6) + 0.0 AS m0, round(avg(embedding[2]::DOUBLE), 6) + 0.0 AS m1, round(var_pop(embedding[1]::DOUBLE) + var_pop(embedding[2]::DOUBLE), 5) + 0.0 AS total FROM embeddings""")
def pca_mean_cov(spark, sf_dir):
    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))
    mean, _, values = cluster.pca(table(spark, sf_dir, "embeddings"), x, 2, 2)
    return spark.createDataFrame([(round(float(mean[0]), 6), round(float(mean[1]), 6), round(float(values.sum()), 5))], "m0 double, m1 double, total double")


@query()
def lda_directions(spark, sf_dir):
    """Discriminant directions of embedding labels, in all coordinates."""
    sums = moments.vector_sums(table(spark, sf_dir, "embeddings"), "embedding", "label")
    labels = sorted(sums)
    n, s, q = (np.array([sums[k][i] for k in labels]) for i in range(3))
    directions, _ = align.lda_directions(n, s / n[:, None], q)
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(directions) for j, v in enumerate(row)], "dimension int, direction int, weight double")


# Clustering

_ASSIGN = "CASE WHEN abs(y - {0}) <= abs(y - {1}) AND abs(y - {0}) <= abs(y - {2}) THEN 0 WHEN abs(y - {1}) <= abs(y - {2}) THEN 1 ELSE 2 END"


@query(f"WITH {E} SELECT seq, t, {_ASSIGN.format(*CENTERS)}::INT AS k FROM e")
def kmeans_assign(spark, sf_dir):
    return seqs(spark, sf_dir).select("seq", "t", cluster.assign(F.col("y"), np.array(CENTERS)[:, None]).alias("k"))


def _kmeans_sql(steps: int) -> str:
    parts = [f"{E}", f"c0 AS (SELECT {CENTERS[0]}::DOUBLE AS a, {CENTERS[1]}::DOUBLE AS b, {CENTERS[2]}::DOUBLE AS c)"]
    for k in range(steps):
        g = _ASSIGN.format(f"c{k}.a", f"c{k}.b", f"c{k}.c")
        parts.append(f"g{k} AS (SELECT y, {g} AS k FROM e, c{k} WHERE visible)")
        parts.append(f"c{k + 1} AS (SELECT coalesce((SELECT avg(y) FROM g{k} WHERE k = 0), a) AS a, coalesce((SELECT avg(y) FROM g{k} WHERE k = 1), b) AS b, coalesce((SELECT avg(y) FROM g{k} WHERE k = 2), c) AS c FROM c{k})")
    return f"WITH {', '.join(parts)} SELECT round(a, 4) + 0.0 AS c0, round(b, 4) + 0.0 AS c1, round(c, 4) + 0.0 AS c2 FROM c{steps}".replace("SELECT y, CASE", "SELECT e.y, CASE")


@query(_kmeans_sql(5))
def kmeans_steps(spark, sf_dir):
    c = cluster.kmeans(seqs(spark, sf_dir).where("visible"), F.col("y"), np.array(CENTERS)[:, None], 5)
    return spark.createDataFrame([tuple(round(float(v), 4) for v in c[:, 0])], "c0 double, c1 double, c2 double")


# Hidden Markov models


def hmm() -> HMM:
    return HMM({"initial_probs": PI, "transition_probs": P, "emissions": [{"mean": np.array(MEAN)[:, None], "covariance": np.array(VAR)[:, None, None]}]})


def hmm_counts() -> HMM:
    return HMM({"initial_probs": PI, "transition_probs": P, "emissions": [{"log_rates": np.array(RATES)[:, None]}]}, POISSON)


def _chain_sql(l0: str, l1: str, rows: str = "e") -> str:
    """Forward (f) and backward (b) recursions of a two-state chain over log factors; g has both."""
    p = [[repr(float(x)) for x in row] for row in P]
    return f"""l AS (SELECT *, exp(l0 - m) AS e0, exp(l1 - m) AS e1 FROM (SELECT *, greatest(l0, l1) AS m FROM (SELECT *, {l0} AS l0, {l1} AS l1 FROM {rows}))),
    f AS (SELECT seq, t, m, e0, e1, {PI[0]} * e0 + {PI[1]} * e1 AS c, {PI[0]} * e0 / ({PI[0]} * e0 + {PI[1]} * e1) AS a0, {PI[1]} * e1 / ({PI[0]} * e0 + {PI[1]} * e1) AS a1 FROM l WHERE t = 0
        UNION ALL SELECT seq, t, m, e0, e1, v0 + v1, v0 / (v0 + v1), v1 / (v0 + v1) FROM (
            SELECT l.seq, l.t, l.m, l.e0, l.e1, (a0 * {p[0][0]} + a1 * {p[1][0]}) * l.e0 AS v0, (a0 * {p[0][1]} + a1 * {p[1][1]}) * l.e1 AS v1 FROM f JOIN l ON l.seq = f.seq AND l.t = f.t + 1)),
    n AS (SELECT seq, max(t) AS last FROM f GROUP BY ALL),
    b AS (SELECT seq, last AS t, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM n
        UNION ALL SELECT f.seq, f.t - 1, ({p[0][0]} * f.e0 * b0 + {p[0][1]} * f.e1 * b1) / f.c, ({p[1][0]} * f.e0 * b0 + {p[1][1]} * f.e1 * b1) / f.c FROM b JOIN f ON f.seq = b.seq AND f.t = b.t WHERE f.t > 0),
    g AS (SELECT f.*, b0, b1, a0 * b0 / (a0 * b0 + a1 * b1) AS g0, a1 * b1 / (a0 * b0 + a1 * b1) AS g1 FROM f JOIN b USING (seq, t))"""


_L = [f"CASE WHEN visible THEN {_gauss_sql('y', m, v)} ELSE 0 END" for m, v in zip(MEAN, VAR, strict=True)]
_HMM = f"WITH RECURSIVE {E}, {_chain_sql(*_L)}"


def _local(e: DataFrame) -> DataFrame:
    parts = [F.when(F.col("visible"), columns.gaussian_log_prob(F.col("y"), [m], [v])).otherwise(0.0) for m, v in zip(MEAN, VAR, strict=True)]
    return columns.pack_local(e, F.array(*parts))


@query(f"{_HMM} SELECT seq, round(sum(ln(c) + m), 4) + 0.0 AS log_likelihood FROM f GROUP BY ALL")
def hmm_forward_ll(spark, sf_dir):
    """Native forward recursion: one fold over each packed sequence."""
    packed = _local(seqs(spark, sf_dir)).select("seq", columns.forward(F.col("ell"), PI, P).alias("f"))
    return packed.select("seq", r("f.log_likelihood", "log_likelihood", 4))


@query(f"{_HMM} SELECT (seq % 2 + 1)::INT AS session, seq, round(sum(ln(c) + m), 4) + 0.0 AS log_likelihood FROM f GROUP BY ALL")
def hmm_session_ids_ll(spark, sf_dir):
    """Sessions 1 and 2, each with emissions of its own; emissions go by the session's identifier."""
    e = seqs(spark, sf_dir).withColumn("session", (F.col("seq") % 2 + 1).cast("int"))
    own = hmm().params["emissions"][0]
    return hmm().replace(emissions={1: own, 2: own}).objective(e).select("session", "seq", r("objective", "log_likelihood", 4))


@query(f"{_HMM} SELECT seq, t, round(a0, 6) + 0.0 AS a0, round(a1, 6) + 0.0 AS a1 FROM f")
def hmm_filter(spark, sf_dir):
    packed = _local(seqs(spark, sf_dir)).select("seq", columns.forward(F.col("ell"), PI, P).alias("f"))
    return packed.select("seq", F.posexplode("f.steps").alias("t", "a")).select("seq", "t", r(F.col("a")[0], "a0"), r(F.col("a")[1], "a1"))


@query(f"{_HMM} SELECT seq, t, round(g0, 6) + 0.0 AS g0, round(g1, 6) + 0.0 AS g1 FROM g")
def hmm_gamma(spark, sf_dir):
    return hmm().infer(seqs(spark, sf_dir)).select("seq", "t", r(F.col("gamma")[0], "g0"), r(F.col("gamma")[1], "g1"))


@query(f"""{_HMM} SELECT x.seq, x.t, round(x.a0 * {float(P[0, 0])} * y.e0 * y.b0 / y.c, 6) + 0.0 AS x00, round(x.a0 * {float(P[0, 1])} * y.e1 * y.b1 / y.c, 6) + 0.0 AS x01,
    round(x.a1 * {float(P[1, 0])} * y.e0 * y.b0 / y.c, 6) + 0.0 AS x10, round(x.a1 * {float(P[1, 1])} * y.e1 * y.b1 / y.c, 6) + 0.0 AS x11 FROM g x JOIN g y ON x.seq = y.seq AND y.t = x.t + 1""")
def hmm_xi(spark, sf_dir):
    rows = hmm().infer(seqs(spark, sf_dir)).where("xi_next is not null")
    return rows.select("seq", "t", *[r(F.col("xi_next")[i][j], f"x{i}{j}") for i in range(2) for j in range(2)])


@query(f"{_HMM} SELECT seq, t, CASE WHEN g0 >= g1 THEN 0 ELSE 1 END::INT AS state FROM g")
def hmm_decode(spark, sf_dir):
    return hmm().decode(seqs(spark, sf_dir)).select("seq", "t", "state")


_XI = " + ".join(f"CASE WHEN v{i}{j} > 0 THEN v{i}{j} * ln(v{i}{j}) ELSE 0 END" for i in range(2) for j in range(2))


@query(f"""{_HMM}, x AS (SELECT x.seq, x.t, x.a0 * {float(P[0, 0])} * y.e0 * y.b0 / y.c AS v00, x.a0 * {float(P[0, 1])} * y.e1 * y.b1 / y.c AS v01, x.a1 * {float(P[1, 0])} * y.e0 * y.b0 / y.c AS v10, x.a1 * {float(P[1, 1])} * y.e1 * y.b1 / y.c AS v11
        FROM g x JOIN g y ON x.seq = y.seq AND y.t = x.t + 1),
    h AS (SELECT seq, t, CASE WHEN g0 > 0 THEN g0 * ln(g0) ELSE 0 END + CASE WHEN g1 > 0 THEN g1 * ln(g1) ELSE 0 END AS own FROM g)
    SELECT h.seq, round(sum(CASE WHEN t > 0 AND t < last THEN own ELSE 0 END) - coalesce(any_value(pairs), 0), 4) + 0.0 AS entropy, round(any_value(ll), 4) + 0.0 AS elbo
    FROM h JOIN n USING (seq) LEFT JOIN (SELECT seq, sum({_XI}) AS pairs FROM x GROUP BY ALL) USING (seq) JOIN (SELECT seq, sum(ln(c) + m) AS ll FROM f GROUP BY ALL) USING (seq) GROUP BY h.seq""")
def hmm_entropy_elbo(spark, sf_dir):
    return hmm().entropy(seqs(spark, sf_dir)).select("seq", r("entropy", "entropy", 4), r("elbo", "elbo", 4))


@query(f"{_HMM} SELECT seq, t, round(g0 * {MEAN[0]} + g1 * {MEAN[1]}, 5) + 0.0 AS mean FROM g")
def hmm_observation_mean(spark, sf_dir):
    return hmm().observation_mean(seqs(spark, sf_dir)).select("seq", "t", r(F.col("mean")[0], "mean", 5))


_COUNTS = f"""{_HMM}, k AS (SELECT sum(CASE WHEN t = 0 THEN g0 END) AS i0, sum(CASE WHEN t = 0 THEN g1 END) AS i1 FROM g),
    x AS (SELECT sum(x.a0 * {float(P[0, 0])} * y.e0 * y.b0 / y.c) AS x00, sum(x.a0 * {float(P[0, 1])} * y.e1 * y.b1 / y.c) AS x01, sum(x.a1 * {float(P[1, 0])} * y.e0 * y.b0 / y.c) AS x10, sum(x.a1 * {float(P[1, 1])} * y.e1 * y.b1 / y.c) AS x11
        FROM g x JOIN g y ON x.seq = y.seq AND y.t = x.t + 1),
    w AS (SELECT sum(g0) AS n0, sum(g1) AS n1, sum(g0 * y) / sum(g0) AS m0, sum(g1 * y) / sum(g1) AS m1, sum(g0 * y * y) / sum(g0) AS q0, sum(g1 * y * y) / sum(g1) AS q1 FROM g JOIN e USING (seq, t) WHERE visible)"""


@query(f"{_COUNTS} SELECT round(i0, 3) + 0.0 AS i0, round(i1, 3) + 0.0 AS i1, round(x00, 3) + 0.0 AS x00, round(x01, 3) + 0.0 AS x01, round(x10, 3) + 0.0 AS x10, round(x11, 3) + 0.0 AS x11, round(n0, 3) + 0.0 AS n0, round(n1, 3) + 0.0 AS n1 FROM k, x, w")
def hmm_expected_counts(spark, sf_dir):
    model = hmm()
    with learning.Packed(seqs(spark, sf_dir)) as data:
        s = data.sums(lambda b: model._statistics(b, model._infer(b)[0]))[0]
    flat = [*s["first"], *s["pairs"].ravel(), *s["n"]]
    return spark.createDataFrame([tuple(round(float(v), 3) for v in flat)], ", ".join(f"{n} double" for n in ("i0", "i1", "x00", "x01", "x10", "x11", "n0", "n1")))


@query(f"""{_COUNTS} SELECT round(i0 / (i0 + i1), 5) + 0.0 AS pi0, round(x00 / (x00 + x01), 5) + 0.0 AS p00, round(x10 / (x10 + x11), 5) + 0.0 AS p10, round(m0, 3) + 0.0 AS m0, round(m1, 3) + 0.0 AS m1,
    round((q0 - m0 * m0) * (1 + 1e-6), 1) + 0.0 AS v0, round((q1 - m1 * m1) * (1 + 1e-6), 1) + 0.0 AS v1 FROM k, x, w""")
def hmm_em_step(spark, sf_dir):
    p = hmm().fit(seqs(spark, sf_dir), 1).model.params
    e = p["emissions"][0]
    values = (round(p["initial_probs"][0], 5), round(p["transition_probs"][0, 0], 5), round(p["transition_probs"][1, 0], 5), *[round(x, 3) for x in e["mean"][:, 0]], *[round(x, 1) for x in e["covariance"][:, 0, 0]])
    return spark.createDataFrame([tuple(map(float, values))], ", ".join(f"{n} double" for n in ("pi0", "p00", "p10", "m0", "m1", "v0", "v1")))


@query()
def hmm_fit_trace(spark, sf_dir):
    """Objective of every EM step, from a K-means start."""
    e = seqs(spark, sf_dir)
    return HMM.initialize(e, 2).fit(e, 5).trace_table(spark)


@query(f"""WITH RECURSIVE {E}, {_chain_sql(*[f"CASE WHEN visible THEN c * {rate!r} - {math.exp(rate)!r} - lgamma(c + 1) ELSE 0 END" for rate in RATES])} SELECT seq, round(sum(ln(f.c) + f.m), 4) + 0.0 AS log_likelihood FROM f GROUP BY ALL""")
def hmm_poisson_ll(spark, sf_dir):
    return hmm_counts().objective(seqs(spark, sf_dir, counts=True)).select("seq", r("objective", "log_likelihood", 4))


@query()
def hmm_sessions_fit(spark, sf_dir):
    """A multi-session HMM: shared chain, emissions for each session."""
    e = seqs(spark, sf_dir, sessions=True)
    return HMM.initialize(e, 2).fit(e, 3).trace_table(spark)


@query("SELECT * FROM (VALUES (0, 1), (1, 0)) AS v(target, source)")
def state_match(spark, sf_dir):
    order = align.match_by_mean(np.array(MEAN)[:, None], np.array([[100.0], [10.0]]))
    return spark.createDataFrame(list(enumerate(map(int, order))), "target int, source int")


@query(f"{_HMM} SELECT seq, t, round(g1, 6) + 0.0 AS g0, round(g0, 6) + 0.0 AS g1 FROM g")
def permute_states(spark, sf_dir):
    return hmm().permute_states([1, 0]).infer(seqs(spark, sf_dir)).select("seq", "t", r(F.col("gamma")[0], "g0"), r(F.col("gamma")[1], "g1"))


# Autoregressive models

_AR_ROWS = "a AS (SELECT * FROM (SELECT seq, (t - 1)::INT AS t, y, lag(y) OVER w AS x, visible AND lag(visible) OVER w AS visible FROM e WINDOW w AS (PARTITION BY seq ORDER BY t)) WHERE t >= 0)"
_AR_L = [f"CASE WHEN visible THEN {_gauss_sql('y', 0, v).replace('y - 0', f'y - {c} * x - {b}')} ELSE 0 END" for c, b, v in zip(AR["coefficients"], AR["bias"], AR["variance"], strict=True)]


def arhmm() -> ARHMM:
    e = {"coefficients": np.array(AR["coefficients"])[:, None, None], "bias": np.array(AR["bias"])[:, None], "covariance": np.array(AR["variance"])[:, None, None]}
    return ARHMM({"initial_probs": PI, "transition_probs": P, "emissions": [e]})


@query(f"WITH RECURSIVE {E}, {_AR_ROWS}, {_chain_sql(*_AR_L, rows='a')} SELECT seq, round(sum(ln(c) + m), 4) + 0.0 AS log_likelihood FROM f GROUP BY ALL")
def arhmm_forward_ll(spark, sf_dir):
    return arhmm().objective(seqs(spark, sf_dir)).select("seq", r("objective", "log_likelihood", 4))


@query(f"WITH RECURSIVE {E}, {_AR_ROWS}, {_chain_sql(*_AR_L, rows='a')} SELECT seq, (t + 1)::INT AS t, round(g0, 6) + 0.0 AS g0 FROM g")
def arhmm_gamma(spark, sf_dir):
    return arhmm().infer(seqs(spark, sf_dir)).select("seq", "t", r(F.col("gamma")[0], "g0"))


@query(f"WITH {E}, {_AR_ROWS} SELECT seq, (t + 1)::INT AS t, round({AR['coefficients'][0]} * x + {AR['bias'][0]}, 6) + 0.0 AS m0, round({AR['coefficients'][1]} * x + {AR['bias'][1]}, 6) + 0.0 AS m1 FROM a")
def arhmm_state_means(spark, sf_dir):
    """Mean of the next observation given each state and the history."""
    rows = arhmm().state_means(seqs(spark, sf_dir))
    return rows.select("seq", "t", *[r(F.col("means")[k][0], f"m{k}") for k in range(2)])


@query()
def arhmm_fit_trace(spark, sf_dir):
    e = seqs(spark, sf_dir)
    return ARHMM.initialize(e, 2, 2).fit(e, 3).trace_table(spark)


@query()
def arhmm_poisson_fit(spark, sf_dir):
    e = seqs(spark, sf_dir, counts=True)
    return ARHMM.initialize(e, 2, 1, POISSON).fit(e, 2).trace_table(spark)


# Linear dynamical systems


def lds(inputs: bool = False) -> LDS:
    p = LDS1
    shared = {"initial_mean": [p["m0"]], "initial_covariance": [[p["s0"]]], "dynamics_coefficients": [[p["a"]]], "dynamics_bias": [p["b"]], "dynamics_covariance": [[p["q"]]]}
    if inputs:
        shared["dynamics_input_coefficients"] = [[p["input"]]]
    return LDS(shared | {"emissions": [{"coefficients": [[p["c"]]], "bias": [p["d"]], "covariance": [[p["r"]]]}]})


def _kalman_sql(inputs: bool) -> str:
    p = LDS1
    drive = f"{p['b']} + {p['input']} * e.u" if inputs else f"{p['b']}"
    update = """CASE WHEN visible THEN pm + pv / (pv + {r}) * (y - pm) ELSE pm END AS m, CASE WHEN visible THEN pv * {r} / (pv + {r}) ELSE pv END AS v,
        CASE WHEN visible THEN -0.5 * ((y - pm) * (y - pm) / (pv + {r}) + ln(pv + {r}) + {c!r}) ELSE 0 END AS ll""".format(r=p["r"], c=columns.LOG_2PI)
    return f"""WITH RECURSIVE {E},
    k AS (SELECT seq, t, pm, pv, {update} FROM (SELECT seq, t, y, visible, {p["m0"]}::DOUBLE AS pm, {p["s0"]}::DOUBLE AS pv FROM e WHERE t = 0)
        UNION ALL SELECT seq, t, pm, pv, {update} FROM (SELECT e.seq, e.t, e.y, e.visible, {p["a"]} * m + {drive} AS pm, {p["a"] ** 2!r} * v + {p["q"]} AS pv FROM k JOIN e ON e.seq = k.seq AND e.t = k.t + 1)),
    n AS (SELECT seq, max(t) AS last FROM e GROUP BY ALL),
    s AS (SELECT k.seq, k.t, m AS sm, v AS sv, 0.0::DOUBLE AS cross_next FROM k JOIN n ON k.seq = n.seq AND k.t = last
        UNION ALL SELECT seq, t, m + j * (sm - npm), v + j * j * (sv - npv), j * sv FROM (
            SELECT k.seq, k.t, k.m, k.v, s.sm, s.sv, x.pm AS npm, x.pv AS npv, k.v * {p["a"]} / x.pv AS j FROM s JOIN k ON k.seq = s.seq AND k.t = s.t - 1 JOIN k x ON x.seq = s.seq AND x.t = s.t))"""


@query(f"{_kalman_sql(False)} SELECT seq, t, round(sm, 4) + 0.0 AS mean, round(sv, 4) + 0.0 AS variance FROM s")
def lds_smooth_scalar(spark, sf_dir):
    return lds().infer(seqs(spark, sf_dir)).select("seq", "t", r(F.col("mean")[0], "mean", 4), r(F.col("cov")[0][0], "variance", 4))


@query(f"{_kalman_sql(False)} SELECT seq, round(sum(ll), 4) + 0.0 AS log_likelihood FROM k GROUP BY ALL")
def lds_ll_scalar(spark, sf_dir):
    return lds().objective(seqs(spark, sf_dir)).select("seq", r("objective", "log_likelihood", 4))


@query(f"{_kalman_sql(True)} SELECT seq, t, round(sm, 4) + 0.0 AS mean, round(sv, 4) + 0.0 AS variance FROM s")
def lds_controlled(spark, sf_dir):
    return lds(True).infer(seqs(spark, sf_dir)).select("seq", "t", r(F.col("mean")[0], "mean", 4), r(F.col("cov")[0][0], "variance", 4))


@query(f"{_kalman_sql(False)} SELECT seq, t, round(cross_next, 4) + 0.0 AS cross_cov FROM s JOIN n USING (seq) WHERE t < last")
def lds_cross_covariance(spark, sf_dir):
    return lds().infer(seqs(spark, sf_dir)).where("cross_next is not null").select("seq", "t", r(F.col("cross_next")[0][0], "cross_cov", 4))


@query(f"{_kalman_sql(False)} SELECT seq, round(sum(ll), 3) + 0.0 AS elbo FROM k GROUP BY ALL")
def lds_elbo(spark, sf_dir):
    return lds().elbo(seqs(spark, sf_dir)).select("seq", r("elbo", "elbo", 3))


@query(f"{_kalman_sql(False)} SELECT seq, t, round({LDS1['c']} * sm + {LDS1['d']}, 4) + 0.0 AS mean FROM s")
def lds_observation_mean(spark, sf_dir):
    return lds().observation_mean(seqs(spark, sf_dir)).select("seq", "t", r(F.col("mean")[0], "mean", 4))


@query(f"""{_kalman_sql(False)}, z AS (SELECT x.sm AS mx, y.sm AS my, x.sv + x.sm * x.sm AS xx, y.sv + y.sm * y.sm AS yy, x.cross_next + x.sm * y.sm AS xy FROM s x JOIN s y ON x.seq = y.seq AND y.t = x.t + 1),
    q AS (SELECT avg(mx) AS mx, avg(my) AS my, avg(xx) - avg(mx) * avg(mx) AS xx, avg(yy) - avg(my) * avg(my) AS yy, avg(xy) - avg(mx) * avg(my) AS xy FROM z), w AS (SELECT *, xy / (xx * (1 + 1e-6)) AS a FROM q)
    SELECT round(a, 4) + 0.0 AS a, round(my - a * mx, 3) + 0.0 AS b, round(yy - 2 * a * xy + a * a * xx + 1e-6 * yy, 1) + 0.0 AS q FROM w""")
def lds_em_step_scalar(spark, sf_dir):
    p = lds().fit(seqs(spark, sf_dir), 1).model.params
    row = (round(float(p["dynamics_coefficients"][0, 0]), 4), round(float(p["dynamics_bias"][0]), 3), round(float(p["dynamics_covariance"][0, 0]), 1))
    return spark.createDataFrame([row], "a double, b double, q double")


@query(f"""WITH RECURSIVE {E}, m AS (SELECT seq, t, {LDS1['m0']}::DOUBLE AS m FROM e WHERE t = 0
    UNION ALL SELECT e.seq, e.t, {LDS1['a']} * m + {LDS1['b']} + {LDS1['input']} * e.u FROM m JOIN e ON e.seq = m.seq AND e.t = m.t + 1) SELECT seq, t, round(m, 5) + 0.0 AS mean FROM m""")
def lds_prior_mean(spark, sf_dir):
    """Latent means before any observation, driven by inputs."""
    return lds(True).prior_mean(seqs(spark, sf_dir)).select("seq", "t", r(F.col("mean")[0], "mean", 5))


@query(f"""{_REG_SQL}, o AS (SELECT avg(y) AS mu, var_pop(y) AS v, avg(y) FILTER (t = 0) AS m0, var_pop(y) FILTER (t = 0) AS s0 FROM e WHERE visible), c AS (SELECT *, 1 / (1 + 1e-6) AS k FROM o)
    SELECT round(m0 - mu, 4) + 0.0 AS m0, round(s0 + 1e-2 * v, 2) + 0.0 AS s0, round(w, 5) + 0.0 AS a, round(my - mu - w * (mx - mu), 4) + 0.0 AS b, round(yy - 2 * w * xy + w * w * xx + 1e-2 * yy, 2) + 0.0 AS q,
    round(k, 6) + 0.0 AS c, round(mu, 4) + 0.0 AS d, round((1 - k) * (1 - k) * v + 1e-2 * v, 3) + 0.0 AS r FROM f, c""")
def lds_via_pca(spark, sf_dir):
    """The start of an LDS from pseudo-latents; with one coordinate they are the centred observations."""
    e = seqs(spark, sf_dir).withColumn("u", F.array().cast("array<double>"))
    p = starts.lds_via_pca(e, 1).params
    o = p["emissions"][0]
    row = [(p["initial_mean"][0], 4), (p["initial_covariance"][0, 0], 2), (p["dynamics_coefficients"][0, 0], 5), (p["dynamics_bias"][0], 4), (p["dynamics_covariance"][0, 0], 2), (o["coefficients"][0, 0], 6), (o["bias"][0], 4), (o["covariance"][0, 0], 3)]
    return spark.createDataFrame([tuple(round(float(v), n) + 0.0 for v, n in row)], "m0 double, s0 double, a double, b double, q double, c double, d double, r double")


@query()
def poisson_lds_via_pca(spark, sf_dir):
    """Emissions of a Poisson LDS regressed on pseudo-latents of log counts."""
    e = _counts2(spark, sf_dir)
    o = starts.lds_via_pca(e, 2, POISSON).params["emissions"][0]
    return spark.createDataFrame([(i, float(b), *map(float, w)) for i, (w, b) in enumerate(zip(o["coefficients"], o["bias"], strict=True))], "coordinate int, bias double, c0 double, c1 double")


@query()
def lds_fit_trace(spark, sf_dir):
    e = source.from_events(events(spark, sf_dir), F.array("value", k_input()))
    return LDS.initialize(e, 2).fit(e, 3).trace_table(spark)


def _counts2(spark, sf_dir) -> DataFrame:
    return source.from_events(events(spark, sf_dir), F.array(F.floor(F.col("value") / 10).cast("double"), F.floor(k_input() / 10)))


@query()
def poisson_lds_mode(spark, sf_dir):
    """Laplace posterior of a Poisson LDS."""
    e = _counts2(spark, sf_dir)
    return LDS.initialize(e, 2, POISSON).infer(e).select("seq", "t", F.col("mean")[0].alias("x0"), F.col("mean")[1].alias("x1"))


@query()
def poisson_lds_fit(spark, sf_dir):
    e = _counts2(spark, sf_dir)
    return LDS.initialize(e, 2, POISSON).fit(e, 2).trace_table(spark)


@query()
def slds_infer(spark, sf_dir):
    """Mean-field posterior of a switching system."""
    e = source.from_events(events(spark, sf_dir), F.array("value", k_input()))
    return SLDS.initialize(e, 2, 2).infer(e).select("seq", "t", "state", F.col("gamma")[0].alias("g0"), F.col("mean")[0].alias("x0"))


@query()
def slds_via_arhmm(spark, sf_dir):
    """Posterior of a switching system started from an AR-HMM of pseudo-latents."""
    e = source.from_events(events(spark, sf_dir), F.array("value", k_input()))
    return starts.slds_via_arhmm(e, 2, 2, num_iters=3).infer(e).select("seq", "t", "state", F.col("mean")[0].alias("x0"))


@query()
def slds_fit_trace(spark, sf_dir):
    e = source.from_events(events(spark, sf_dir), F.array("value", k_input()))
    return SLDS.initialize(e, 2, 2).fit(e, 3).trace_table(spark)


@query()
def slds_poisson_infer(spark, sf_dir):
    e = _counts2(spark, sf_dir)
    return SLDS.initialize(e, 2, 2, POISSON).infer(e).select("seq", "t", "state", F.col("mean")[0].alias("x0"))


@query(f"{_kalman_sql(False)} SELECT seq, round(sum(ll), 3) + 0.0 AS elbo FROM k GROUP BY ALL")
def slds_one_state_elbo(spark, sf_dir):
    """With one state the bound is the LDS log-likelihood."""
    p = lds().params
    one = SLDS({
        "initial_probs": [1.0], "transition_probs": [[1.0]], "latent_initial_means": p["initial_mean"][None], "latent_initial_covariances": p["initial_covariance"][None],
        "dynamics_coefficients": p["dynamics_coefficients"][None], "dynamics_bias": p["dynamics_bias"][None], "dynamics_covariances": p["dynamics_covariance"][None], "emissions": p["emissions"],
    })
    return one.elbo(seqs(spark, sf_dir)).select("seq", r("elbo", "elbo", 3))


# Sampling and grids


@query("SELECT s::INT AS session, n::BIGINT AS seq, (10 + n)::BIGINT AS n_steps FROM range(2) a(s), range(5) b(n)")
def sample_shapes(spark, sf_dir):
    two = hmm().replace(emissions=[hmm().params["emissions"][0]] * 2)
    rows = two.sample(spark, {s: [10 + n for n in range(5)] for s in range(2)}, seed=1)
    return rows.groupBy("session", "seq").agg(F.count(F.lit(1)).alias("n_steps"))


def _mass_sql(center: str) -> str:
    """Three-point Gauss-Legendre mass of a cell of width 10 under N(sm, sv)."""
    nodes, weights = np.polynomial.legendre.leggauss(3)
    return " + ".join(f"5 * {float(w)!r} * exp({_gauss_sql(f'({center} + {5 * float(x)!r})', 0, 1).replace(' - 0', ' - sm').replace('/ 1', '/ sv').replace(repr(columns.LOG_2PI), f'ln(sv) + {columns.LOG_2PI!r}')})" for x, w in zip(nodes, weights, strict=True))


@query(f"{_kalman_sql(False)}, c AS (SELECT k::INT AS cell, -45.0::DOUBLE + 10 * k AS mid FROM range(30) x(k)) SELECT seq, cell, round(avg({_mass_sql('mid')}), 6) + 0.0 AS mass FROM s, c GROUP BY ALL")
def occupancy_grid(spark, sf_dir):
    """Time-averaged posterior mass of each cell."""
    post = lds().infer(seqs(spark, sf_dir))
    return grid.occupancy(post, [np.linspace(-50, 250, 31)], [0]).select("seq", F.col("cell")[0].alias("cell"), r("mass", "mass"))


@query(f"{_kalman_sql(False)}, c AS (SELECT k::INT AS cell, -45.0::DOUBLE + 10 * k AS mid FROM range(30) x(k)) SELECT seq, t, cell, round({_mass_sql('mid')}, 6) + 0.0 AS mass FROM s, c")
def grid_per_step(spark, sf_dir):
    """Posterior mass of each cell at each step."""
    rows = grid.per_step(lds().infer(seqs(spark, sf_dir)), [np.linspace(-50, 250, 31)], [0])
    return rows.select("seq", "t", F.col("cell")[0].alias("cell"), r("mass", "mass"))


@query(f"""{_kalman_sql(False)} SELECT seq, round(sum(0.5 * (1 + {columns.LOG_2PI!r} + ln(CASE WHEN t = last THEN v ELSE v * {LDS1['q']} / ({LDS1['a'] ** 2!r} * v + {LDS1['q']}) END))), 4) + 0.0 AS entropy
    FROM k JOIN n USING (seq) GROUP BY seq""")
def chain_entropy(spark, sf_dir):
    """Entropy of the Gaussian posterior path of each sequence."""
    model = lds()

    def make(b: learning.Batch):
        return learning.pd.DataFrame({"session": np.int32(b.session), "seq": b.seq, "entropy": model._infer(b)[0].entropy()})

    return learning.rows(learning.packed(seqs(spark, sf_dir)), "session int, seq long, entropy double", make).select("seq", r("entropy", "entropy", 4))


# One sequence over many tasks

_ONE = "o AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1)::INT AS t, value AS y, event_type <> 'error' AS visible FROM events)"
#: Doublings of the SQL that checks blocked inference: sequences of up to 2^18 steps.
_DOUBLINGS = 18


def one(spark, sf_dir) -> DataFrame:
    """All events in order of time as one sequence."""
    return source.single(events(spark, sf_dir), ["ts", "event_id"], F.array("value"), hidden=F.col("event_type") == "error")


def _products_sql(name: str, rows: str, step: int) -> str:
    """Running products of 2 x 2 matrices (a b; c d) by doubling, each divided by its largest entry; ``step`` 1 runs forward, -1 backward."""
    parts, now = [f"{name}0 AS MATERIALIZED ({rows})"], f"{name}0"
    for k in range(_DOUBLINGS):
        # The earlier step's matrix stands on the left in both directions.
        left, right = ("y", "x") if step > 0 else ("x", "y")
        cells = {"a": ("a", "a", "b", "c"), "b": ("a", "b", "b", "d"), "c": ("c", "a", "d", "c"), "d": ("c", "b", "d", "d")}
        made = ", ".join(f"CASE WHEN y.t IS NULL THEN x.{v} ELSE {left}.{p} * {right}.{q} + {left}.{r_} * {right}.{s} END AS {v}" for v, (p, q, r_, s) in cells.items())
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT t, a / m AS a, b / m AS b, c / m AS c, d / m AS d FROM (SELECT *, greatest(a, b, c, d) AS m FROM (SELECT x.t, {made} FROM {now} x LEFT JOIN {now} y ON y.t = x.t - {step * 2**k})))")
        now = f"{name}{k + 1}"
    return ", ".join(parts)


_BLOCKED = f"""WITH {_ONE}, l AS MATERIALIZED (SELECT t, exp(l0 - greatest(l0, l1)) AS e0, exp(l1 - greatest(l0, l1)) AS e1 FROM (SELECT t, {_L[0]} AS l0, {_L[1]} AS l1 FROM o)),
    {_products_sql("f", f"SELECT t, CASE WHEN t = 0 THEN {PI[0]} ELSE {float(P[0, 0])} END * e0 AS a, CASE WHEN t = 0 THEN {PI[1]} ELSE {float(P[0, 1])} END * e1 AS b, CASE WHEN t = 0 THEN {PI[0]} ELSE {float(P[1, 0])} END * e0 AS c, CASE WHEN t = 0 THEN {PI[1]} ELSE {float(P[1, 1])} END * e1 AS d FROM l", 1)},
    {_products_sql("b", f"SELECT t, {float(P[0, 0])} * e0 AS a, {float(P[0, 1])} * e1 AS b, {float(P[1, 0])} * e0 AS c, {float(P[1, 1])} * e1 AS d FROM l WHERE t > 0", -1)}"""


@query(f"""{_BLOCKED} SELECT f.t, round(f.a * coalesce(b.a + b.b, 1) / (f.a * coalesce(b.a + b.b, 1) + f.b * coalesce(b.c + b.d, 1)), 6) + 0.0 AS g0,
    round(f.b * coalesce(b.c + b.d, 1) / (f.a * coalesce(b.a + b.b, 1) + f.b * coalesce(b.c + b.d, 1)), 6) + 0.0 AS g1 FROM f{_DOUBLINGS} f LEFT JOIN b{_DOUBLINGS} b ON b.t = f.t + 1""")
def hmm_gamma_blocked(spark, sf_dir):
    """State probabilities of one sequence of all events; blocks of time are inferred side by side."""
    return hmm().infer(one(spark, sf_dir), block=2048).select("t", r(F.col("gamma")[0], "g0"), r(F.col("gamma")[1], "g1"))


@query(f"""{_kalman_sql(False).replace(E, "e AS MATERIALIZED (SELECT 0 AS seq, (row_number() OVER (ORDER BY ts, event_id) - 1)::INT AS t, value AS y, event_type <> 'error' AS visible FROM events)")}
    SELECT t, round(sm, 4) + 0.0 AS mean, round(sv, 4) + 0.0 AS variance, round(cross_next, 4) + 0.0 AS cross_next FROM s""")
def lds_smooth_blocked(spark, sf_dir):
    """Smoothed latents of one sequence of all events; blocks of time are smoothed side by side."""
    rows = lds().infer(one(spark, sf_dir), block=2048)
    return rows.select("t", r(F.col("mean")[0], "mean", 4), r(F.col("cov")[0][0], "variance", 4), F.coalesce(r(F.col("cross_next")[0][0], "c", 4), F.lit(0.0)).alias("cross_next"))


# Many models side by side

#: Sessions, and factors by which the starts scale the means of the states.
_SESSIONS, _SCALES = 20, (0.5, 1.0, 1.5)


def _em_sql(steps: int) -> str:
    """Log-likelihood of two-state Gaussian models (key k) before and after each of ``steps`` EM steps.

    Rows d (k, seq, t, y, visible) and start p0 (k, i0, i1, p00, p01, p10, p11, m0, m1, v0, v1) stand before it.
    """
    parts = []
    for j in range(steps + 1):
        score = [f"CASE WHEN visible THEN -0.5 * ((y - m{i}) * (y - m{i}) / v{i} + ln(v{i}) + {columns.LOG_2PI!r}) ELSE 0 END" for i in range(2)]
        move = [f"(a0 * p0{i} + a1 * p1{i}) * l.e{i}" for i in range(2)]
        parts.append(f"""l{j} AS MATERIALIZED (SELECT *, exp(s0 - top) AS e0, exp(s1 - top) AS e1 FROM (SELECT *, greatest(s0, s1) AS top FROM (SELECT d.k, seq, t, y, visible, {score[0]} AS s0, {score[1]} AS s1, i0, i1, p00, p01, p10, p11 FROM d JOIN p{j} USING (k)))),
    f{j} AS MATERIALIZED (WITH RECURSIVE f AS (SELECT k, seq, t, top, e0, e1, p00, p01, p10, p11, i0 * e0 + i1 * e1 AS c, i0 * e0 / (i0 * e0 + i1 * e1) AS a0, i1 * e1 / (i0 * e0 + i1 * e1) AS a1 FROM l{j} WHERE t = 0
        UNION ALL SELECT k, seq, t, top, e0, e1, p00, p01, p10, p11, w0 + w1, w0 / (w0 + w1), w1 / (w0 + w1) FROM (SELECT l.*, {move[0]} AS w0, {move[1]} AS w1 FROM (SELECT k, seq, t, a0, a1 FROM f) f JOIN l{j} l ON l.k = f.k AND l.seq = f.seq AND l.t = f.t + 1)) SELECT * FROM f),
    o{j} AS (SELECT k, sum(ln(c) + top) AS objective FROM f{j} GROUP BY k)""")
        if j == steps:
            continue
        pair = [f"sum(a{a} * p{a}{b} * ne{b} * nb{b} / nc) AS x{a}{b}" for a in range(2) for b in range(2)]
        parts.append(f"""b{j} AS MATERIALIZED (WITH RECURSIVE b AS (SELECT k, seq, max(t) AS t, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM f{j} GROUP BY k, seq
        UNION ALL SELECT f.k, f.seq, f.t - 1, (p00 * e0 * b0 + p01 * e1 * b1) / c, (p10 * e0 * b0 + p11 * e1 * b1) / c FROM b JOIN f{j} f ON f.k = b.k AND f.seq = b.seq AND f.t = b.t WHERE f.t > 0) SELECT * FROM b),
    g{j} AS MATERIALIZED (SELECT f.*, b0, b1, a0 * b0 / (a0 * b0 + a1 * b1) AS g0, a1 * b1 / (a0 * b0 + a1 * b1) AS g1, lead(e0) OVER w AS ne0, lead(e1) OVER w AS ne1, lead(b0) OVER w AS nb0, lead(b1) OVER w AS nb1, lead(c) OVER w AS nc
        FROM f{j} f JOIN b{j} USING (k, seq, t) WINDOW w AS (PARTITION BY k, seq ORDER BY t)),
    c{j} AS (SELECT k, sum(g0) FILTER (t = 0) AS i0, sum(g1) FILTER (t = 0) AS i1, {", ".join(pair)} FROM g{j} GROUP BY k),
    w{j} AS (SELECT k, sum(g0) AS n0, sum(g1) AS n1, sum(g0 * y) / sum(g0) AS m0, sum(g1 * y) / sum(g1) AS m1, sum(g0 * y * y) / sum(g0) AS q0, sum(g1 * y * y) / sum(g1) AS q1 FROM g{j} JOIN d USING (k, seq, t) WHERE visible GROUP BY k),
    p{j + 1} AS MATERIALIZED (SELECT k, i0 / (i0 + i1) AS i0, i1 / (i0 + i1) AS i1, x00 / (x00 + x01) AS p00, x01 / (x00 + x01) AS p01, x10 / (x10 + x11) AS p10, x11 / (x10 + x11) AS p11, m0, m1, (q0 - m0 * m0) * (1 + 1e-6) AS v0, (q1 - m1 * m1) * (1 + 1e-6) AS v1
        FROM c{j} JOIN w{j} USING (k))""")
    return ", ".join(parts)


def _start_sql(key: str, scale: str = "1") -> str:
    p = [float(v) for v in P.ravel()]
    return f"SELECT {key} AS k, {PI[0]} AS i0, {PI[1]} AS i1, {p[0]} AS p00, {p[1]} AS p01, {p[2]} AS p10, {p[3]} AS p11, {MEAN[0]} * {scale} AS m0, {MEAN[1]} * {scale} AS m1, {VAR[0]} AS v0, {VAR[1]} AS v1"


def _trace_sql(steps: int) -> str:
    return " UNION ALL ".join(f"SELECT k, {j} AS iter, objective FROM o{j}" for j in range(steps + 1))


@query(f"""WITH {E}, x AS (SELECT i::INT AS i, s FROM (VALUES {", ".join(f"({i}, {s})" for i, s in enumerate(_SCALES))}) v(i, s)),
    d AS MATERIALIZED (SELECT (seq % {_SESSIONS}) * {len(_SCALES)} + i AS k, seq, t, y, visible FROM e, x), p0 AS MATERIALIZED ({_start_sql(f"n * {len(_SCALES)} + i", "s")} FROM range({_SESSIONS}) r(n), x), {_em_sql(2)}
    SELECT (k // {len(_SCALES)})::INT AS session, (k % {len(_SCALES)})::INT AS start, iter::INT AS iter, round(objective, 3) + 0.0 AS objective FROM ({_trace_sql(2)})""")
def hmm_many_fits(spark, sf_dir):
    """Models of every session from several starts, two EM steps each: all in the same jobs."""
    e = seqs(spark, sf_dir).withColumn("session", (F.col("seq") % _SESSIONS).cast("int"))
    own = hmm().params["emissions"][0]
    several = [hmm().replace(emissions=[own | {"mean": own["mean"] * s}]) for s in _SCALES]
    found = SessionRestarts.fit(e, {r["session"]: several for r in e.select("session").distinct().collect()}, 2)
    rows = [(s, i, k, float(v)) for s, runs in found.runs.items() for i, fit in enumerate(runs.runs) for k, v in enumerate(fit.trace)]
    return spark.createDataFrame(rows, "session int, start int, iter int, objective double").withColumn("objective", r("objective", "objective", 3))


@query(f"WITH {E}, d AS MATERIALIZED (SELECT 0 AS k, seq, t, y, visible FROM e), p0 AS MATERIALIZED ({_start_sql('0')}), {_em_sql(4)} SELECT iter::INT AS iter, round(objective, 3) + 0.0 AS objective FROM ({_trace_sql(4)})")
def hmm_fit_trace_given(spark, sf_dir):
    """Objective of every EM step from given parameters."""
    out = hmm().fit(seqs(spark, sf_dir), 4).trace_table(spark)
    return out.select("iter", r("objective", "objective", 3))


@query(f"{_HMM}, q AS (SELECT seq % {_SESSIONS} AS s, sum(ln(c) + m) AS v FROM f GROUP BY ALL) SELECT s::INT AS session, round(v, 3) + 0.0 AS log_likelihood FROM q")
def collection_objective(spark, sf_dir):
    """Log-likelihood of every session under a model of its own, in one pass."""
    e = seqs(spark, sf_dir).withColumn("session", (F.col("seq") % _SESSIONS).cast("int"))
    found = Collection({s: hmm() for s in range(_SESSIONS)}).objective(e)
    return found.groupBy("session").agg(F.sum("objective").alias("v")).select("session", r("v", "log_likelihood", 3))


# Observations of one's own

_TYPES = ("click", "error", "purchase", "signup", "view")
_PROBS = [[0.5, 0.1, 0.1, 0.1, 0.2], [0.1, 0.2, 0.2, 0.2, 0.3]]
_CODE = f"list_position([{', '.join(repr(x) for x in _TYPES)}], event_type) - 1"
_TYPED = f"""e AS (SELECT user_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, {_CODE} AS c FROM events)"""


def _typed(spark, sf_dir) -> DataFrame:
    code = F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")) - 1
    return source.from_events(events(spark, sf_dir), F.array(code.cast("double")), hidden=F.lit(False))


def categorical() -> HMM:
    return HMM({"initial_probs": PI, "transition_probs": P, "emissions": [{"probs": np.array(_PROBS)}]}, CategoricalStates(len(_TYPES)))


_TYPED_L = [f"ln([{', '.join(map(repr, row))}][c + 1])" for row in _PROBS]
_TYPED_HMM = f"WITH RECURSIVE {_TYPED}, {_chain_sql(*_TYPED_L)}"


@query(f"{_TYPED_HMM} SELECT seq, round(sum(ln(f.c) + f.m), 4) + 0.0 AS log_likelihood FROM f GROUP BY ALL")
def hmm_categorical_ll(spark, sf_dir):
    """Log-likelihood of each user's event types."""
    return categorical().objective(_typed(spark, sf_dir)).select("seq", r("objective", "log_likelihood", 4))


@query(f"""{_TYPED_HMM}, w AS (SELECT e.c, sum(g0) AS w0, sum(g1) AS w1 FROM g JOIN e USING (seq, t) GROUP BY e.c) SELECT c::INT AS symbol, round(w0 / sum(w0) OVER (), 5) + 0.0 AS p0, round(w1 / sum(w1) OVER (), 5) + 0.0 AS p1 FROM w""")
def hmm_categorical_step(spark, sf_dir):
    """Probabilities of event types in each state after one EM step."""
    probs = categorical().fit(_typed(spark, sf_dir), 1).model.params["emissions"][0]["probs"]
    return spark.createDataFrame([(c, round(float(a), 5), round(float(b), 5)) for c, (a, b) in enumerate(probs.T)], "symbol int, p0 double, p1 double")


#: A scalar system of a yes-or-no observation: initial mean and variance, dynamics, coefficient and bias of the log odds.
_BERNOULLI = {"m0": 0.2, "s0": 2.0, "a": 0.9, "b": 0.0, "q": 0.3, "c": 1.5, "d": -0.4}


def bernoulli() -> LDS:
    p = _BERNOULLI
    return LDS({"initial_mean": [p["m0"]], "initial_covariance": [[p["s0"]]], "dynamics_coefficients": [[p["a"]]], "dynamics_bias": [p["b"]], "dynamics_covariance": [[p["q"]]], "emissions": [{"coefficients": [[p["c"]]], "bias": [p["d"]]}]}, BernoulliLikelihood())


def _large(spark, sf_dir) -> DataFrame:
    return source.from_events(events(spark, sf_dir), F.array((F.col("value") > 50).cast("double")))


@query()
def bernoulli_lds_mode(spark, sf_dir):
    """Laplace posterior of whether values are large."""
    return bernoulli().infer(_large(spark, sf_dir)).select("seq", "t", F.col("mean")[0].alias("x"), F.col("cov")[0][0].alias("variance"))


@query("""WITH RECURSIVE {e}, n AS (SELECT seq, visible, (y > 50)::INT AS z, {m0}::DOUBLE AS x, 0 AS i FROM e WHERE t = 0
    UNION ALL SELECT seq, visible, z, x - ((x - {m0}) / {s0} - CASE WHEN visible THEN {c} * (z - 1 / (1 + exp(-({c} * x + {d})))) ELSE 0 END)
        / (1 / {s0} + CASE WHEN visible THEN {c} * {c} * (1 / (1 + exp(-({c} * x + {d})))) * (1 - 1 / (1 + exp(-({c} * x + {d})))) ELSE 0 END), i + 1 FROM n WHERE i < 30)
    SELECT seq, round(x, 5) + 0.0 AS x FROM n WHERE i = 30""".format(e=E, **_BERNOULLI))
def bernoulli_first_mode(spark, sf_dir):
    """Mode of the first latent given the first observation alone."""
    return bernoulli().infer(structure.select_time(_large(spark, sf_dir), 0, 1)).select("seq", r(F.col("mean")[0], "x", 5))


@query()
def negbin_lds_fit(spark, sf_dir):
    """Objective of a system of overdispersed counts over two steps."""
    e = _counts2(spark, sf_dir)
    return LDS.initialize(e, 2, NegativeBinomialLikelihood(3.0)).fit(e, 2).trace_table(spark)


# Stored posteriors in other coordinates


@query(f"{_kalman_sql(False)} SELECT seq, t, round(0.5 * sm - 10, 4) + 0.0 AS mean, round(0.25 * sv, 4) + 0.0 AS variance, round(0.25 * cross_next, 4) + 0.0 AS cross_next FROM s")
def posterior_align(spark, sf_dir):
    """Smoothed latents in the coordinates x / 2 - 10, from the posterior as it stands."""
    rows = posteriors.aligned(lds().infer(seqs(spark, sf_dir)), Affine(np.array([[0.5]]), np.array([-10.0])))
    return rows.select("seq", "t", r(F.col("mean")[0], "mean", 4), r(F.col("cov")[0][0], "variance", 4), F.coalesce(r(F.col("cross_next")[0][0], "c", 4), F.lit(0.0)).alias("cross_next"))


@query(f"""{_HMM} SELECT x.seq, x.t, round(x.g1, 6) + 0.0 AS g0, CASE WHEN x.g1 >= x.g0 THEN 0 ELSE 1 END::INT AS state, round(x.a1 * {float(P[1, 0])} * y.e0 * y.b0 / y.c, 6) + 0.0 AS x01
    FROM g x JOIN g y ON x.seq = y.seq AND y.t = x.t + 1""")
def posterior_permute(spark, sf_dir):
    """State probabilities and pairs with the two states' labels exchanged."""
    rows = posteriors.permuted_states(hmm().infer(seqs(spark, sf_dir)), [1, 0]).where("xi_next is not null")
    return rows.select("seq", "t", r(F.col("gamma")[0], "g0"), "state", r(F.col("xi_next")[0][1], "x01"))


@query(f"""{_kalman_sql(False)}, n AS (SELECT seq, t, sm, sv, lead(sm) OVER w AS nm, lead(sv) OVER w AS nv FROM s WINDOW w AS (PARTITION BY seq ORDER BY t))
    SELECT seq, (4 * t + j)::BIGINT AS i, round(CASE WHEN j = 0 THEN sm ELSE sm + j / 4 * (nm - sm) END, 4) + 0.0 AS mean, round(CASE WHEN j = 0 THEN sv ELSE sv + j / 4 * (nv - sv) END, 4) + 0.0 AS variance
    FROM n, range(4) v(j) WHERE j = 0 OR nm IS NOT NULL""".replace(", n AS (SELECT seq, t, sm", ", z AS (SELECT seq, t, sm").replace("FROM n, range", "FROM z, range"))
def posterior_upsample(spark, sf_dir):
    """Marginals of smoothed latents at four times the rate."""
    rows = posteriors.upsampled(lds().infer(seqs(spark, sf_dir)), 4)
    return rows.select("seq", "i", r(F.col("mean")[0], "mean", 4), r(F.col("cov")[0][0], "variance", 4))


# Curves and gated walks

_CURVE = CurveModel(2, 0.01, 1e-4, 400.0)


def _solve_sql(size: int) -> str:
    """Elimination of the equations a0_0 .. x a0_n of each seq, unknown by unknown; x0 .. come out."""
    parts, now = [], "n0"
    for k in range(size):
        cells = []
        for i in range(size):
            for j in range(k + 1, size + 1):
                cells.append(f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}")
        parts.append(f"n{k + 1} AS (SELECT seq, {', '.join(cells)} FROM {now})")
        now = f"n{k + 1}"
    return ", ".join(parts)


def _curve_sql() -> str:
    m, basis = _CURVE, HermiteBasis(_CURVE.knots)
    precision, integrals = m._prior()
    precision = precision - m.amplitude * np.outer(integrals, integrals)
    b = ["(1 - 3 * s * s + 2 * s * s * s)", "(s - 2 * s * s + s * s * s)", "(3 * s * s - 2 * s * s * s)", "(s * s * s - s * s)"]
    assert basis.raw(np.array([0.3])).shape == (1, len(b))
    cells = [f"{float(precision[i, j])!r} + sum({b[i]} * {b[j]}) / {m.noise} AS a{i}_{j}" for i in range(4) for j in range(4)]
    cells += [f"sum({b[i]} * y) / {m.noise} AS a{i}_4" for i in range(4)]
    return f"""p AS (SELECT seq, y, visible, t / max(t) OVER (PARTITION BY seq) AS s FROM e), n0 AS (SELECT seq, {', '.join(cells)} FROM p WHERE visible GROUP BY seq), {_solve_sql(4)}"""


@query(f"WITH {E}, {_curve_sql()} SELECT seq, round(a0_4, 4) + 0.0 AS v0, round(a1_4, 3) + 0.0 AS s0, round(a2_4, 4) + 0.0 AS v1, round(a3_4, 3) + 0.0 AS s1 FROM n4")
def curve_fit(spark, sf_dir):
    """Values and slopes at both ends of a cubic fitted to every user's values."""
    rows, c = _CURVE.fit(seqs(spark, sf_dir)), F.col("coefficients")
    return rows.select("seq", r(c[0], "v0", 4), r(c[1], "s0", 3), r(c[2], "v1", 4), r(c[3], "s1", 3))


@query()
def curve_values(spark, sf_dir):
    """Curves of twelve knots with their variance at every step of every user."""
    model, e = CurveModel(12, 0.01, 1e-6, 400.0), seqs(spark, sf_dir)
    return model.values(e, model.fit(e)).select("seq", "t", "mean", "variance")


def gated_walk() -> GatedWalk:
    return GatedWalk({
        "initial_probs": PI, "transition_probs": P, "start_mean": [LDS1["m0"]], "start_covariance": [[LDS1["s0"]]], "innovations": [[[25.0]], [[LDS1["q"]]]],
        "emissions": [{"coefficients": [[1.0]], "bias": [0.0], "covariance": [[LDS1["r"]]]}],
    })


@query()
def gated_walk_bounds(spark, sf_dir):
    """Lower bounds of every user's walk after each round of mean field."""
    return gated_walk().bounds(seqs(spark, sf_dir)).select("seq", "iteration", "bound")


@query("""WITH RECURSIVE {e}, k AS (SELECT seq, t, {u} FROM (SELECT seq, t, y, visible, {m0}::DOUBLE AS pm, {s0}::DOUBLE AS pv FROM e WHERE t = 0)
    UNION ALL SELECT seq, t, {u} FROM (SELECT e.seq, e.t, e.y, e.visible, m AS pm, v + {q} AS pv FROM k JOIN e ON e.seq = k.seq AND e.t = k.t + 1))
    SELECT seq, round(sum(ll), 3) + 0.0 AS bound FROM k GROUP BY seq""".format(e=E, m0=LDS1["m0"], s0=LDS1["s0"], q=LDS1["q"], u="""CASE WHEN visible THEN pm + pv / (pv + {r}) * (y - pm) ELSE pm END AS m, CASE WHEN visible THEN pv * {r} / (pv + {r}) ELSE pv END AS v,
        CASE WHEN visible THEN -0.5 * ((y - pm) * (y - pm) / (pv + {r}) + ln(pv + {r}) + {c!r}) ELSE 0 END AS ll""".format(r=LDS1["r"], c=columns.LOG_2PI)))
def gated_walk_open(spark, sf_dir):
    """With both gates as wide as each other the bound is the log-likelihood of a plain walk."""
    one = gated_walk().replace(dynamics_covariances=np.full((2, 1, 1), LDS1["q"]))
    return one.objective(seqs(spark, sf_dir)).select("seq", r("objective", "bound", 3))


# All coordinates, given tables


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings)
    SELECT label, c::INT AS coordinate, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 6) + 0.0 AS variance FROM x GROUP BY ALL""")
def class_moments_all(spark, sf_dir):
    """Mean and variance of every coordinate of the embeddings of each label."""
    sums = moments.vector_sums(table(spark, sf_dir, "embeddings"), "embedding", "label")
    rows = []
    for label, (n, first, second) in sums.items():
        mean = first / n
        rows += [(label, c, int(n), round(float(m), 6) + 0.0, round(float(q / n - m * m), 6) + 0.0) for c, (m, q) in enumerate(zip(mean, np.diag(second), strict=True))]
    return spark.createDataFrame(rows, "label int, coordinate int, n long, mean double, variance double")


@query("""WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS c FROM embeddings), m AS (SELECT c, var_pop(v) AS v FROM x GROUP BY c) SELECT round(sum(v), 5) + 0.0 AS total FROM m""")
def pca_all_total(spark, sf_dir):
    """Sum of the variances of all principal components of the embeddings."""
    n, first, second = moments.vector_sums(table(spark, sf_dir, "embeddings").withColumn("k", F.lit(0)), "embedding", "k")[0]
    mean = first / n
    _, values = cluster.leading(second / n - np.outer(mean, mean), len(mean))
    return spark.createDataFrame([(round(float(values.sum()), 5),)], "total double")


@query(f"WITH {E} SELECT session::INT AS session, seq, count(*) AS n_steps, count(*) FILTER (u IS NOT NULL) AS n_driven FROM e GROUP BY ALL")
def sample_driven(spark, sf_dir):
    """Sequences drawn from a system that the inputs of the events drive: as long as these, every step observed."""
    drawn = lds(True).sample(spark, seed=3, inputs=seqs(spark, sf_dir).select("session", "seq", "t", "u"))
    return drawn.where("visible and not isnan(y[0])").groupBy("session", "seq").agg(F.count(F.lit(1)).alias("n_steps"), F.sum((F.size("u") == 1).cast("long")).alias("n_driven"))


@query(f"""{_kalman_sql(False)}, z AS (SELECT sm, u FROM s JOIN e USING (seq, t)), w AS (SELECT covar_pop(sm, u) / var_pop(sm) AS a, avg(sm) AS m, avg(u) AS n FROM z)
    SELECT round(a, 5) + 0.0 AS coefficient, round(n - a * m, 4) + 0.0 AS bias FROM w""")
def latent_map(spark, sf_dir):
    """The least-squares map of smoothed latents onto known values, here the inputs."""
    e = seqs(spark, sf_dir)
    f = truth.latent_map(lds().infer(e), e.select("session", "seq", "t", F.col("u").alias("x")))
    return spark.createDataFrame([(round(float(f.coefficients[0, 0]), 5) + 0.0, round(float(f.bias[0]), 4) + 0.0)], "coefficient double, bias double")


@query(f"""{_HMM}, w AS (SELECT sum(g0) FILTER (y <= 50) AS low0, sum(g1) FILTER (y <= 50) AS low1, sum(g0) FILTER (y > 50) AS high0, sum(g1) FILTER (y > 50) AS high1 FROM g JOIN e USING (seq, t))
    SELECT k::INT AS true_state, CASE WHEN low0 + high1 >= low1 + high0 THEN k ELSE 1 - k END::INT AS state FROM w, range(2) r(k)""")
def truth_order(spark, sf_dir):
    """The state that meets each known label most: values up to 50, and above."""
    e = seqs(spark, sf_dir)
    order = truth.state_order(hmm().infer(e), e.select("session", "seq", "t", (F.col("y")[0] > 50).cast("int").alias("z")))
    return spark.createDataFrame(list(enumerate(map(int, order))), "true_state int, state int")


# A switching system with two states in SQL


def _mean_field_sql(rounds: int) -> str:
    """Mean field of a walk with two gates on the first two steps of every sequence: Gaussian factors of two latents, gate weights and bounds.

    Gates start even; each round solves the 2 x 2 Gaussian chain, then the two-step chain of gates.
    """
    (q0, q1), ((p00, p01), (p10, p11)) = gated_walk().params["dynamics_covariances"][:, 0, 0].tolist(), P.tolist()
    m0, s0, r_, l2 = LDS1["m0"], LDS1["s0"], LDS1["r"], columns.LOG_2PI
    parts = [
        "y AS (SELECT a.seq, a.y AS ya, a.visible::INT AS wa, b.y AS yb, b.visible::INT AS wb FROM e a JOIN e b ON b.seq = a.seq AND a.t = 0 AND b.t = 1)",
        "r0 AS (SELECT *, 0.5::DOUBLE AS z1 FROM y)",  # weight of the wide gate at the second step
    ]
    for k in range(rounds):
        precision = f"((1 - z1) / {q0} + z1 / {q1})"
        parts.append(f"""a{k} AS (SELECT seq, ya, wa, yb, wb, z1, 1 / {s0} + w + wa / {r_} AS j0, w + wb / {r_} AS j1, -w AS l, {m0} / {s0} + wa * ya / {r_} AS h0, wb * yb / {r_} AS h1 FROM (SELECT *, {precision} AS w FROM r{k})),
        b{k} AS (SELECT *, j0 * j1 - l * l AS det, (h0 * j1 - l * h1) / (j0 * j1 - l * l) AS x0, (j0 * h1 - l * h0) / (j0 * j1 - l * l) AS x1, j1 / (j0 * j1 - l * l) AS v0, j0 / (j0 * j1 - l * l) AS v1, -l / (j0 * j1 - l * l) AS c FROM a{k}),
        d{k} AS (SELECT *, (x1 - x0) * (x1 - x0) + v0 + v1 - 2 * c AS step, -0.5 * (((x0 - {m0}) * (x0 - {m0}) + v0) / {s0} + ln({s0}) + {l2!r}) AS start FROM b{k}),
        f{k} AS (SELECT *, -0.5 * (step / {q0} + ln({q0}) + {l2!r}) AS e0, -0.5 * (step / {q1} + ln({q1}) + {l2!r}) AS e1 FROM d{k}),
        h{k} AS (SELECT *, {PI[0]} * {p00} * exp(e0) + {PI[1]} * {p10} * exp(e0) AS n0, {PI[0]} * {p01} * exp(e1) + {PI[1]} * {p11} * exp(e1) AS n1 FROM f{k}),
        r{k + 1} AS (SELECT seq, ya, wa, yb, wb, n1 / (n0 + n1) AS z1, start + ln(n0 + n1) + 0.5 * (2 * (1 + {l2!r}) - ln(det))
            - 0.5 * wa * (((ya - x0) * (ya - x0) + v0) / {r_} + ln({r_}) + {l2!r}) - 0.5 * wb * (((yb - x1) * (yb - x1) + v1) / {r_} + ln({r_}) + {l2!r}) AS bound FROM h{k})""")
    return ", ".join(parts)


@query(f"WITH {E}, {_mean_field_sql(8)} SELECT seq, round(z1, 6) + 0.0 AS wide, round(bound, 4) + 0.0 AS bound FROM r8")
def gated_walk_two_steps(spark, sf_dir):
    """Gate of the second step and bound of every user's first two steps, two gates, eight rounds of mean field."""
    e, m = structure.select_time(seqs(spark, sf_dir), 0, 2), gated_walk()
    gates = m.infer(e).where("t = 1").select("seq", r(F.col("gamma")[1], "wide"))
    bounds = m.bounds(e).where(F.col("iteration") == m.inference_iters - 1).select("seq", r("bound", "bound", 4))
    return gates.join(bounds, "seq")


# Streams


@query(f"""WITH RECURSIVE {E.replace("AS t, value AS y", "AS t, ts, value AS y")}, {_chain_sql(*[_gauss_sql("y", m, v) for m, v in zip(MEAN, VAR, strict=True)])}
    SELECT seq, ts, CASE WHEN a0 >= a1 THEN 0 ELSE 1 END::INT AS state, round(greatest(a0, a1), 6) + 0.0 AS probability,
        round(sum(ln(c) + m) OVER (PARTITION BY seq ORDER BY t), 4) + 0.0 AS log_likelihood FROM f JOIN (SELECT seq, t, ts FROM e) USING (seq, t)""")
def hmm_filter_stream(spark, sf_dir):
    """The likeliest state of every event given those before it, from a stream of the events."""
    at = f"{sf_dir}/events.parquet"
    # A pattern, as a stream takes folders or patterns and the table may be one file.
    stream = spark.readStream.schema(spark.read.parquet(at).schema).parquet(f"{at[:-1]}[{at[-1]}]").selectExpr("user_id seq", "ts", "value")
    rows = online.drained(online.filter_stream(stream, np.array(PI), P, np.array(MEAN), np.array(VAR)))
    return rows.select("seq", "ts", "state", r("probability", "probability"), r("log_likelihood", "log_likelihood", 4))


# Fits from given parameters, step by step in SQL


def _ar_em_sql(steps: int) -> str:
    """As :func:`_em_sql` for regressions on the last observation: rows d (k, seq, t, x, y, visible), start p0 with a0, a1, b0, b1 for the means."""
    sql = _em_sql(steps)
    for i in range(2):
        sql = sql.replace(f"(y - m{i}) * (y - m{i})", f"(y - a{i} * x - b{i}) * (y - a{i} * x - b{i})")
    sql = sql.replace("SELECT d.k, seq, t, y, visible,", "SELECT d.k, seq, t, x, y, visible,").replace("SELECT l.*, ", "SELECT l.k, l.seq, l.t, l.top, l.e0, l.e1, l.p00, l.p01, l.p10, l.p11, ")
    for j in range(steps):
        sums = ", ".join(f"sum(g{i} * {v}) / sum(g{i}) AS {n}{i}" for i in range(2) for n, v in (("mx", "x"), ("my", "y"), ("xx", "x * x"), ("xy", "x * y"), ("yy", "y * y")))
        inner = f"SELECT k, {sums} FROM g{j} JOIN d USING (k, seq, t) WHERE visible GROUP BY k"
        inner = f"SELECT k, mx0, mx1, my0, my1, {', '.join(f'xx{i} - mx{i} * mx{i} AS xx{i}, xy{i} - mx{i} * my{i} AS xy{i}, yy{i} - my{i} * my{i} AS yy{i}' for i in range(2))} FROM ({inner})"
        inner = f"SELECT *, {', '.join(f'xy{i} / (xx{i} * (1 + 1e-6)) AS a{i}' for i in range(2))} FROM ({inner})"
        fitted = ", ".join(f"a{i}, my{i} - a{i} * mx{i} AS b{i}, yy{i} - 2 * a{i} * xy{i} + a{i} * a{i} * xx{i} + 1e-6 * yy{i} AS v{i}" for i in range(2))
        begin, end = sql.index(f"w{j} AS (SELECT k, sum(g0)"), sql.index(f"p{j + 1} AS MATERIALIZED")
        sql = sql[:begin] + f"w{j} AS (SELECT k, {fitted} FROM ({inner})), " + sql[end:]
        sql = sql.replace("m0, m1, (q0 - m0 * m0) * (1 + 1e-6) AS v0, (q1 - m1 * m1) * (1 + 1e-6) AS v1", "a0, a1, b0, b1, v0, v1", 1)
    return sql


_AR_START = _start_sql("0").replace(f"{MEAN[0]} * 1 AS m0, {MEAN[1]} * 1 AS m1, {VAR[0]} AS v0, {VAR[1]} AS v1", ", ".join(f"{AR[n][i]} AS {c}{i}" for n, c in (("coefficients", "a"), ("bias", "b"), ("variance", "v")) for i in range(2)))


@query(f"WITH {E}, {_AR_ROWS}, d AS MATERIALIZED (SELECT 0 AS k, seq, t, x, y, visible FROM a), p0 AS MATERIALIZED ({_AR_START}), {_ar_em_sql(3)} SELECT iter::INT AS iter, round(objective, 3) + 0.0 AS objective FROM ({_trace_sql(3)})")
def arhmm_fit_trace_given(spark, sf_dir):
    """Objective of every EM step of an AR-HMM from given parameters."""
    return arhmm().fit(seqs(spark, sf_dir), 3).trace_table(spark).select("iter", r("objective", "objective", 3))


def _lds_em_sql(steps: int) -> str:
    """Log-likelihood of a scalar LDS before and after each of ``steps`` EM steps."""
    p = LDS1
    parts = ["ev AS (SELECT seq, t, y, visible FROM e)", f"p0 AS MATERIALIZED (SELECT {p['m0']}::DOUBLE AS m0, {p['s0']}::DOUBLE AS s0, {p['a']}::DOUBLE AS a, {p['b']}::DOUBLE AS b, {p['q']}::DOUBLE AS q, {p['c']}::DOUBLE AS c, {p['d']}::DOUBLE AS d, {p['r']}::DOUBLE AS r)"]
    update = f"""CASE WHEN visible THEN pm + pv * c / (c * c * pv + r) * (y - c * pm - d) ELSE pm END AS m, CASE WHEN visible THEN pv * r / (c * c * pv + r) ELSE pv END AS v,
        CASE WHEN visible THEN -0.5 * ((y - c * pm - d) * (y - c * pm - d) / (c * c * pv + r) + ln(c * c * pv + r) + {columns.LOG_2PI!r}) ELSE 0 END AS ll, a, b, q, c, d, r"""
    for j in range(steps + 1):
        parts.append(f"""k{j} AS MATERIALIZED (WITH RECURSIVE k AS (SELECT seq, t, pm, pv, {update} FROM (SELECT seq, t, y, visible, m0 AS pm, s0 AS pv, a, b, q, c, d, r FROM ev, p{j} WHERE t = 0)
        UNION ALL SELECT seq, t, pm, pv, {update} FROM (SELECT ev.seq, ev.t, ev.y, ev.visible, a * m + b AS pm, a * a * v + q AS pv, a, b, q, c, d, r FROM k JOIN ev ON ev.seq = k.seq AND ev.t = k.t + 1)) SELECT * FROM k),
    o{j} AS (SELECT 0 AS k, sum(ll) AS objective FROM k{j})""")
        if j == steps:
            continue
        parts.append(f"""s{j} AS MATERIALIZED (WITH RECURSIVE s AS (SELECT k.seq, k.t, m AS sm, v AS sv, 0.0::DOUBLE AS cross_next FROM k{j} k JOIN (SELECT seq, max(t) AS last FROM ev GROUP BY ALL) n ON k.seq = n.seq AND k.t = last
        UNION ALL SELECT seq, t, m + g * (sm - npm), v + g * g * (sv - npv), g * sv FROM (
            SELECT k.seq, k.t, k.m, k.v, s.sm, s.sv, x.pm AS npm, x.pv AS npv, k.v * k.a / x.pv AS g FROM s JOIN k{j} k ON k.seq = s.seq AND k.t = s.t - 1 JOIN k{j} x ON x.seq = s.seq AND x.t = s.t)) SELECT * FROM s),
    z{j} AS (SELECT avg(x.sm) AS mx, avg(y.sm) AS my, avg(x.sv + x.sm * x.sm) - avg(x.sm) * avg(x.sm) AS xx, avg(y.sv + y.sm * y.sm) - avg(y.sm) * avg(y.sm) AS yy, avg(x.cross_next + x.sm * y.sm) - avg(x.sm) * avg(y.sm) AS xy
        FROM s{j} x JOIN s{j} y ON x.seq = y.seq AND y.t = x.t + 1),
    v{j} AS (SELECT avg(sm) AS mx, avg(y) AS my, avg(sv + sm * sm) - avg(sm) * avg(sm) AS xx, avg(y * y) - avg(y) * avg(y) AS yy, avg(sm * y) - avg(sm) * avg(y) AS xy FROM s{j} JOIN ev USING (seq, t) WHERE visible),
    i{j} AS (SELECT avg(sm) FILTER (t = 0) AS m0, avg(sv + sm * sm) FILTER (t = 0) - avg(sm) FILTER (t = 0) * avg(sm) FILTER (t = 0) AS s0, avg(sv + sm * sm) - avg(sm) * avg(sm) AS spread FROM s{j}),
    p{j + 1} AS MATERIALIZED (SELECT m0, s0 + 1e-6 * spread AS s0, za AS a, z.my - za * z.mx AS b, z.yy - 2 * za * z.xy + za * za * z.xx + 1e-6 * z.yy AS q, vc AS c, v.my - vc * v.mx AS d, v.yy - 2 * vc * v.xy + vc * vc * v.xx + 1e-6 * v.yy AS r
        FROM (SELECT *, xy / (xx * (1 + 1e-6)) AS za FROM z{j}) z, (SELECT *, xy / (xx * (1 + 1e-6)) AS vc FROM v{j}) v, i{j})""")
    return ", ".join(parts)


@query(f"WITH {E}, {_lds_em_sql(3)} SELECT iter::INT AS iter, round(objective, 3) + 0.0 AS objective FROM ({_trace_sql(3)})")
def lds_fit_trace_given(spark, sf_dir):
    """Objective of every EM step of a scalar LDS from given parameters."""
    return lds().fit(seqs(spark, sf_dir), 3).trace_table(spark).select("iter", r("objective", "objective", 3))


@query("""WITH RECURSIVE {e}, n AS (SELECT seq, visible, c AS y, 0.5::DOUBLE AS x, 0 AS i FROM e WHERE t = 0
    UNION ALL SELECT seq, visible, y, x - ((x - 0.5) / 0.8 - CASE WHEN visible THEN 0.7 * (y - exp(0.7 * x + 0.2)) ELSE 0 END) / (1 / 0.8 + CASE WHEN visible THEN 0.49 * exp(0.7 * x + 0.2) ELSE 0 END), i + 1 FROM n WHERE i < 60)
    SELECT seq, round(x, 5) + 0.0 AS x, round(1 / (1 / 0.8 + CASE WHEN visible THEN 0.49 * exp(0.7 * x + 0.2) ELSE 0 END), 6) + 0.0 AS variance FROM n WHERE i = 60""".format(e=E))
def poisson_first_mode(spark, sf_dir):
    """Mode and Laplace variance of the first latent given the first count alone."""
    m = LDS({"initial_mean": [0.5], "initial_covariance": [[0.8]], "dynamics_coefficients": [[0.9]], "dynamics_bias": [0.0], "dynamics_covariance": [[0.3]], "emissions": [{"coefficients": [[0.7]], "bias": [0.2]}]}, POISSON)
    rows = m.infer(structure.select_time(seqs(spark, sf_dir, counts=True), 0, 1))
    return rows.select("seq", r(F.col("mean")[0], "x", 5), r(F.col("cov")[0][0], "variance"))
