"""Registered engine queries against their DuckDB oracles on the smallest data."""

import math
import os

import pytest

from driftline.plans import catalog

DATA = os.environ.get("DRIFTLINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("events", "lineitem", "embeddings")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-4) or (math.isnan(a) and math.isnan(b))
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    ours = catalog.QUERIES[name](spark, DATA)
    names = sorted(ours.columns)
    theirs = duck.sql(catalog.ORACLES[name])
    assert sorted(theirs.columns) == names
    mine = sorted(tuple(r[c] for c in names) for r in ours.collect())
    other = sorted(theirs.select(*names).fetchall())
    assert len(mine) == len(other)
    assert all(same(a, b) for x, y in zip(mine, other, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", ["occupancy_grid", "slds_infer", "poisson_lds_mode", "lda_directions", "chain_entropy"])
def test_rows(spark, duck, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_lda_directions_use_all_coordinates(spark, tmp_path):
    """Labels that only the last coordinates tell apart, against sums by NumPy."""
    import numpy as np

    from driftline.operators import align

    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 20))
    x[:, 18] += 4 * labels
    x[:, 19] += 4 * (labels == 1)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = np.zeros((20, 2))
    for r in catalog.QUERIES["lda_directions"](spark, str(tmp_path)).collect():
        got[r["dimension"], r["direction"]] = r["weight"]
    own = [x[labels == k] for k in range(3)]
    n, means, second = np.array([float(len(v)) for v in own]), np.array([v.mean(0) for v in own]), np.array([v.T @ v for v in own])
    np.testing.assert_allclose(got, align.lda_directions(n, means, second)[0], atol=1e-8)
    assert (np.abs(got).argmax(0) >= 18).all()
