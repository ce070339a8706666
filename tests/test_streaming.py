"""The online filter gives what the forward recursion gives on the whole sequence."""

import datetime

import numpy as np

from driftline.operators import chains
from driftline.streaming import online

START = datetime.datetime(2024, 1, 1)
PI, P = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]])
MEAN, VAR = np.array([0.0, 3.0]), np.array([1.0, 1.0])


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = {1: rng.normal(size=6), 2: rng.normal(size=4) + 2}
    rows = [(s, START + datetime.timedelta(seconds=i), float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    schema = "seq long, ts timestamp, value double"
    spark.createDataFrame([r for r in rows if r[1] < START + datetime.timedelta(seconds=3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    late = (1, START, 9.0)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = online.filter_stream(stream, PI, P, MEAN, VAR).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([r for r in rows if r[1] >= START + datetime.timedelta(seconds=3)] + [late], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        got = spark.table("filtered").orderBy("seq", "ts").collect()
    finally:
        query.stop()
    assert len(got) == len(rows)
    for s, vs in values.items():
        local = -0.5 * ((vs[:, None] - MEAN) ** 2 / VAR + np.log(2 * np.pi * VAR))
        want = chains.discrete_chain(PI, P, local[None], np.array([len(vs)]))
        own = [r for r in got if r["seq"] == s]
        np.testing.assert_allclose([r["probability"] for r in own], want.filtered[0].max(-1))
        np.testing.assert_allclose(own[-1]["log_likelihood"], want.log_normalizer[0])
    assert max(r["late"] for r in got if r["seq"] == 1) == 1
