"""Online filtering of event streams: the forward recursion of an HMM with its state kept for each sequence.

Rows of a micro-batch are taken in order of time within their sequence. A row that is not later than the last one taken
for its sequence is late and is dropped and counted (``late``); with ``idle_ms``, state of idle sequences ends after that time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "seq long, ts timestamp, state int, probability double, log_likelihood double, late long"
STATE = "filtered array<double>, log_likelihood double, last_ts double, late long"


def step(filtered: np.ndarray | None, local: np.ndarray, initial: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered probabilities after one observation's log factors, and the log-likelihood it adds."""
    prior = initial if filtered is None else filtered @ transition
    top = local.max()
    joint = prior * np.exp(local - top)
    total = max(joint.sum(), np.finfo(float).tiny)
    return joint / total, float(np.log(total) + top)


def filter_stream(events: DataFrame, initial: np.ndarray, transition: np.ndarray, mean: np.ndarray, variance: np.ndarray, idle_ms: int | None = None) -> DataFrame:
    """Streaming (seq, ts, value) to OUTPUT rows; Gaussian observations of one dimension."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        filtered, total, last, late = state.get if state.exists else (None, 0.0, float("-inf"), 0)
        filtered = None if filtered is None else np.asarray(filtered)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            now = ts.timestamp()
            if now <= last:
                late += 1
                continue
            local = -0.5 * ((value - mean) ** 2 / variance + np.log(2 * np.pi * variance))
            filtered, gain = step(filtered, local, initial, transition)
            total, last = total + gain, now
            out.append((key[0], ts, int(filtered.argmax()), float(filtered.max()), total, late))
        if filtered is not None:
            state.update((filtered.tolist(), total, last, late))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("seq").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one where that is unset and all is one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that the executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that its source has now: written batch by batch to a shared folder, and read back."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
