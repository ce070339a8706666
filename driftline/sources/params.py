"""Parameter storage: one JSON document for a model, in a one-row Parquet table with its type and format version."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

VERSION = 1


def encode(value):
    """Arrays become tagged lists; mappings, tuples, None, strings, booleans and numbers stay; others raise TypeError."""
    if isinstance(value, np.ndarray):
        return {"kind": "array", "dtype": str(value.dtype), "shape": list(value.shape), "data": value.ravel().tolist()}
    if isinstance(value, dict):
        return {"kind": "mapping", "items": {k: encode(v) for k, v in value.items()}}
    if isinstance(value, tuple | list):
        return {"kind": "tuple", "items": [encode(v) for v in value]}
    if value is None or isinstance(value, str | bool | int | float):
        return {"kind": "scalar", "value": value}
    raise TypeError(type(value).__name__)


def decode(node):
    kind = node["kind"]
    if kind == "array":
        return np.array(node["data"], dtype=node["dtype"]).reshape(node["shape"])
    if kind == "mapping":
        return {k: decode(v) for k, v in node["items"].items()}
    if kind == "tuple":
        return tuple(decode(v) for v in node["items"])
    return node["value"]


def save_params(spark: SparkSession, path: str, model_type: str, params: dict, overwrite: bool = False) -> None:
    row = [(model_type, VERSION, json.dumps(encode(params)))]
    spark.createDataFrame(row, "model_type string, format_version int, params string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_params(spark: SparkSession, path: str) -> tuple[str, dict]:
    row = spark.read.parquet(path).first()
    if row["format_version"] != VERSION:
        raise ValueError(f"format {row['format_version']}")
    return row["model_type"], decode(json.loads(row["params"]))


def save_inferred(spark: SparkSession, path: str, model, posterior, sequences, overwrite: bool = False) -> None:
    """A model, the posterior rows of its inference and the sequences they belong to, as three tables in one folder."""
    mode = "overwrite" if overwrite else "errorifexists"
    posterior.write.mode(mode).parquet(f"{path}/posterior")
    sequences.write.mode(mode).parquet(f"{path}/sequences")
    model.save(spark, f"{path}/model", overwrite)


def load_inferred(spark: SparkSession, path: str):
    """(model, posterior, sequences) as stored; nothing is inferred again."""
    from driftline.plans.models import Model

    return Model.load(spark, f"{path}/model"), spark.read.parquet(f"{path}/posterior"), spark.read.parquet(f"{path}/sequences")
