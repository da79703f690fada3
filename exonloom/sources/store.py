"""Saving and loading fitted models: their tables as Parquet, their parameters as one row of JSON. Never pickled."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save_model(spark: SparkSession, path: str, kind: str, params: dict, tables: dict[str, DataFrame]) -> None:
    """Write a model to a folder; an existing model there is replaced."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(kind, json.dumps(params), sorted(tables))], "kind string, params string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_model(spark: SparkSession, path: str, kind: str | None = None) -> tuple[str, dict, dict[str, DataFrame]]:
    """(kind, params, tables). FileNotFoundError if there is no model, TypeError if it is of another kind."""
    try:
        r = spark.read.schema("kind string, params string, tables array<string>").json(f"{path}/manifest").first()
    except Exception as e:
        raise FileNotFoundError(path) from e
    if r is None:
        raise FileNotFoundError(path)
    if kind is not None and r.kind != kind:
        raise TypeError(f"{path} holds a {r.kind} model, not {kind}")
    return r.kind, json.loads(r.params), {t: spark.read.parquet(f"{path}/{t}") for t in r.tables}


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
