import zipfile

import pytest

import __spark_entry__ as e
from exonloom import runtime
from exonloom.runtime import join_unique, ship_package
from pyspark import SparkFiles
from pyspark.sql import functions as F


def test_entry(spark, sf):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("limit,broadcast", [(10, 100), (10, 0), (200_000, 100)])
def test_join_unique_with_a_hot_key(spark, monkeypatch, limit, broadcast):
    monkeypatch.setattr(runtime, "KEY_ROWS", limit)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", broadcast)
    r = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    u = r.groupBy("k").agg(F.count("*").alias("n"), F.lit("x").alias("v"))
    got = join_unique(r, u, "k", "n")
    assert got.count() == 3000 and set(got.columns) == {"k", "id", "v"} and got.select("id").distinct().count() == 3000
    assert join_unique(r, u.limit(0), "k", "n").count() == 0


def test_package_reaches_workers_from_any_folder(spark, monkeypatch, tmp_path):
    before = set(spark.sparkContext._python_includes)
    ship_package(spark)  # the working directory leads to the package: nothing to do
    assert set(spark.sparkContext._python_includes) == before
    monkeypatch.delenv("PYTHONPATH", raising=False)
    monkeypatch.chdir(tmp_path)
    for _ in range(2):
        ship_package(spark)
    new = set(spark.sparkContext._python_includes) - before
    assert len(new) == 1
    assert "exonloom/runtime.py" in zipfile.ZipFile(SparkFiles.get(new.pop())).namelist()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session)
