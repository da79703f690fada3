"""Session helpers: sessions for tests and bench, the shared folder, written tables, skew-safe joins."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a single task may hold in a join; keys with more are hot.
KEY_ROWS = 200_000
#: Least and most ways in which the rows of a hot key are split.
SALTS = 8, 4096
#: Rows of a list that may be broadcast; its size is checked.
BROADCAST_ROWS = 100_000
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", app: str = "exonloom", **conf: str) -> SparkSession:
    """A local session for tests and bench; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Only where it is unset and the master is local (tests) an
    own temporary folder is made and set; on a cluster its absence is a RuntimeError, since executors don't share local disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-exonloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working directory leads them to it: once per
    application, a zip of its sources goes to the shared folder and is added to the session's Python files."""
    root = Path(__file__).resolve().parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(k and Path(k).resolve() == root.parent for k in known):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/exonloom/{root.name}-{uuid.uuid4().hex}.zip")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(fs.makeQualified(target).toString())
    _shipped.add(app)


@contextmanager
def shuffle_for(spark: SparkSession, rows: float, per_task: int = 400_000):
    """Within it, shuffles begin with so many partitions that each holds about `per_task` rows and sorts in memory; adaptive execution
    still joins small partitions and splits skewed ones. The session's setting comes back afterwards."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    old = spark.conf.get(key, None)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(key, str(max(least, min(100_000, int(rows / per_task) + 1))))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for intermediate data; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/exonloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def write_table(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Cut the lineage of `df` with a parquet table in the shared folder, or at a `path` that the caller keeps, and return a DataFrame
    that reads it.

    Unlike an in-memory checkpoint it survives the loss of any executor, and unlike `checkpoint()` the plan runs once."""
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the cluster's own clean-up of the folder applies
        pass


def join_unique(rows: DataFrame, lookup: DataFrame, key: str, weight: str | None = None, how: str = "inner", most: int | None = None) -> DataFrame:
    """Join of many `rows` to a `lookup` that is unique in `key`, safe when one key holds a large part of the rows; inner or left.

    `weight` (a column of lookup, dropped) says how many rows carry the key; without it the rows, a written table, are counted per key.
    A key with more than KEY_ROWS rows is split so many ways that each holds about KEY_ROWS (SALTS says the least and the most). How
    many such keys there are is counted first: where there are none, as mostly, the join is a plain one (with `most`, a known bound on
    the rows, nothing is counted below KEY_ROWS), and their list is broadcast only up to BROADCAST_ROWS, else joined. Salts come from
    the rows' own values, so a task that runs again after a loss makes the same ones. Null keys never match."""
    slim = lookup.drop(weight) if weight else lookup
    if most is not None and most <= KEY_ROWS:
        return rows.join(slim, key, how)
    counted = lookup.select(key, F.col(weight).alias("_n")) if weight else rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counted.where(F.col(key).isNotNull() & (F.col("_n") > KEY_ROWS)).select(key, F.least(F.lit(SALTS[1]), F.greatest(F.lit(SALTS[0]), F.ceil(F.col("_n") / KEY_ROWS))).cast("int").alias("_ways"))
    n = hot.count()
    if not n:
        return rows.join(slim, key, how)
    small = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    ways = F.coalesce("_ways", F.lit(1))
    salted = rows.join(small, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), ways).cast("int")).drop("_ways")
    spread = slim.join(small, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
