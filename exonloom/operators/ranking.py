"""Exact ranks, smallest-k and running totals without sorting a whole group in one task.

A key is first cut to a bucket; bucket totals - a table of constant size per group - give every bucket its offset, and rows are
ordered only within their bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of hash-keyed ranks: three hexadecimal digits of an md5.
HEX = 3
#: Buckets of ranks by a number, and the relative accuracy of the quantiles that are their limits.
BINS = 256
ACCURACY = 10_000


def hash_key(c: Column, seed: int = 42) -> Column:
    """Hash order that Spark and other engines share: md5 of 'seed:value'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c))


def hash_rank(df: DataFrame, by: list[str], key: str, out: str = "rank") -> DataFrame:
    """1-based rank of each row in its `by` group in the order of the hash `key` (an md5 column). Ties get consecutive ranks in no
    given order. Null keys come first."""
    b = df.withColumn("_b", F.substring(key, 1, HEX))
    sizes = b.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = sizes.select(*by, F.col("_b"), (F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col("_b").asc_nulls_first())) - F.col("_n")).alias("_before"))
    r = b.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key)))
    on = None
    right = before.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_b").alias("_bb"), "_before")
    for i, c in enumerate([*by, "_b"]):
        e = F.col(c).eqNullSafe(F.col(f"_g{i}" if i < len(by) else "_bb"))
        on = e if on is None else on & e
    return r.join(F.broadcast(right), on).withColumn(out, (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_before", "_bb", *[f"_g{i}" for i in range(len(by))])


def running_totals(df: DataFrame, by: str, key: str, values: list[str], descending: bool = True) -> DataFrame:
    """Running totals of `values` over the order of the number `key` within `by`, as columns cum_<value>; df has one row per (by, key).

    Keys are cut into bins at the group's approximate quantiles (infinities are keys like others), so that outliers and crowded ranges
    don't fill one bin; the totals are exact wherever the limits lie. Limits (one row a group) and the bins' totals (BINS rows a group)
    are broadcast - a group is a model, not a record - and only a bin's rows are ordered."""
    at = [i / BINS for i in range(1, BINS)]
    limits = df.groupBy(by).agg(F.array_sort(F.array_distinct(F.percentile_approx(key, at, ACCURACY))).alias("_limits"))
    below = F.size(F.filter("_limits", lambda x: x < F.col(key)))
    b = df.join(F.broadcast(limits), by).withColumn("_bin", below).drop("_limits")
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = b.groupBy(by, "_bin").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w = Window.partitionBy(by).orderBy(order("_bin"))
    offsets = totals.select(by, "_bin", *[(F.sum(f"_t_{v}").over(w) - F.col(f"_t_{v}")).alias(f"_o_{v}") for v in values])
    inner = Window.partitionBy(by, "_bin").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({f"_c_{v}": F.sum(v).over(inner) for v in values}).join(F.broadcast(offsets), [by, "_bin"])
    return b.withColumns({f"cum_{v}": F.col(f"_o_{v}") + F.col(f"_c_{v}") for v in values}).drop("_bin", *[f"_o_{v}" for v in values], *[f"_c_{v}" for v in values])
