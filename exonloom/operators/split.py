"""Leak-free labelled sets: strict splits, balance, folds, random negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.functions.symbols import strip, valid_window
from exonloom.operators.ranking import hash_key, hash_rank
from exonloom.spec import SiteSpec


def labelled_windows(dataset: DataFrame, spec: SiteSpec) -> DataFrame:
    """(split, label, w): distinct valid windows of one site, cut to the site's length from the delivered ones. Rows with null or
    other labels, null, short or invalid windows are left out."""
    w = valid_window(F.substring(strip(F.upper("win")), 1, spec.window), spec.window)
    return dataset.where((F.col("site") == spec.name) & F.col("label").isin(0, 1) & F.col("split").isin("train", "test")).select("split", "label", w.alias("w")).where("w is not null").distinct()


def strict_split(v: DataFrame) -> DataFrame:
    """(split, label, w) without any window on two sides: training positives stay; test positives lose them; training negatives lose
    training positives; test negatives lose all others.

    One grouping by window carries the four memberships, so there is one shuffle instead of four anti-joins."""
    has = lambda s, k: F.max((F.col("split") == s) & (F.col("label") == k))
    m = v.groupBy("w").agg(has("train", 1).alias("tp"), has("test", 1).alias("qp"), has("train", 0).alias("tn"), has("test", 0).alias("qn"))
    sides = F.array_compact(
        F.array(
            F.when(F.col("tp"), F.struct(F.lit("train").alias("split"), F.lit(1).alias("label"))),
            F.when(F.col("qp") & ~F.col("tp"), F.struct(F.lit("test").alias("split"), F.lit(1).alias("label"))),
            F.when(F.col("tn") & ~F.col("tp"), F.struct(F.lit("train").alias("split"), F.lit(0).alias("label"))),
            F.when(F.col("qn") & ~F.col("tp") & ~F.col("qp") & ~F.col("tn"), F.struct(F.lit("test").alias("split"), F.lit(0).alias("label"))),
        )
    )
    return m.select("w", F.explode(sides).alias("x")).select("x.split", "x.label", "w")


def require_sides(s: DataFrame) -> DataFrame:
    """The split itself; RuntimeError if any of its four sides is empty."""
    if s.select("split", "label").distinct().count() < 4:
        raise RuntimeError("a side of the split is empty")
    return s


def balanced(s: DataFrame, seed: int = 42) -> DataFrame:
    """As many positives as negatives in each split: the first by hash order. A split with one class only is dropped."""
    k = s.withColumn("_k", hash_key(F.col("w"), seed))
    sizes = s.groupBy("split", "label").agg(F.count("*").alias("n")).groupBy("split").agg(F.min("n").alias("_m"), F.count("*").alias("_c")).where("_c = 2")  # one row a split
    ranked = hash_rank(k, ["split", "label"], "_k")
    return ranked.join(F.broadcast(sizes.select("split", "_m")), "split").where("rank <= _m").select("split", "label", "w")


def folds(s: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """s with `fold` 0..k-1, stratified by label in hash order; ValueError if a class has fewer than k rows."""
    least = s.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if least is None or least < k:
        raise ValueError("not enough samples for the requested number of folds")
    return hash_rank(s.withColumn("_k", hash_key(F.col("w"), seed)), ["label"], "_k").withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("_k", "rank")


def sampled_negatives(windows: DataFrame, exclude: DataFrame, n: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """n distinct windows that are not excluded, the first by hash order. If there are fewer, RuntimeError, or with strict=False all of
    them."""
    both = windows.select("win", F.lit(0).alias("x")).unionByName(exclude.select("win", F.lit(1).alias("x")))
    free = both.groupBy("win").agg(F.max("x").alias("x")).where("x = 0").select("win")
    out = free.withColumn("_k", hash_key(F.col("win"), seed)).orderBy("_k").limit(n).drop("_k")
    if strict and out.count() < n:
        raise RuntimeError(f"fewer than {n} negatives")
    return out


