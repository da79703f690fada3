"""Synthetic windows for demonstrations: weighted draws per position, made row by row on the executors from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.spec import ACCEPTOR, DONOR, SiteSpec

#: Base weights A, C, G, T of a donor's positions, and of an acceptor's pyrimidine tract.
DONOR_WEIGHTS = {0: (0.35, 0.15, 0.35, 0.15), 1: (0.45, 0.10, 0.35, 0.10), 2: (0.20, 0.15, 0.50, 0.15), 5: (0.65, 0.10, 0.15, 0.10), 6: (0.70, 0.10, 0.10, 0.10), 7: (0.10, 0.10, 0.65, 0.15), 8: (0.10, 0.10, 0.10, 0.70)}
#: A position that takes a symbol with a chance if another position has one of some symbols.
DEPENDENT = {2: ("G", 0.70, 0, ("A", "G")), 8: ("T", 0.75, 5, ("A",))}
TRACT = (0.10, 0.30, 0.10, 0.50)
UNIFORM = (0.25, 0.25, 0.25, 0.25)


def draw(u: Column, weights: tuple[float, ...]) -> Column:
    """Base of a uniform number; weights are taken relative to their sum, without any they are equal."""
    total = sum(weights)
    w = weights if total > 0 else UNIFORM
    total = sum(w)
    a, c, g = w[0] / total, (w[0] + w[1]) / total, (w[0] + w[1] + w[2]) / total
    return F.when(u < a, "A").when(u < c, "C").when(u < g, "G").otherwise("T")


def windows(spark: SparkSession, spec: SiteSpec, n: int, label: int, seed: int = 42, dependent: bool = False, reject: bool = False) -> DataFrame:
    """(w, label) of n windows: positives have the motif at its offset and follow the position weights; negatives are uniform
    but for the motif, which they have too (hard negatives) or, with reject, never have there. dependent: positions of DEPENDENT look at
    others in donor positives."""
    at = range(spec.offset, spec.offset + 2)
    weights = lambda i: UNIFORM if label == 0 else DONOR_WEIGHTS.get(i, UNIFORM) if spec is DONOR else TRACT if i < ACCEPTOR.offset - 1 else UNIFORM
    drawn = [F.lit(spec.motif[i - spec.offset]) if i in at and not (reject and label == 0) else draw(F.rand(seed * 1000 + i + 500 * label), weights(i)) for i in range(spec.window)]
    df = spark.range(n).select(*[c.alias(f"_p{i}") for i, c in enumerate(drawn)])
    if reject and label == 0:  # one of the 15 other pairs in the place of the motif
        others = [a + b for a in "ACGT" for b in "ACGT" if a + b != spec.motif]
        pair = F.get(F.array(*[F.lit(x) for x in others]), F.floor(F.rand(seed * 1000 + 999) * len(others)).cast("int"))
        df = df.withColumn("_pair", pair).withColumns({f"_p{i}": F.substring("_pair", i - spec.offset + 1, 1) for i in at})
    if dependent and label == 1 and spec is DONOR:
        df = df.withColumns({f"_p{i}": F.when(F.col(f"_p{src}").isin(*seen) & (F.rand(seed * 1000 + 100 + i) < share), F.lit(base)).otherwise(F.col(f"_p{i}")) for i, (base, share, src, seen) in DEPENDENT.items()})
    return df.select(F.concat(*[F.col(f"_p{i}") for i in range(spec.window)]).alias("w"), F.lit(label).alias("label"))
