"""Feature blocks of windows: one-hot, k-mer shares, positional dinucleotides, position weights, dependent pairs, network log-ratio.

A block is a list of (name, column) pairs over the window column, so that a feature vector is one array expression."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.operators import models, stats
from exonloom.runtime import write_table
from exonloom.spec import DEPENDENCY_THRESHOLD, MAX_PAIRS, MAX_PARENTS

ALL_FEATURES = ("one_hot", "kmer2", "kmer3", "dinuc_pos", "pwm", "chi2_pairs", "ebn_llr")
#: Those that don't depend on the training data.
UNFITTED = ("one_hot", "kmer2", "kmer3", "dinuc_pos")
#: Feature sets of the ablation (name, features).
ABLATION = (
    ("One-hot only", ("one_hot",)), ("k-mer (2+3)", ("kmer2", "kmer3")), ("Dinuc positional", ("dinuc_pos",)), ("PWM log-odds", ("pwm",)), ("Chi2 dependency pairs", ("chi2_pairs",)),
    ("EBN LLR only", ("ebn_llr",)), ("One-hot + k-mer", ("one_hot", "kmer2", "kmer3")), ("One-hot + dinuc + PWM", ("one_hot", "dinuc_pos", "pwm")),
    ("Dependency-aware set", ("one_hot", "dinuc_pos", "chi2_pairs", "ebn_llr")), ("Combined (all)", ALL_FEATURES),
)


def kmers(k: int) -> list[str]:
    return ["".join(x) for x in product(stats.BASES, repeat=k)]


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def one_hot(win: Column, length: int) -> list[tuple[str, Column]]:
    return [(f"oh_pos{i}_{b}", _flag(win.substr(i + 1, 1) == b)) for i in range(length) for b in stats.BASES]


def kmer_block(win: Column, length: int, k: int) -> Column:
    """Share of each k-mer among the window's valid k-mers (overlapping), as one array in the order of kmers(k). The codes of the
    window's k-mers are made once and counted from there."""
    digit = lambda i, j: F.position(win.substr(i + (j + 1), F.lit(1)), F.lit("ACGT"))  # noqa: E731  (0 outside ACGT)
    code = lambda i: F.when(reduce(lambda a, b: a & b, [digit(i, j) > 0 for j in range(k)]), sum(((digit(i, j) - 1) * 4 ** (k - 1 - j) for j in range(k)), F.lit(0)))
    codes = F.array(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(length - k)), code)))  # in a list of one, so that it is bound once
    shares = lambda c: F.transform(F.sequence(F.lit(0), F.lit(4**k - 1)), lambda m: F.when(F.size(c) > 0, F.size(F.filter(c, lambda x: x == m)) / F.size(c)).otherwise(0.0))
    return F.get(F.transform(codes, shares), F.lit(0))


def kmer_columns(win: Column, length: int, k: int) -> Column:
    """kmer_block without lambdas, which the input of a Python function must not hold."""
    at = [win.substr(i + 1, k) for i in range(length - k + 1)]
    n = sum((_flag(x.rlike(f"^[ACGT]{{{k}}}$")) for x in at), F.lit(0.0))
    return F.array(*[F.coalesce(sum((_flag(x == m) for x in at), F.lit(0.0)) / F.nullif(n, F.lit(0.0)), F.lit(0.0)) for m in kmers(k)])


def dinucleotides(win: Column, length: int, pairs: list[tuple[int, int]] | None = None, name: str = "dn_pos{i}_{ab}") -> list[tuple[str, Column]]:
    pairs = pairs if pairs is not None else [(i, i + 1) for i in range(length - 1)]
    return [(name.format(i=i, j=j, ab=a + b), _flag((win.substr(i + 1, 1) == a) & (win.substr(j + 1, 1) == b))) for i, j in pairs for a in stats.BASES for b in stats.BASES]


class FeatureExtractor:
    """fit(train) on (label, w), then columns(win) or transform(df). `features`: a name or a list of names; ValueError for unknown ones and
    for 'ebn_llr' without negatives, RuntimeError before fit."""

    def __init__(self, length: int, features="combined", threshold: float = DEPENDENCY_THRESHOLD, max_pairs: int = MAX_PAIRS, max_parents: int = MAX_PARENTS):
        names = [features] if isinstance(features, str) else list(features)
        names = [x for f in names for x in (ALL_FEATURES if f == "combined" else [f])]
        for f in names:
            if f not in ALL_FEATURES:
                raise ValueError(f"unknown feature: {f!r}")
        self.length, self.features, self.threshold, self.max_pairs, self.max_parents = length, names, threshold, max_pairs, max_parents
        self.fitted = False

    def fit(self, train: DataFrame) -> "FeatureExtractor":
        """Pairs are counted once for dependent pairs and network alike."""
        pos = train.where("label = 1").select("w")
        models.require_positives(pos)
        if "ebn_llr" in self.features and train.where("label = 0").isEmpty():
            raise ValueError("'ebn_llr' needs negative windows")
        self.pwm = {(r.pos, r.base): r.log_odds for r in models.wmm_table(train, self.length, "uniform").collect()} if "pwm" in self.features else {}
        self.pairs: list[tuple[int, int]] = []
        chi2 = write_table(stats.chi2_pairs(stats.pair_counts(pos, self.length)), "chi2") if {"chi2_pairs", "ebn_llr"} & set(self.features) else None
        if "chi2_pairs" in self.features:
            chosen = stats.dependency_pairs(chi2, self.threshold, max(0, self.max_pairs))
            self.pairs = [(r.i, r.j) for r in chosen.orderBy("rank").collect()]
        self.network = models.Network(self.length, "ebn", self.threshold, self.max_parents).fit(train, chi2=chi2) if "ebn_llr" in self.features else None
        self.fitted = True
        return self

    def _blocks(self, win: Column, kmer=kmer_block) -> list[tuple[list[str], Column]]:
        """Names and array of each block."""
        if not self.fitted:
            raise RuntimeError("call fit() first")
        out = []
        for f in self.features:
            if f in ("kmer2", "kmer3"):
                k = int(f[-1])
                out.append(([f"k{k}_{m}" for m in kmers(k)], kmer(win, self.length, k)))
                continue
            if f == "one_hot":
                one = one_hot(win, self.length)
            elif f == "dinuc_pos":
                one = dinucleotides(win, self.length)
            elif f == "pwm":
                one = [(f"pwm_pos{i}", F.get(F.array(*[F.lit(self.pwm[i, b]) for b in stats.BASES]), models.code(win, i))) for i in range(self.length)]
            elif f == "chi2_pairs":
                one = dinucleotides(win, self.length, self.pairs, "chi2_pair_{i}_{j}_{ab}")
            else:  # negatives minus positives, the other way round than the network's score
                one = [("ebn_llr_false_vs_true", -self.network.score(win))]
            if one:
                out.append(([n for n, _ in one], F.array(*[c.cast("double") for _, c in one])))
        return out

    @property
    def feature_names(self) -> list[str]:
        return [n for names, _ in self._blocks(F.col("w")) for n in names]

    @property
    def feature_dim(self) -> int:
        return len(self.feature_names)

    def array(self, win: Column, lambdas: bool = True) -> Column:
        """The feature vector of a window; without lambdas, as the input of a Python function must be."""
        return F.concat(F.array().cast("array<double>"), *[c for _, c in self._blocks(win, kmer_block if lambdas else kmer_columns)])

    def transform(self, df: DataFrame, win_col: str = "w") -> DataFrame:
        """df with `features`, an array of doubles."""
        return df.withColumn("features", self.array(F.col(win_col)))


def moments(df: DataFrame, dim: int) -> DataFrame:
    """(k, mean, sd) of each feature, with the population deviation; one pass over the arrays."""
    x = df.select(F.posexplode("features").alias("k", "x"))
    return x.groupBy("k").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def standardize(df: DataFrame, m: list[tuple[float, float]]) -> DataFrame:
    """Features minus their mean, by their deviation (1 where it is 0)."""
    mean, sd = F.array(*[F.lit(a) for a, _ in m]), F.array(*[F.lit(b if b > 0 else 1.0) for _, b in m])
    return df.withColumn("features", F.zip_with(F.zip_with("features", mean, lambda x, a: x - a), sd, lambda x, b: x / b))
