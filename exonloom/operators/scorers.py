"""Every kind of model behind one form: fit on (label, w), score a window column, save to a folder, load from it.

Generative models keep their tables. Classifiers keep their coefficients or support vectors and what their features were fitted to; a
kernel's score runs in Arrow batches, all others are plain expressions. Nothing is pickled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exonloom.operators import features, models, svm
from exonloom.sources.store import load_model, save_model
from exonloom.spec import DEPENDENCY_THRESHOLD, MAX_PAIRS, MAX_PARENTS, SiteSpec

KINDS = ("wmm", "wam", "depwam", "chain", "chow-liu", "ebn", "svm", "svm-linear", "svm-rbf", "svm-poly", "svm-sigmoid")


@dataclass
class Scorer:
    """A fitted model: its kind, parameters and tables."""

    kind: str
    params: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def score(self, win: Column) -> Column:
        """Score of a window; null for windows that can't be scored."""
        t, p = self.tables, self.params
        if self.kind == "wmm":
            return models.wmm_score(win, t["table"])
        if self.kind in ("wam", "depwam"):
            chain = models.wam_score(win, (t["first"], t["cond"], t["bg"]))
            return chain + models.pair_score(win, t["pairs"]) if self.kind == "depwam" else chain
        if self.kind in ("chain", "chow-liu", "ebn"):
            return models.network_log_prob(win, t["fg"], p["parents"]) - models.network_log_prob(win, t["bg"], p["parents"])
        x = _extractor(p, t).array(win, lambdas=self.kind == "svm-linear")
        valid = F.length(win) == p["window"]
        if self.kind == "svm-linear":
            scaled = F.zip_with(x, F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s or 1.0).alias("s"), F.lit(w).alias("w")) for m, s, w in zip(p["mean"], p["sd"], p["weights"])]), lambda a, b: (a - b["m"]) / b["s"] * b["w"])
            return F.when(valid, F.aggregate(scaled, F.lit(float(p["bias"])), lambda a, b: a + b))
        return self._kernel()(F.when(valid, x))

    def probability(self, win: Column) -> Column:
        """Platt's probability of a positive; kernel classifiers only."""
        a, b = self.params["sigmoid"]
        return 1 / (1 + F.exp(F.lit(a) * self.score(win) + F.lit(b)))

    def predict(self, win: Column, threshold: float = 0.0) -> Column:
        """1 where the score reaches the threshold, else -1; null without a score."""
        return (self.score(win) >= threshold).cast("int") * 2 - 1

    def _kernel(self) -> Callable[[Column], Column]:
        p, kernel = self.params, self.kind.removeprefix("svm-")
        kernel = "rbf" if kernel == "svm" else kernel
        mean, sd, coef, sv = (np.array(p[c]) for c in ("mean", "sd", "coef", "sv"))

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            ok, out = x.notna().to_numpy(), np.full(len(x), np.nan)
            if ok.any():
                z = (np.array(x[ok].tolist(), float) - mean) / sd
                out[ok] = svm.kernel_matrix(z, sv.reshape(len(coef), len(mean)), kernel, p["gamma"], p["degree"]) @ coef + p["bias"] if len(coef) else p["bias"]
            return pd.Series(out)

        return run

    def save(self, spark: SparkSession, path: str) -> None:
        save_model(spark, path, self.kind, self.params, self.tables)


def load(spark: SparkSession, path: str) -> Scorer:
    """The model in a folder. FileNotFoundError if there is none, TypeError if it is of no known kind."""
    kind, params, tables = load_model(spark, path)
    if kind not in KINDS:
        raise TypeError(f"{path} holds a {kind} model")
    return Scorer(kind, params, tables)


def _extractor(p: dict, t: dict[str, DataFrame]) -> features.FeatureExtractor:
    """A fitted extractor from what was stored of it."""
    ex = features.FeatureExtractor(p["window"], p["features"])
    ex.pwm = {(int(i), b): v for i, b, v in p["pwm"]}
    ex.pairs = [tuple(x) for x in p["pairs"]]
    if p["parents"] is not None:
        ex.network = models.Network(p["window"], "ebn")
        ex.network.parents, ex.network.fg, ex.network.bg = p["parents"], t["fg"], t["bg"]
    ex.fitted = True
    return ex


def fit(kind: str, train: DataFrame, spec: SiteSpec, threshold: float = DEPENDENCY_THRESHOLD, max_pairs: int = MAX_PAIRS, max_parents: int = MAX_PARENTS, feature_set="combined", cost: float = 1.0, degree: int = 3, gamma: float | None = None, max_rows: int = svm.MAX_ROWS) -> Scorer:
    """Fit a model of one of KINDS ('svm' is the kernel classifier with rbf) on (label, w). ValueError for another kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown model: {kind!r}")
    params = {"site": spec.name, "window": spec.window}
    if kind == "wmm":
        return Scorer(kind, params, {"table": models.wmm_table(train, spec.window)})
    if kind in ("wam", "depwam"):
        tables = dict(zip(("first", "cond", "bg"), models.wam_tables(train, spec.window)))
        return Scorer(kind, params, tables | ({"pairs": models.pair_log_odds(train, spec.window, threshold, max_pairs)} if kind == "depwam" else {}))
    if kind in ("chain", "chow-liu", "ebn"):
        m = models.Network(spec.window, kind, threshold, max_parents).fit(train)
        return Scorer(kind, params | {"parents": m.parents}, {"fg": m.fg, "bg": m.bg})
    ex = features.FeatureExtractor(spec.window, feature_set, threshold, max_pairs, max_parents).fit(train)
    net = ex.network
    params |= {"features": list(ex.features), "pwm": [[i, b, v] for (i, b), v in ex.pwm.items()], "pairs": [list(x) for x in ex.pairs], "parents": net.parents if net else None}
    tables = {"fg": net.fg, "bg": net.bg} if net else {}
    data = ex.transform(train.select("label", "w"))
    if kind == "svm-linear":
        m = svm.LinearModel(spec, feature_set, cost)
        m.extractor = ex
        m.fit_rows(svm.write_table(data, "linear-rows"))
        return Scorer(kind, params | {"mean": [a for a, _ in m.moments], "sd": [b for _, b in m.moments], "weights": m.weights, "bias": m.bias}, tables)
    kernel = "rbf" if kind == "svm" else kind.removeprefix("svm-")
    one = svm.fit_kernels(data.withColumn("grp", F.lit("all")), [svm.Config(kind, kernel, cost, degree, gamma)], max_rows)[kind, "all"]
    _, degree, gamma, bias, pa, pb, mean, sd, coef, sv = one
    return Scorer(kind, params | {"degree": degree, "gamma": gamma, "bias": bias, "sigmoid": [pa, pb], "mean": mean.tolist(), "sd": sd.tolist(), "coef": coef.tolist(), "sv": sv.ravel().tolist(), "n_support": len(coef)}, tables)
