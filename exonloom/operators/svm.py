"""Support vector classification of windows.

Linear models are fitted by Spark's LinearSVC on all rows. Kernel models solve the dual on a bounded sample of the training rows - at most
`max_rows` per configuration, the first by hash order, a documented parameter - because a kernel matrix grows with the square of the
rows; configurations and folds are solved side by side as groups of one Spark job, and every row is scored, in Arrow batches."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.operators import evaluate, features
from exonloom.operators.ranking import hash_key, hash_rank
from exonloom.operators.split import folds
from exonloom.runtime import write_table
from exonloom.spec import SiteSpec

MAX_ROWS = 1500
KERNELS = ("linear", "rbf", "poly", "sigmoid")
#: Kernel grid of the comparison: name, kernel, C, degree.
KERNEL_GRID = (("Linear", "linear", 1.0, 3), ("RBF C=0.1", "rbf", 0.1, 3), ("RBF C=1.0", "rbf", 1.0, 3), ("RBF C=10", "rbf", 10.0, 3), ("Poly d=2", "poly", 1.0, 2), ("Poly d=3", "poly", 1.0, 3))


@dataclass(frozen=True)
class Config:
    """One classifier: kernel and cost; gamma None means 1 / (features x variance)."""

    name: str
    kernel: str = "rbf"
    cost: float = 1.0
    degree: int = 3
    gamma: float | None = None

    def __post_init__(self):
        if self.kernel not in KERNELS:
            raise ValueError(f"unknown kernel: {self.kernel!r}")


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int) -> np.ndarray:
    if kernel == "linear":
        return a @ b.T
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))
    g = gamma * (a @ b.T)
    return g**degree if kernel == "poly" else np.tanh(g)


def solve_dual(k: np.ndarray, y: np.ndarray, cost: np.ndarray, tol: float = 1e-3, max_iter: int = 100_000) -> tuple[np.ndarray, float, bool]:
    """(alpha, bias, converged) of the soft-margin dual by sequential minimal optimisation with second-order working sets (Fan, Chen and Lin 2005)."""
    n = len(y)
    alpha, grad, diag = np.zeros(n), -np.ones(n), np.diag(k).copy()
    converged = False
    for _ in range(max_iter):
        up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
        low = ((y < 0) & (alpha < cost)) | ((y > 0) & (alpha > 0))
        v = -y * grad
        i = int(np.argmax(np.where(up, v, -np.inf)))
        gap = v[i] - np.where(low, v, np.inf)
        if gap.max() < tol:
            converged = True
            break
        eta = np.maximum(diag[i] + diag - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (gap > 0), gap * gap / eta, -np.inf)))
        step = (v[i] - v[j]) / eta[j]
        step = min(step, cost[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost[j] - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * y * (k[i] - k[j])
    v = -y * grad
    free = (alpha > 1e-8) & (alpha < cost - 1e-8)
    up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
    low = ((y < 0) & (alpha < cost)) | ((y > 0) & (alpha > 0))
    bias = v[free].mean() if free.any() else (v[up].max() + v[low].min()) / 2
    return alpha, float(bias), converged


def precomputed(gram: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """(coefficients, bias) of a classifier on a given matrix of kernel values between at most MAX_ROWS training rows; the score of a
    row is its kernel values to them times the coefficients, plus the bias. y: 1 and -1. ValueError for a matrix of another shape."""
    if gram.shape != (len(y), len(y)) or len(y) > MAX_ROWS:
        raise ValueError(f"a square matrix of at most {MAX_ROWS} rows is needed")
    alpha, bias, _ = solve_dual(gram, y, balanced_cost(y, cost))
    return alpha * y, bias


def balanced_cost(y: np.ndarray, cost: float) -> np.ndarray:
    """Cost of each row, n / (2 x rows of its class) times the overall cost."""
    return np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))


def fit_sigmoid(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid 1 / (1 + exp(a s + b)) by Newton steps (Lin, Lin and Weng 2007)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, float(np.log((n0 + 1) / (n1 + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(a * score + b, -500, 500)))
        d, w = t - p, np.maximum(p * (1 - p), 1e-12)
        g = np.array([(d * score).sum(), d.sum()])
        h = np.array([[(w * score * score).sum() + 1e-12, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-12]])
        if np.abs(g).max() < 1e-6:
            break
        s = np.linalg.solve(h, g)
        a, b = a - s[0], b - s[1]
    return float(a), float(b)


def _sampled(train: DataFrame, by: list[str], max_rows: int, seed: int = 42) -> DataFrame:
    """At most max_rows per group, the first by hash; equal keys are ranked in no given order."""
    return hash_rank(train.withColumn("_k", hash_key(F.col("w"), seed)), by, "_k", "_r").where(F.col("_r") <= max_rows).drop("_k", "_r")


def fit_kernels(train: DataFrame, configs: list[Config], max_rows: int = MAX_ROWS) -> dict[tuple[str, str], tuple]:
    """(kernel, degree, gamma, bias, a, b, mean, sd, coefficients, support vectors) by (configuration, group); train: (grp, label, w,
    features). Configurations x groups x max_rows support vectors at most reach the driver. A warning tells of solvers that stopped
    at their last iteration."""
    spark = train.sparkSession
    grid = spark.createDataFrame([(c.name, c.kernel, c.cost, c.degree, c.gamma) for c in configs], "name string, kernel string, cost double, degree int, gamma double")
    rows = _sampled(train, ["grp"], max_rows).select("*", F.explode(F.array(*[F.lit(c.name) for c in configs])).alias("name")).join(F.broadcast(grid), "name")

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        c = p.iloc[0]
        x, y = np.array(p["features"].tolist(), float), np.where(p["label"] > 0, 1.0, -1.0)
        mean, sd = x.mean(0), x.std(0)
        sd[sd == 0] = 1
        x = (x - mean) / sd
        gamma = c["gamma"] if c["gamma"] == c["gamma"] and c["gamma"] is not None else 1.0 / max(1e-12, x.shape[1] * x.var())
        k = kernel_matrix(x, x, c["kernel"], gamma, int(c["degree"]))
        if len(set(y)) < 2:
            alpha, bias, converged = np.zeros(len(y)), float(y[0]) if len(y) else 0.0, True
        else:
            alpha, bias, converged = solve_dual(k, y, balanced_cost(y, float(c["cost"])))
        sv = alpha > 1e-8
        score = k[:, sv] @ (alpha * y)[sv] + bias
        a, b = fit_sigmoid(score, y)
        return pd.DataFrame([{"name": c["name"], "grp": c["grp"], "kernel": c["kernel"], "degree": int(c["degree"]), "gamma": gamma, "bias": bias, "pa": a, "pb": b, "mean": mean, "sd": sd, "coef": (alpha * y)[sv], "sv": x[sv].ravel(), "n_rows": len(y), "converged": converged}])

    schema = "name string, grp string, kernel string, degree int, gamma double, bias double, pa double, pb double, mean array<double>, sd array<double>, coef array<double>, sv array<double>, n_rows long, converged boolean"
    # configurations x max_rows support vectors at most; as Arrow, because lists of floats take several times the memory
    got = rows.groupBy("name", "grp").applyInPandas(solve, schema).toArrow()
    fitted = {}
    for k in range(got.num_rows):
        one = {c: got.column(c)[k] for c in got.column_names}
        mean, sd, coef, sv = (one[c].values.to_numpy() for c in ("mean", "sd", "coef", "sv"))
        if not one["converged"].as_py():
            warnings.warn(f"the solver of {one['name'].as_py()} stopped at its last iteration")
        fitted[one["name"].as_py(), one["grp"].as_py()] = (*(one[c].as_py() for c in ("kernel", "degree", "gamma", "bias", "pa", "pb")), mean, sd, coef, sv.reshape(len(coef), len(sd)))
    return fitted


def kernel_scores(train: DataFrame, test: DataFrame, configs: list[Config], max_rows: int = MAX_ROWS) -> DataFrame:
    """(model, w, label, score, proba) of every test row under every configuration. train, test: (grp, label, w, features): groups are
    feature sets or folds and are fitted apart; scores belong to the row's own group."""
    sent = train.sparkSession.sparkContext.broadcast(fit_kernels(train, configs, max_rows))

    def score(batches):
        for p in batches:
            for (name, grp), (kernel, degree, gamma, bias, pa, pb, mean, sd, coef, sv) in sent.value.items():
                q = p[p["grp"] == grp]
                if len(q):
                    x = (np.array(q["features"].tolist(), float) - mean) / sd
                    s = kernel_matrix(x, sv, kernel, gamma, degree) @ coef + bias if len(coef) else np.full(len(q), bias)
                    yield pd.DataFrame({"model": name, "grp": grp, "w": q["w"].to_numpy(), "label": q["label"].to_numpy(), "score": s, "proba": 1 / (1 + np.exp(np.clip(pa * s + pb, -500, 500)))})

    return test.select("grp", "label", "w", "features").mapInPandas(score, "model string, grp string, w string, label int, score double, proba double")


def _grouped(s: DataFrame, ex: features.FeatureExtractor, grp: str) -> DataFrame:
    return ex.transform(s).withColumn("grp", F.lit(grp))


def kernel_grid(s: DataFrame, spec: SiteSpec, max_rows: int = MAX_ROWS) -> DataFrame:
    """Measures of the kernel grid on all features, for a split (split, label, w)."""
    ex = features.FeatureExtractor(spec.window).fit(s.where("split = 'train'"))
    data = write_table(_grouped(s, ex, "all"), "svm-rows")
    got = write_table(kernel_scores(data.where("split = 'train'"), data.where("split = 'test'"), [Config(n, k, c, d) for n, k, c, d in KERNEL_GRID], max_rows), "svm-scores")
    rows = evaluate.usable(got, "model")
    return evaluate.confusion(rows).join(evaluate.roc_auc(rows), "model")


def ablation(s: DataFrame, spec: SiteSpec, max_rows: int = MAX_ROWS) -> DataFrame:
    """(feature_set, dim, auc, mcc, f1) of RBF classifiers over the ablation's feature sets; all are fitted in one job."""
    train, parts, dims = s.where("split = 'train'"), [], {}
    for name, fs in features.ABLATION:
        ex = features.FeatureExtractor(spec.window, fs).fit(train)
        dims[name] = ex.feature_dim
        parts.append(_grouped(s, ex, name))
    data = parts[0]
    for p in parts[1:]:
        data = data.unionByName(p)
    data = write_table(data, "ablation-rows")
    got = write_table(kernel_scores(data.where("split = 'train'"), data.where("split = 'test'"), [Config("rbf")], max_rows), "ablation-scores")
    rows = evaluate.usable(got, "grp")
    out = evaluate.confusion(rows).join(evaluate.roc_auc(rows), "model")
    dim = s.sparkSession.createDataFrame(list(dims.items()), "model string, dim int")
    return out.join(F.broadcast(dim), "model").select(F.col("model").alias("feature_set"), "dim", "auc", "mcc", "f1")


def cross_validation(s: DataFrame, spec: SiteSpec, k: int = 5, config: Config = Config("rbf"), feature_set="combined", max_rows: int = MAX_ROWS) -> DataFrame:
    """Mean and population deviation of AUC, MCC and F1 over k stratified folds; the features are fitted anew on each fold's training part."""
    names = features.FeatureExtractor(spec.window, feature_set).features
    fixed = features.FeatureExtractor(spec.window, [x for x in names if x in features.UNFITTED]).fit(s)
    f = write_table(fixed.transform(folds(s, k)).withColumn("fixed", F.col("features").cast("array<double>")).drop("features"), "cv-folds")
    parts = []
    for i in range(k):
        train, test = (f.where(f"fold {x} {i}").withColumn("grp", F.lit(str(i))).withColumn("train", F.lit(x == "<>")) for x in ("<>", "="))
        ex = features.FeatureExtractor(spec.window, [x for x in names if x not in features.UNFITTED]).fit(train)
        rows = _sampled(train, ["grp"], max_rows).unionByName(test)  # kernel_scores takes the same sample
        parts.append(write_table(ex.transform(rows).withColumn("features", F.concat("fixed", F.col("features").cast("array<double>"))).drop("fixed"), "cv-rows"))
    data = parts[0]
    for p in parts[1:]:
        data = data.unionByName(p)
    got = write_table(kernel_scores(data.where("train"), data.where("not train"), [config], max_rows), "cv-scores")
    rows = evaluate.usable(got, "grp")
    per = evaluate.confusion(rows).join(evaluate.roc_auc(rows), "model")
    return per.agg(*[F.avg(m).alias(f"{m}_mean") for m in ("auc", "mcc", "f1")], *[F.stddev_pop(m).alias(f"{m}_std") for m in ("auc", "mcc", "f1")], F.count("*").alias("n_folds"))


class LinearModel:
    """Linear classifier on standardised features with balanced class weights, fitted by LinearSVC on all rows; its regularisation
    1 / (cost x rows) gives the soft-margin objective of that cost."""

    def __init__(self, spec: SiteSpec, feature_set="combined", cost: float = 1.0, max_iter: int = 50):
        self.spec, self.cost, self.max_iter = spec, cost, max_iter
        self.extractor = features.FeatureExtractor(spec.window, feature_set)
        self.weights: list[float] | None = None

    def fit(self, train: DataFrame) -> "LinearModel":
        self.extractor.fit(train)
        return self.fit_rows(write_table(self.extractor.transform(train.select("label", "w")), "linear-rows"))

    def fit_rows(self, data: DataFrame) -> "LinearModel":
        """Fit on rows (label, features) that a fitted extractor has made; they are read several times."""
        from pyspark.ml.classification import LinearSVC
        from pyspark.ml.functions import array_to_vector

        m = {r.k: (r.mean, r.sd) for r in features.moments(data, 0).collect()}
        self.moments = [m[k] for k in sorted(m)]
        n = {r.label: r.n for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(n.values())
        weight = F.when(F.col("label") == 1, total / (2.0 * max(1, n.get(1, 0)))).otherwise(total / (2.0 * max(1, n.get(0, 0))))
        x = features.standardize(data, self.moments).select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("x"), weight.alias("wt"))
        svc = LinearSVC(featuresCol="x", weightCol="wt", regParam=1.0 / (self.cost * total), maxIter=self.max_iter, standardization=False).fit(x)
        self.weights, self.bias = svc.coefficients.toArray().tolist(), svc.intercept
        return self

    def transform(self, df: DataFrame, win_col: str = "w") -> DataFrame:
        """df with `score`; a plain expression over the features."""
        if self.weights is None:
            raise RuntimeError("call fit() first")
        return self.score_rows(self.extractor.transform(df, win_col))

    def score_rows(self, df: DataFrame) -> DataFrame:
        """Rows with `features`, with `score` in their place."""
        x = features.standardize(df, self.moments)
        dot = F.aggregate(F.zip_with("features", F.array(*[F.lit(v) for v in self.weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return x.withColumn("score", dot + self.bias).drop("features")

    def top_features(self, spark, n: int = 15) -> DataFrame:
        """(rank, feature, weight) by size of the weight; ties by order of the features."""
        ranked = sorted(zip(self.extractor.feature_names, self.weights), key=lambda x: -abs(x[1]))[:n]
        return spark.createDataFrame([(i + 1, a, float(b)) for i, (a, b) in enumerate(ranked)], "rank int, feature string, weight double")

    def diagnostics(self, spark) -> DataFrame:
        norm = float(np.linalg.norm(self.weights))
        return spark.createDataFrame([(norm, 2 / norm if norm else None, len(self.weights))], "weight_norm double, margin double, dim int")
