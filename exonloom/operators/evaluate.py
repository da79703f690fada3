"""Confusion metrics, ROC curves and AUC of (model, label, score) rows. Rows with a null label or score are left out; scores of -Infinity
are the lowest; NaN scores are left out as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.operators.ranking import running_totals


def usable(df: DataFrame, model: str = "model_name", label: str = "label", score: str = "score") -> DataFrame:
    return df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(model).alias("model"), F.col(label).alias("label"), F.col(score).alias("score"))


def confusion(df: DataFrame, threshold: Column | float = 0.0) -> DataFrame:
    """(model, tp, fp, tn, fn, sensitivity, specificity, precision, f1, mcc); a measure whose denominator is 0 is 0."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    c = df.groupBy("model").agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"))
    return metrics(c)


def metrics(c: DataFrame) -> DataFrame:
    """The measures of confusion counts, added as columns."""
    d = {k: F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn")}
    div = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    sens, spec, prec = div(d["tp"], d["tp"] + d["fn"]), div(d["tn"], d["tn"] + d["fp"]), div(d["tp"], d["tp"] + d["fp"])
    root = F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"]))
    return c.withColumns({"sensitivity": sens, "specificity": spec, "precision": prec, "f1": div(2 * prec * sens, prec + sens), "mcc": div(d["tp"] * d["tn"] - d["fp"] * d["fn"], root)})


def _by_score(df: DataFrame) -> DataFrame:
    """(model, score, p, n) per distinct score, with running totals cum_p, cum_n from the highest score down and the totals all_p, all_n."""
    g = df.groupBy("model", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    run = running_totals(g, "model", "score", ["p", "n"])
    total = df.groupBy("model").agg(F.sum("label").alias("all_p"), F.sum(1 - F.col("label")).alias("all_n"))  # one row a model
    return run.join(F.broadcast(total), "model")


def roc_auc(df: DataFrame) -> DataFrame:
    """(model, auc): exact rank-based AUC, ties counting half; null for a model with one class only."""
    s = _by_score(df)
    won = F.col("p") * (F.col("all_n") - F.col("cum_n") + F.col("n") / 2)
    return s.groupBy("model").agg((F.sum(won) / F.nullif(F.max("all_p").cast("double") * F.max("all_n"), F.lit(0.0))).alias("auc"))


def roc_curve(df: DataFrame, n_thresholds: int = 200, last: bool = True) -> DataFrame:
    """(model, idx, threshold, fpr, tpr): every step-th distinct score from the highest down, step = max(1, distinct // n_thresholds), the
    last one again if wanted, between (0, 0) and (1, 1). A rate without cases is 0."""
    s = _by_score(df).withColumn("one", F.lit(1))
    r = running_totals(s.select("model", "score", "p", "n", "cum_p", "cum_n", "all_p", "all_n", "one"), "model", "score", ["one"]).withColumnRenamed("cum_one", "k")
    count = s.groupBy("model").agg(F.count("*").alias("distinct"))
    r = r.join(F.broadcast(count), "model").withColumn("step", F.greatest(F.lit(1), F.floor(F.col("distinct") / n_thresholds)))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    r = r.withColumns({"fpr": rate("cum_n", "all_n"), "tpr": rate("cum_p", "all_p"), "on": (F.col("k") - 1) % F.col("step") == 0, "end": F.col("k") == F.col("distinct")})
    times = F.when(F.col("on") & F.col("end") & F.lit(last), 2).when(F.col("on") | F.col("end") & F.lit(last), 1).otherwise(0)
    idx = F.floor((F.col("k") - 1) / F.col("step")).cast("int") + F.when(F.col("on"), 1).otherwise(2)
    at = r.where(times > 0).select("model", idx.alias("idx"), F.col("score").alias("threshold"), "fpr", "tpr", F.explode(F.sequence(F.lit(0), times - 1)).alias("again")).withColumn("idx", F.col("idx") + F.col("again")).drop("again")
    size = at.groupBy("model").agg(F.max("idx").alias("m"))
    null = F.lit(None).cast("double")
    a = size.select("model", F.lit(0).alias("idx"), null.alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    z = size.select("model", (F.col("m") + 1).alias("idx"), null.alias("threshold"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    return a.unionByName(at).unionByName(z)


def auc_of_curve(curve: DataFrame) -> DataFrame:
    """(model, auc) by trapezoids over a curve of roc_curve (some 400 points a model at most)."""
    w = Window.partitionBy("model").orderBy("idx")
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return curve.withColumn("area", area).groupBy("model").agg(F.sum("area").alias("auc"))


def best_markers(long: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(model, metric, value, is_best) from (model, metric, value): within tolerance of the metric's best. A row a model and metric."""
    best = F.max("value").over(Window.partitionBy("metric"))
    return long.withColumn("is_best", F.abs(F.col("value") - best) <= tolerance)


def compare(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """All measures and the AUC of each model in long form (model, metric, value, is_best)."""
    m = confusion(df, threshold).join(roc_auc(df), "model")
    names = ["sensitivity", "specificity", "precision", "f1", "mcc", "auc"]
    return best_markers(m.select("model", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("x")).select("model", "x.metric", "x.value"))
