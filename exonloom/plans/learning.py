"""Registered queries on features, evaluation of given scores, support vector classifiers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import evaluate, features, models, svm
from exonloom.plans.scoring import _CHI, _EBN_TABLES, _FREQ, _WMM, L, _ebn_score
from exonloom.plans.sequences import STRIP, strict, strict_windows
from exonloom.runtime import scratch_path, write_table
from exonloom.sources.tables import table
from exonloom.spec import DONOR
from exonloom.streaming import scoring as streams


def _strict(spark, sf_dir):
    return write_table(strict_windows(spark, sf_dir), "strict")


def onehot_features(spark, sf_dir):
    s = strict_windows(spark, sf_dir)
    return s.select("split", "label", "w", F.concat(*[c.cast("int").cast("string") for _, c in features.one_hot(F.col("w"), L)]).alias("one_hot"))


def _kmer(spark, sf_dir, k):
    s = strict_windows(spark, sf_dir).select("w").distinct()
    names = F.array(*[F.lit(m) for m in features.kmers(k)])
    x = s.select("w", F.explode(F.arrays_zip(names.alias("kmer"), features.kmer_block(F.col("w"), L, k).alias("share"))).alias("x"))
    return x.where("x.share > 0").select("w", F.col("x.kmer").alias("kmer"), F.round("x.share", 6).alias("share"))


def kmer2_freq(spark, sf_dir):
    return _kmer(spark, sf_dir, 2)


def kmer3_freq(spark, sf_dir):
    return _kmer(spark, sf_dir, 3)


def dinuc_pos_features(spark, sf_dir):
    s = strict_windows(spark, sf_dir)
    at = F.transform(F.sequence(F.lit(0), F.lit(L - 2)), lambda i: F.struct(i.alias("pos"), (F.position(F.col("w").substr(i + 1, F.lit(1)), F.lit("ACGT")) * 4 + F.position(F.col("w").substr(i + 2, F.lit(1)), F.lit("ACGT")) - 5).alias("code")))
    return s.select("w", F.inline(at))


def pwm_features(spark, sf_dir):
    s = _strict(spark, sf_dir)
    ex = features.FeatureExtractor(L, "pwm").fit(s.where("split = 'train'"))
    return ex.transform(s).select("w", F.posexplode("features").alias("pos", "value")).withColumn("value", F.round("value", 6))


def chi2_pair_features(spark, sf_dir):
    s = _strict(spark, sf_dir)
    ex = features.FeatureExtractor(L, "chi2_pairs").fit(s.where("split = 'train'"))
    at = [F.concat(F.lit(f"chi2_pair_{i}_{j}_"), F.col("w").substr(i + 1, 1), F.col("w").substr(j + 1, 1)) for i, j in ex.pairs]
    return s.select("w", F.explode(F.array(*at)).alias("feature"))


def feature_standardize(spark, sf_dir):
    s = _strict(spark, sf_dir)
    ex = features.FeatureExtractor(L, "pwm").fit(s.where("split = 'train'"))
    m = features.moments(ex.transform(s.where("split = 'train'")), ex.feature_dim)
    return m.select("k", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def combined_features(spark, sf_dir):
    s = _strict(spark, sf_dir)
    ex = features.FeatureExtractor(L).fit(s.where("split = 'train'"))
    return ex.transform(s).select("split", "label", "w", F.size("features").alias("dim"), F.round(F.aggregate("features", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def _scores(spark, sf_dir):
    return evaluate.usable(table(spark, sf_dir, "scores"))


def confusion_metrics(spark, sf_dir):
    m = evaluate.confusion(_scores(spark, sf_dir), 0.0)
    return m.withColumns({c: F.round(c, 6) for c in ("sensitivity", "specificity", "precision", "f1", "mcc")})


def roc_auc_exact(spark, sf_dir):
    return evaluate.roc_auc(_scores(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(_scores(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


def roc_auc_sampled(spark, sf_dir):
    return evaluate.auc_of_curve(evaluate.roc_curve(_scores(spark, sf_dir))).withColumn("auc", F.round("auc", 6))


def best_model_markers(spark, sf_dir):
    return evaluate.compare(_scores(spark, sf_dir)).withColumn("value", F.round("value", 6))


def svm_linear(spark, sf_dir):
    s = _strict(spark, sf_dir)
    m = svm.LinearModel(DONOR).fit(s.where("split = 'train'"))
    return m.transform(s.where("split = 'test'")).select("label", "w", "score")


def top_features(spark, sf_dir):
    s = _strict(spark, sf_dir)
    return svm.LinearModel(DONOR).fit(s.where("split = 'train'")).top_features(spark)


def svm_predictions(spark, sf_dir):
    """Test windows with score, probability and prediction (1 or -1) of the kernel classifier on all features."""
    d = _strict(spark, sf_dir)
    rows = write_table(features.FeatureExtractor(L).fit(d.where("split = 'train'")).transform(d).withColumn("grp", F.lit("all")), "svm-rows")
    got = svm.kernel_scores(rows.where("split = 'train'"), rows.where("split = 'test'"), [svm.Config("rbf")])
    return got.select("w", "label", "score", "proba", F.when(F.col("score") >= 0, 1).otherwise(-1).alias("predicted"))


def svm_kernel_grid(spark, sf_dir):
    return svm.kernel_grid(_strict(spark, sf_dir), DONOR)


def feature_ablation(spark, sf_dir):
    return svm.ablation(_strict(spark, sf_dir), DONOR)


def cross_validation(spark, sf_dir):
    s = _strict(spark, sf_dir).where("split = 'train'").select("label", "w")
    return svm.cross_validation(s, DONOR)


def four_way_comparison(spark, sf_dir):
    """Position model, chain, network and vector classifiers on one test set."""
    d = _strict(spark, sf_dir)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    wmm, wam, w = models.wmm_table(train, L), models.wam_tables(train, L), F.col("w")
    scores = {"WMM": models.wmm_score(w, wmm), "WAM": models.wam_score(w, wam), "BN ebn": models.Network(L, "ebn").fit(train).score(w)}
    x = test.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("score")) for k, v in scores.items()])).alias("x")).select("x.model", "label", "x.score")
    ex = features.FeatureExtractor(L).fit(train)
    rows = write_table(ex.transform(d).withColumn("grp", F.lit("all")), "four-way")
    known, unseen = rows.where("split = 'train'"), rows.where("split = 'test'")
    linear = svm.LinearModel(DONOR).fit_rows(known).score_rows(unseen).select(F.lit("SVM linear").alias("model"), "label", "score")
    rbf = svm.kernel_scores(known, unseen, [svm.Config("SVM rbf")]).select("model", "label", "score")
    return evaluate.compare(write_table(evaluate.usable(x.unionByName(linear).unionByName(rbf), "model"), "four-way-scores"))


def stream_window_rates(spark, sf_dir):
    """The windows table as a stream, counted per site and week; the stream is run to its end."""
    schema = table(spark, sf_dir, "windows").schema
    rows, state = scratch_path(spark, "rates"), scratch_path(spark, "rates-state")
    rates = streams.window_rates(spark.readStream.schema(schema).parquet(f"{sf_dir}/windows.parquet*"))
    q = rates.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(rows)).start()
    q.awaitTermination()
    return spark.read.parquet(rows).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


def stream_scores(spark, sf_dir):
    """Donor windows scored as a stream with the position model."""
    s = _strict(spark, sf_dir)
    t = models.wmm_table(s.where("split = 'train'"), L)
    schema = table(spark, sf_dir, "windows").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/windows.parquet*").where("site = 'donor'")
    scored = streams.score_windows(rows, DONOR, lambda w: F.round(models.wmm_score(w, t), 6)).select("record_id", "i", "win", "extracted_at", "score")
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    q = scored.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).start(out)
    q.awaitTermination()
    return spark.read.parquet(out).where("score is not null")


QUERIES = {
    f.__name__: f
    for f in (
        onehot_features, kmer2_freq, kmer3_freq, dinuc_pos_features, pwm_features, chi2_pair_features, feature_standardize, combined_features, confusion_metrics, roc_auc_exact, roc_curve, roc_auc_sampled,
        best_model_markers, svm_linear, top_features, svm_predictions, svm_kernel_grid, feature_ablation, cross_validation, four_way_comparison, stream_window_rates, stream_scores,
    )
}

_U = "u AS (SELECT model_name AS model, label, score FROM scores WHERE label IN (0, 1) AND score IS NOT NULL AND NOT isnan(score))"
_CONF = f"""{_U}, c AS (SELECT model, count(*) FILTER (label = 1 AND score >= 0) AS tp, count(*) FILTER (label = 0 AND score >= 0) AS fp, count(*) FILTER (label = 0 AND score < 0) AS tn, count(*) FILTER (label = 1 AND score < 0) AS fn FROM u GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision FROM c),
mm AS (SELECT *, coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0) AS f1, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM m)"""
_AUC = """k AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2e0 AS r FROM u),
a AS (SELECT model, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2e0) / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)) AS auc FROM k GROUP BY 1)"""
_CURVE = f"""{_U}, d AS (SELECT model, score, sum(label) AS p, sum(1 - label) AS n FROM u GROUP BY ALL),
e AS (SELECT model, score, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY model) AS P, sum(n) OVER (PARTITION BY model) AS N, row_number() OVER w AS k, count(*) OVER (PARTITION BY model) AS dc FROM d WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
""".replace("AS P,", "AS tp_all,").replace("AS N,", "AS tn_all,") + """f AS (SELECT *, greatest(1, dc // 200) AS step FROM e),
g AS (SELECT model, k, 0 AS again, score, cn / tn_all::DOUBLE AS fpr, cp / tp_all::DOUBLE AS tpr FROM f WHERE (k - 1) % step = 0 UNION ALL SELECT model, k, 1, score, cn / tn_all::DOUBLE, cp / tp_all::DOUBLE FROM f WHERE k = dc),
h AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY k, again)::INTEGER AS idx, score AS threshold, fpr, tpr FROM g),
cu AS (SELECT * FROM h UNION ALL SELECT DISTINCT model, 0, NULL, 0e0, 0e0 FROM h UNION ALL SELECT model, (max(idx) + 1)::INTEGER, NULL, 1e0, 1e0 FROM h GROUP BY model)"""
_PWM = f"{_WMM}, pl AS (SELECT pos, base, ln(greatest(p, 1e-10) / 0.25e0) AS v FROM pf)"


def _kmer_sql(k: int) -> str:
    return f"WITH {strict()} SELECT w, kmer, round(count(*) / {9 - k + 1}e0, 6) AS share FROM (SELECT w, substring(w, p::INTEGER, {k}) AS kmer FROM (SELECT w, unnest(range(1, {9 - k + 2})) AS p FROM (SELECT DISTINCT w FROM st))) GROUP BY ALL"


ORACLE = {
    "onehot_features": f"WITH {strict()} SELECT split, label, w, replace(replace(replace(replace(w, 'A', '1000'), 'C', '0100'), 'G', '0010'), 'T', '0001') AS one_hot FROM st",
    "kmer2_freq": _kmer_sql(2),
    "kmer3_freq": _kmer_sql(3),
    "dinuc_pos_features": f"WITH {strict()} SELECT w, (p - 1)::INTEGER AS pos, (4 * (instr('ACGT', substring(w, p::INTEGER, 1)) - 1) + instr('ACGT', substring(w, p::INTEGER + 1, 1)) - 1)::INTEGER AS code FROM (SELECT w, unnest(range(1, 9)) AS p FROM st)",
    "pwm_features": f"WITH {_PWM} SELECT w, pos, round(v, 6) AS value FROM (SELECT w, unnest(range(1, 10)) AS p FROM st) JOIN pl ON pos = p - 1 AND base = substring(w, p::INTEGER, 1)",
    "chi2_pair_features": f"WITH {_CHI} SELECT w, 'chi2_pair_' || i || '_' || j || '_' || substring(w, i + 1, 1) || substring(w, j + 1, 1) AS feature FROM st, dp",
    "feature_standardize": f"WITH {_PWM} SELECT pos AS k, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM (SELECT w, unnest(range(1, 10)) AS p FROM st WHERE split = 'train') JOIN pl ON pos = p - 1 AND base = substring(w, p::INTEGER, 1) GROUP BY 1",
    "combined_features": f"""WITH RECURSIVE {_EBN_TABLES}, {_FREQ}, {_ebn_score('st', 'split, label, w')}, np AS (SELECT count(*) AS n FROM dp),
pl AS (SELECT pos, base, ln(greatest(p, 1e-10) / 0.25e0) AS v FROM pf), pv AS (SELECT w, sum(v) AS v FROM (SELECT w, unnest(range(1, 10)) AS q FROM (SELECT DISTINCT w FROM st)) JOIN pl ON pos = q - 1 AND base = substring(w, q::INTEGER, 1) GROUP BY w)
SELECT split, label, w, (254 + 16 * n)::INTEGER AS dim, round(9 + 1 + 1 + 8 + v + n - score, 6) AS total FROM eb JOIN pv USING (w), np""",
    "confusion_metrics": f"WITH {_CONF} SELECT model, tp, fp, tn, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(f1, 6) AS f1, round(mcc, 6) AS mcc FROM mm",
    "roc_auc_exact": f"WITH {_U}, {_AUC} SELECT model, round(auc, 6) AS auc FROM a",
    "roc_curve": f"WITH {_CURVE} SELECT model, idx, threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM cu",
    "roc_auc_sampled": f"WITH {_CURVE} SELECT model, round(sum(a), 6) AS auc FROM (SELECT model, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM cu WINDOW w AS (PARTITION BY model ORDER BY idx)) GROUP BY 1",
    "best_model_markers": f"""WITH {_CONF}, {_AUC}, l AS (UNPIVOT (SELECT model, sensitivity, specificity, precision, f1, mcc, auc FROM mm JOIN a USING (model)) ON sensitivity, specificity, precision, f1, mcc, auc INTO NAME metric VALUE value)
SELECT model, metric, round(value, 6) AS value, abs(value - max(value) OVER (PARTITION BY metric)) <= 1e-6 AS is_best FROM l""",
    "stream_window_rates": "SELECT time_bucket(INTERVAL 7 DAY, extracted_at, TIMESTAMP '1970-01-01') AS period_start, site, count(*) AS n_windows FROM windows WHERE extracted_at IS NOT NULL GROUP BY ALL",
    "stream_scores": f"""WITH {_WMM}, x AS (SELECT row_number() OVER () AS id, record_id, i, win, extracted_at, {STRIP} AS t FROM windows WHERE site = 'donor' AND regexp_full_match({STRIP}, '[ACGT]{{9}}'))
SELECT record_id, i, win, extracted_at, round(sum(log_odds), 6) AS score FROM (SELECT *, unnest(range(1, 10)) AS q FROM x) JOIN lo ON lo.pos = q - 1 AND lo.base = substring(t, q::INTEGER, 1) GROUP BY id, record_id, i, win, extracted_at""",
}
