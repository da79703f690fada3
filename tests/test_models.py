import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exonloom import cli
from exonloom.operators import evaluate, features, models, scorers, stats, svm
from exonloom.operators.scan import scan, scan_sequence
from exonloom.operators.windows import sequences
from exonloom.sources import synthetic
from exonloom.sources.store import load_model, save_model
from exonloom.spec import DONOR

B = "ACGT"
rng = random.Random(7)


def _win(bias):
    s = [rng.choice("AAACGT" if bias else "ACGT") for _ in range(9)]
    s[3:5] = "GT"
    if bias and rng.random() < 0.7:
        s[2] = s[0]
    return "".join(s)


POS, NEG = [_win(True) for _ in range(120)], [_win(False) for _ in range(150)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([(1, w) for w in POS] + [(0, w) for w in NEG], "label int, w string").cache()


def _scores(spark, ws, score):
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    return {r.w: r.s for r in df.select("w", score(F.col("w")).alias("s")).collect()}


def test_wmm_and_wam(spark, train):
    bg = {b: sum(w.count(b) for w in NEG) / sum(map(len, NEG)) for b in B}
    p = [{b: (sum(w[i] == b for w in POS) + 0.5) / (len(POS) + 2) for b in B} for i in range(9)]
    t = models.wmm_table(train, 9)
    got = _scores(spark, NEG, lambda w: models.wmm_score(w, t))
    for w in NEG:
        assert got[w] == pytest.approx(sum(math.log(p[i][c] / max(bg[c], 1e-9)) for i, c in enumerate(w)))
    cond = lambda i, a, b: (sum(w[i - 1] == a and w[i] == b for w in POS) + 0.5) / (sum(w[i - 1] == a for w in POS) + 2)
    tables = models.wam_tables(train, 9)
    got = _scores(spark, NEG[:20], lambda w: models.wam_score(w, tables))
    for w in NEG[:20]:
        assert got[w] == pytest.approx(math.log(p[0][w[0]] / bg[w[0]]) + sum(math.log(cond(i, w[i - 1], w[i]) / bg[w[i]]) for i in range(1, 9)))


def _chi2(i, j):
    n = len(POS)
    total = 0.0
    for a in B:
        for b in B:
            e = sum(w[i] == a for w in POS) * sum(w[j] == b for w in POS) / n
            if e > 1e-12:
                total += (sum(w[i] == a and w[j] == b for w in POS) - e) ** 2 / e
    return total


def test_chi2_and_networks(spark, train):
    chi = {(r.i, r.j): r.score for r in stats.chi2_pairs(stats.pair_counts(train.where("label = 1").select("w"), 9)).collect()}
    for (i, j), v in chi.items():
        assert v == pytest.approx(_chi2(i, j), abs=1e-6)
    for structure in ("chain", "chow-liu", "ebn", [-1, 0, 0, 1, 1, 2, 2, 3, 3]):
        m = models.Network(9, structure).fit(train)
        lap, full = (1.0, False) if structure == "ebn" else (0.5, True)

        def lp(w, data):
            out = 0.0
            for node, ps in enumerate(m.parents):
                same = [x for x in data if all(x[q] == w[q] for q in ps)]
                v = (sum(x[node] == w[node] for x in same) + lap) / (len(same) + 4 * lap) if same or full else 0.25
                out += math.log(max(v, 1e-10))
            return out

        got = _scores(spark, NEG[:25], m.score)
        for w in NEG[:25]:
            assert got[w] == pytest.approx(lp(w, POS) - lp(w, NEG))
        assert len([p for ps in m.parents for p in ps]) >= 8


def test_ebn_isolated_node_and_ties(spark):
    chi = spark.createDataFrame([(0, 1, 9.0), (0, 2, 1.0), (1, 2, 1.0), (0, 3, 0.0), (1, 3, 0.0), (2, 3, 2.0)], "i int, j int, score double")
    assert models.ebn_parents(chi, 4) == [[], [0], [0, 1], [2, 0]]


def test_dependency_fallback(spark):
    chi = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 2.0)], "i int, j int, score double")
    assert [(r.i, r.j) for r in stats.dependency_pairs(chi, 6.0, 2).orderBy("rank").collect()] == [(0, 2), (1, 2)]


def test_errors(spark, train):
    for bad, error in (("other", ValueError), ("greedy-bic", NotImplementedError)):
        with pytest.raises(error):
            models.Network(9, bad)
    with pytest.raises(RuntimeError):
        models.Network(9).score(F.col("w"))
    with pytest.raises(ValueError):
        models.wam_tables(train.where("label = 0"), 9)
    with pytest.raises(ValueError):
        features.FeatureExtractor(9, "nothing")
    with pytest.raises(RuntimeError):
        features.FeatureExtractor(9).array(F.col("w"))
    with pytest.raises(ValueError):
        features.FeatureExtractor(9, "ebn_llr").fit(train.where("label = 1"))
    with pytest.raises(ValueError):
        svm.Config("x", "other")


def test_features(spark, train):
    ex = features.FeatureExtractor(9).fit(train)
    names = ex.feature_names
    assert len(names) == 254 + 16 * len(ex.pairs) == ex.feature_dim
    row = ex.transform(spark.createDataFrame([("AACGTACGT",)], "w string")).first()
    f = dict(zip(names, row.features))
    assert f["oh_pos0_A"] == 1 and f["oh_pos0_C"] == 0 and f["k2_AC"] == pytest.approx(2 / 8) and f["dn_pos1_AC"] == 1
    assert f["ebn_llr_false_vs_true"] == pytest.approx(-_scores(spark, ["AACGTACGT"], ex.network.score)["AACGTACGT"])


def test_background_without_symbols(spark):
    df = spark.createDataFrame([], "w string")
    assert {r.freq for r in stats.background(df).collect()} == {0.25}


def test_scan(spark, train):
    t = models.wmm_table(train, 9)
    hits = scan_sequence(spark, "gtgagtggta", DONOR, lambda w: models.wmm_score(w, t), -50.0).collect()
    assert [(h.pos, h.win) for h in hits] == [(4, "TGAGTGGTA")]
    s = spark.createDataFrame([(1, "GTGANTGGTAGTGAGTGGTA"), (2, "GT")], "seq_id long, s string")
    assert {r.pos for r in scan(s, "seq_id", DONOR, lambda w: models.wmm_score(w, t), -50.0).collect()} == {10, 14}


def _auc(data):
    p, n = [s for y, s in data if y], [s for y, s in data if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def test_auc_and_metrics(spark):
    data = [(rng.randint(0, 1), round(rng.gauss(0, 1), 1)) for _ in range(300)] + [(0, float("-inf")), (1, float("-inf"))]
    df = spark.createDataFrame([("m", y, s) for y, s in data] + [("m", None, 1.0), ("m", 1, None), ("m", 1, float("nan"))], "model_name string, label int, score double")
    u = evaluate.usable(df)
    assert evaluate.roc_auc(u).first().auc == pytest.approx(_auc(data))
    c = evaluate.confusion(u, 0.3).first()
    assert (c.tp, c.fp) == (sum(y and s >= 0.3 for y, s in data), sum((not y) and s >= 0.3 for y, s in data))
    pts = evaluate.roc_curve(u).orderBy("idx").collect()
    assert (pts[0].fpr, pts[-1].tpr) == (0.0, 1.0) and [p.idx for p in pts] == list(range(len(pts)))
    assert evaluate.auc_of_curve(evaluate.roc_curve(u)).first().auc == pytest.approx(_auc(data))


def test_roc_steps_and_single_class(spark):
    df = spark.createDataFrame([("m", i % 2, float(i)) for i in range(1000)], "model_name string, label int, score double")
    assert evaluate.roc_curve(evaluate.usable(df)).count() == 200 + 1 + 2
    one = evaluate.usable(df.where("label = 1"))
    assert evaluate.roc_auc(one).first().auc is None
    assert evaluate.confusion(one.withColumn("score", F.lit(-1.0))).first().mcc == 0.0


def test_dual_solver_separates():
    import numpy as np

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(-2, 1, (40, 2)), r.normal(2, 1, (60, 2))])
    y = np.array([-1.0] * 40 + [1.0] * 60)
    c = svm.balanced_cost(y, 1.0)
    for kernel in ("linear", "rbf", "poly"):
        k = svm.kernel_matrix(x, x, kernel, 0.5, 3)
        alpha, bias, converged = svm.solve_dual(k, y, c)
        assert converged
        s = k @ (alpha * y) + bias
        assert abs((alpha * y).sum()) < 1e-6 and (alpha >= -1e-9).all() and (alpha <= c + 1e-9).all()
        assert (np.sign(s) == y).mean() > 0.95
        free = (alpha > 1e-6) & (alpha < c - 1e-6)
        assert np.allclose((y * s)[free], 1, atol=5e-3)
    a, _ = svm.fit_sigmoid(s, y)
    assert a < 0


def test_linear_model(spark, train):
    m = svm.LinearModel(DONOR, ["one_hot", "pwm"]).fit(train)
    s = m.transform(train).select("label", "score").collect()
    assert _auc([(r.label, r.score) for r in s]) > 0.7
    assert m.top_features(spark, 5).count() == 5 and m.diagnostics(spark).first().weight_norm > 0
    with pytest.raises(RuntimeError):
        svm.LinearModel(DONOR).transform(train)


def test_kernel_scores_by_group(spark, train):
    ex = features.FeatureExtractor(9, ["one_hot"]).fit(train)
    d = ex.transform(train).withColumn("grp", F.lit("a"))
    d = d.unionByName(d.withColumn("grp", F.lit("b")))
    got = svm.kernel_scores(d, d, [svm.Config("rbf"), svm.Config("lin", "linear")], max_rows=200)
    assert got.groupBy("model", "grp").count().count() == 4
    r = got.where("model = 'rbf' and grp = 'a'").collect()
    assert _auc([(x.label, x.score) for x in r]) > 0.8 and all(0 <= x.proba <= 1 for x in r)


def test_store(spark, train, tmp_path):
    t = models.wmm_table(train, 9)
    save_model(spark, str(tmp_path / "m"), "wmm", {"window": 9}, {"table": t})
    kind, params, tables = load_model(spark, str(tmp_path / "m"), "wmm")
    assert (kind, params) == ("wmm", {"window": 9}) and tables["table"].count() == 36
    with pytest.raises(TypeError):
        load_model(spark, str(tmp_path / "m"), "svm")
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))


def test_every_kind_is_stored_and_scores_alike(spark, train, tmp_path):
    w = spark.createDataFrame([(r.w,) for r in train.select("w").distinct().limit(40).collect()] + [(None,), ("ACG",)], "w string")
    for kind in scorers.KINDS:
        if kind in ("svm-poly", "svm-sigmoid"):
            continue
        m = scorers.fit(kind, train, DONOR, feature_set=("one_hot", "kmer2", "pwm", "chi2_pairs", "ebn_llr"))
        m.save(spark, str(tmp_path / kind))
        back = scorers.load(spark, str(tmp_path / kind))
        got = w.select("w", m.score(F.col("w")).alias("a"), back.score(F.col("w")).alias("b")).collect()
        assert all((r.a is None or math.isnan(r.a)) == (r.w in (None, "ACG")) for r in got), kind
        assert all(r.a is None or math.isnan(r.a) or abs(r.a - r.b) < 1e-9 for r in got), kind
    label = {r.w: r.label for r in train.where("label = 1").collect()}
    said = [(r.w in label, r.p, r.q) for r in w.where("length(w) = 9").select("w", back.predict(F.col("w")).alias("p"), back.probability(F.col("w")).alias("q")).collect()]
    assert {p for _, p, _ in said} <= {1, -1} and all(0 <= q <= 1 for _, _, q in said)
    with pytest.raises(ValueError):
        scorers.fit("other", train, DONOR)


def test_strict_lengths(spark, train):
    m = models.Network(9, "chain").fit(train)
    df = spark.createDataFrame([("ACG",), (None,)], "w string")
    assert [r.s for r in df.select(m.score(F.col("w")).alias("s")).collect()] == [None, None]
    with pytest.raises(Exception, match="window of 9 symbols"):
        df.select(m.score(F.col("w"), strict=True)).collect()


def test_precomputed_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = np.where(x[:, 0] + x[:, 1] > 0, 1.0, -1.0)
    coef, bias = svm.precomputed(x @ x.T, y)
    assert ((x @ x.T @ coef + bias > 0) == (y > 0)).mean() > 0.9
    with pytest.raises(ValueError):
        svm.precomputed(x, y)


def test_command_line(spark, tmp_path, capsys, sf):
    path, out = str(tmp_path / "model"), str(tmp_path / "hits")
    assert cli.main(["train", "--tables", sf, "--model", "wam", "--path", path]) == 0
    assert cli.main(["predict", "--path", path, "--predict", "CAGGTAAGTCAGGTAAGT", "--threshold", "-50"]) == 0
    assert capsys.readouterr().out.count("\t") >= 2
    assert cli.main(["scan", "--tables", sf, "--path", path, "--threshold", "0", "--out", out]) == 0
    m = scorers.load(spark, path)
    want = scan(sequences(spark.read.parquet(f"{sf}/gene_records.parquet"), "record_id"), "record_id", DONOR, m.score, 0.0).count()
    assert want > 50 and spark.read.option("header", True).option("sep", "\t").csv(out).count() == want
    with pytest.raises(ValueError):
        cli.gene_file_set(spark, DONOR, str(tmp_path), f"{tmp_path}/.")
    with pytest.raises(ValueError):
        cli.main(["scan", "--tables", sf, "--path", path, "--site", "acceptor"])


def test_gene_files(spark, tmp_path):
    rng = random.Random(8)
    for side in ("a", "b"):
        (tmp_path / side).mkdir()
        for k in range(6):
            s = "".join(rng.choice("ACGT") for _ in range(400))
            s = s[:100] + "GT" + s[102:]
            (tmp_path / side / f"{k}.txt").write_text(f">x\n>x(10..100,200..300)\n{s}\n")
    got = cli.gene_file_set(spark, DONOR, str(tmp_path / "a"), str(tmp_path / "b"))
    assert {(r.split, r.label) for r in got.select("split", "label").distinct().collect()} == {("train", 1), ("train", 0), ("test", 1), ("test", 0)}


def test_synthetic(spark):
    for label in (0, 1):
        w = [r.w for r in synthetic.windows(spark, DONOR, 1000, label, dependent=True).collect()]
        assert len(w) == 1000 and all(len(x) == 9 and x[3:5] == "GT" for x in w)
    assert all(r.w[3:5] != "GT" for r in synthetic.windows(spark, DONOR, 500, 0, reject=True).collect())
    purine, other = [x[2] == "G" for x in w if x[0] in "AG"], [x[2] == "G" for x in w if x[0] in "CT"]
    assert sum(purine) / len(purine) > 0.75 > 0.65 > sum(other) / len(other)
    after_a, rest = [x[8] == "T" for x in w if x[5] == "A"], [x[8] == "T" for x in w if x[5] != "A"]
    assert sum(after_a) / len(after_a) > 0.85 > 0.8 > sum(rest) / len(rest)


def test_plot(spark):
    from exonloom.operators.plot import roc_svg

    df = spark.createDataFrame([("m<", i % 2, float(i * 7 % 11)) for i in range(40)], "model_name string, label int, score double")
    u = evaluate.usable(df)
    svg = roc_svg(evaluate.roc_curve(u), evaluate.roc_auc(u))
    assert svg.startswith("<svg") and "m&lt;" in svg
