import random

import pytest

from exonloom.operators import features, svm
from exonloom.plans import learning


@pytest.fixture(scope="module")
def strict(spark):
    rng = random.Random(3)
    rows = {}
    while len(rows) < 160:
        label = len(rows) % 2
        w = "".join(rng.choice("AAACGT" if label else "ACGT") for _ in range(9))
        rows.setdefault((w[0] if label else w[2]) + w[1:3] + "GT" + w[5:], ("test" if len(rows) % 5 == 0 else "train", label))
    return spark.createDataFrame([(s, y, w) for w, (s, y) in rows.items()], "split string, label int, w string").cache()


@pytest.fixture
def solved(strict, monkeypatch):
    """Training and test rows that the query gives to kernel_scores."""
    seen, plain = [], svm.kernel_scores
    monkeypatch.setattr(learning, "_strict", lambda spark, sf_dir: strict)
    monkeypatch.setattr(svm, "kernel_scores", lambda train, test, *a: seen.append((train, test)) or plain(train, test, *a))
    return seen


def _features(df):
    return {(r.label, r.w): [round(x, 9) for x in r.features] for r in df.select("label", "w", "features").collect()}


def test_cross_validation_uses_all_features(spark, strict, solved):
    got = learning.cross_validation(spark, "").first()
    assert got.n_folds == 5 and 0 <= got.auc_mean <= 1
    (train, test), = solved
    fold = train.where("grp = '3'")
    ex = features.FeatureExtractor(9).fit(fold.select("label", "w"))
    assert _features(fold) == _features(ex.transform(fold.select("label", "w")))
    held = test.where("grp = '3'")
    assert _features(held) == _features(ex.transform(held.select("label", "w")))
    assert fold.join(held, "w").count() == 0 and fold.count() + held.count() == strict.where("split = 'train'").count()
    assert test.count() == strict.where("split = 'train'").count()


def test_four_way_comparison_uses_all_features(spark, strict, solved, monkeypatch):
    linear, plain = [], svm.LinearModel.score_rows
    monkeypatch.setattr(svm.LinearModel, "score_rows", lambda self, df: linear.append(self) or plain(self, df))
    got = learning.four_way_comparison(spark, "").collect()
    assert {r.model for r in got} == {"WMM", "WAM", "BN ebn", "SVM linear", "SVM rbf"}
    (train, test), = solved
    names = features.FeatureExtractor(9).fit(strict.where("split = 'train'")).feature_names
    assert {len(r.features) for r in train.unionByName(test).collect()} == {len(names)} == {len(linear[0].weights)}
    assert any(n.startswith("chi2_pair") for n in names) and train.count() + test.count() == strict.count()
