import random
import time

import pytest
from pyspark.sql import functions as F

from exonloom.operators import split, windows
from exonloom.operators.ranking import hash_rank, running_totals
from exonloom.spec import ACCEPTOR, DONOR, site
from tests.conftest import rows


def _seqs(spark, data):
    return spark.createDataFrame(data, "record_id long, s string, ranges array<struct<range_start:int,range_end:int>>")


def test_short_null_and_empty_sequences(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", None), (3, "acgt", None), (4, "nnnn", None), (5, "A" * 20, None)], "record_id long, seq string, ranges array<struct<range_start:int,range_end:int>>")
    s = windows.sequences(df, "record_id")
    assert {x.record_id for x in s.collect()} == {3, 5}
    assert rows(windows.all_windows(s, "record_id", 9).groupBy("record_id").count()) == [(5, 12)]
    assert windows.canonical_windows(s, "record_id", DONOR).count() == 0


def test_canonical_against_brute_force(spark):
    rng = random.Random(1)
    data = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(5, 120))), None) for i in range(30)]
    for spec in (DONOR, ACCEPTOR):
        want = sorted((i, k, s[k : k + spec.window]) for i, s, _ in data for k in range(len(s) - spec.window + 1) if s[k + spec.offset : k + spec.offset + 2] == spec.motif)
        assert sorted(tuple(x) for x in windows.canonical_windows(_seqs(spark, data), "record_id", spec).collect()) == want


def test_interval_windows(spark):
    s = "CAGGTAAGTCCCCCCCCCCCCCCCCCCCCAGG"
    data = [(1, s, [(1, 3)]), (2, s, [(1, 2)]), (3, s, [(30, 31)]), (4, s, None), (5, s, [(32, 40)]), (6, "GTAAGTCCC", [(0, 0)])]
    got = rows(windows.interval_windows(_seqs(spark, data), "record_id", DONOR))
    assert got == [(1, 3, "CAGGTAAGT")]
    acc = rows(windows.interval_windows(_seqs(spark, data), "record_id", ACCEPTOR))
    assert acc == [(5, 29, s[9:32])]


def test_validation_and_site():
    assert site("donor") is DONOR
    with pytest.raises(ValueError):
        site("other")


def test_validated(spark):
    df = spark.createDataFrame([(" acgtacgta ",), ("ACGTACGT",), ("ACGTACGTAC",), ("ACGTNCGTA",), (None,)], "win string")
    assert rows(windows.validated(df, DONOR)) == [("ACGTACGTA",)]


def test_strict_split_against_sets(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("AC") for _ in range(9)) for _ in range(60)]
    data = [(i, rng.choice(["train", "test"]), rng.choice([0, 1]), "donor", rng.choice(pool)) for i in range(300)] + [(901, "train", None, "donor", pool[0]), (902, "train", 1, "donor", None)]
    df = spark.createDataFrame(data, "sample_id long, split string, label int, site string, win string")
    side = lambda s, k: {w for _, sp, lb, _, w in data if sp == s and lb == k and w}
    tp = side("train", 1)
    qp = side("test", 1) - tp
    tn = side("train", 0) - tp
    qn = side("test", 0) - tp - qp - tn
    want = {("train", 1, w) for w in tp} | {("test", 1, w) for w in qp} | {("train", 0, w) for w in tn} | {("test", 0, w) for w in qn}
    s = split.strict_split(split.labelled_windows(df, DONOR))
    assert {tuple(x) for x in s.select("split", "label", "w").collect()} == want
    b = split.balanced(s).groupBy("split").pivot("label", [0, 1]).count().collect()
    assert all(r["0"] == r["1"] for r in b)


def test_folds(spark):
    s = spark.createDataFrame([(i % 2, f"w{i}") for i in range(41)], "label int, w string")
    n = split.folds(s, 5).groupBy("label", "fold").count().collect()
    assert len(n) == 10 and max(r["count"] for r in n) - min(r["count"] for r in n) <= 1
    with pytest.raises(ValueError):
        split.folds(s.limit(3), 5)


def test_empty_side_raises(spark):
    s = spark.createDataFrame([("train", 1, "A")], "split string, label int, w string")
    with pytest.raises(RuntimeError):
        split.require_sides(s)


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    got = hash_rank(df, ["g"], "k").collect()
    for g in range(3):
        part = sorted((r.k, r["rank"]) for r in got if r.g == g)
        assert [x[1] for x in part] == list(range(1, len(part) + 1))


def test_running_totals_with_infinities(spark):
    data = [("a", float("-inf"), 1), ("a", 0.5, 2), ("a", 0.25, 4), ("a", float("inf"), 8), ("b", 1.0, 3)]
    df = spark.createDataFrame(data, "m string, x double, v long")
    got = {(r.m, r.x): r.cum_v for r in running_totals(df, "m", "x", ["v"]).collect()}
    assert got == {("a", float("inf")): 8, ("a", 0.5): 10, ("a", 0.25): 14, ("a", float("-inf")): 15, ("b", 1.0): 3}


def test_sampled_negatives(spark):
    w = spark.createDataFrame([("A",), ("B",), ("B",), ("C",)], "win string")
    x = spark.createDataFrame([("A",)], "win string")
    assert {r.win for r in split.sampled_negatives(w, x, 2).collect()} == {"B", "C"}
    with pytest.raises(RuntimeError):
        split.sampled_negatives(w, x, 3)


def test_long_sequences_are_spread_and_keep_their_context(spark, monkeypatch):
    rng = random.Random(7)
    data = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, 8, 9, 10, 63, 64, 65, 300, 1000, 1003))]
    df = spark.createDataFrame(data, "record_id long, s string")
    want = sorted((i, k, s[k : k + 9], s[max(0, k - 2) : k + 3 + 11]) for i, s in data for k in range(len(s) - 8) if s[k + 3 : k + 5] == "GT")
    for chunk, long in ((1 << 16, 1 << 20), (16, 200), (7, 10)):
        monkeypatch.setattr(windows, "CHUNK", chunk)
        monkeypatch.setattr(windows, "LONG", long)
        assert sorted(tuple(x) for x in windows.canonical_windows(df, "record_id", DONOR, (5, 11)).collect()) == want
        assert windows.all_windows(df, "record_id", 9).count() == sum(max(0, len(s) - 8) for _, s in data)


def test_work_is_linear_in_the_symbols(spark):
    took = {}
    for n in (1_000_000, 10_000_000):
        s = windows.sequences(spark.range(1).select("id", F.expr(f"repeat('ACGTTGACGG', {n // 10})").alias("seq")), "id")
        began = time.time()
        assert windows.canonical_windows(s, "id", DONOR).count() == n // 10 - 1
        took[n] = time.time() - began
    assert took[10_000_000] < min(20, 20 * took[1_000_000] + 5)
