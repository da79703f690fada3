import random

from exonloom import runtime
from exonloom.llm import crosssplit
from tests.conftest import rows


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (x != y)))
        prev = cur
    return prev[-1]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        p = rng.randrange(len(s) + 1)
        op = rng.choice("idr")
        if op == "i":
            s.insert(p, rng.choice("ACGTN"))
        elif s and p < len(s):
            s[p : p + 1] = [] if op == "d" else [rng.choice("ACGTN")]
    return "".join(s)


def data(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.choice([61, 61, 61, 58, 50, 44, 30, 12, 6, 4, 2]))) for _ in range(60)] + ["A" * 61, "AC" * 30, "ACG" * 20]
    out = []
    for i in range(400):
        s = edited(rng, rng.choice(base), rng.randint(0, 5))
        out.append((i, rng.choice(["train", "test"]), rng.choice([0, 1]), rng.choice([s, s.lower(), f" {s}\t"]), rng.choice(["a", None])))
    return out + [(900, "train", 1, None, "a"), (901, "test", 1, "  ", "a"), (902, "test", 1, "", "a"), (903, "train", 0, "é" * 61, None), (904, "test", 0, "é" * 60 + "ü", None), *out[:5]]


def test_against_brute_force(spark):
    d = data(1)
    df = spark.createDataFrame([(*x, "t", 0) for x in d], "sample_id long, split string, label int, win string, source string, text string, n int")
    txt = {i: (s, (w or "").strip().upper()) for i, s, _, w, _ in d}
    want = sorted(((i, j, lev(a, b)) for i, (s, a) in txt.items() if s == "train" and a for j, (t, b) in txt.items() if t == "test" and b and abs(len(a) - len(b)) <= 4 and lev(a, b) <= 4), key=repr)
    assert len(want) > 100
    assert rows(crosssplit.overlaps(df)) == want


def test_report_counts_what_the_pairs_say(spark, monkeypatch):
    monkeypatch.setattr(runtime, "KEY_ROWS", 2)
    df = spark.createDataFrame(data(2), "sample_id long, split string, label int, win string, source string")
    pairs = crosssplit.overlaps(df).collect()
    who = {x[0]: (x[1], x[2], x[4]) for x in data(2)}
    want = {}
    for i, exact in [(p.train_id, p.distance == 0) for p in pairs] + [(p.test_id, p.distance == 0) for p in pairs]:
        n = want.setdefault(who[i], [set(), 0, 0])
        n[0].add(i), n.__setitem__(1, n[1] + 1), n.__setitem__(2, n[2] + exact)
    assert rows(crosssplit.overlap_report(df)) == sorted(((*k, len(a), b, c) for k, (a, b, c) in want.items()), key=repr)


def test_report_and_empty(spark):
    df = spark.createDataFrame([(1, "train", 1, "ACGTACGTAC" * 6, "a"), (2, "test", 0, "ACGTACGTAC" * 6, None)], "sample_id long, split string, label int, win string, source string")
    assert rows(crosssplit.overlap_report(df)) == [("test", 0, None, 1, 1, 1), ("train", 1, "a", 1, 1, 1)]
    for part in (df.limit(0), df.where("split = 'train'")):
        assert rows(crosssplit.overlaps(part)) == []
