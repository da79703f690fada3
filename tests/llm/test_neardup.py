import random
import re

import pytest

from exonloom.llm import neardup
from tests.conftest import rows


def brute(data, k, t):
    g = {}
    for i, s in data:
        c = re.sub("[^A-Z]", "", (s or "").upper())
        g[i] = {c[j : j + k] for j in range(len(c) - k + 1)}
    ids = sorted(i for i in g if g[i])
    return sorted(((a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(g[a] & g[b]) >= t * len(g[a] | g[b]) - 1e-12), key=repr)


def make(seed, n=60):
    rng = random.Random(seed)
    dna = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
    base = [dna(rng.choice([15, 40, 130, 400, 900])) for _ in range(12)]
    data = []
    for i in range(n):
        s = rng.choice(base)
        for _ in range(rng.randint(0, max(1, len(s) // 40))):
            p = rng.randrange(len(s))
            s = rng.choice([s[:p] + rng.choice("ACGTN") + s[p + 1 :], s[:p] + s[p + 1 :] or "A", s[p:] + s[:p], s + dna(len(s) // 10), s[len(s) // 10 :]])
        data.append((i, rng.choice([s, s.lower(), s[:9] + "\n" + s[9:]])))
    return data + [(100, None), (101, ""), (102, "ACGT"), (103, "ACGT"), (104, "A" * 500), (105, "A" * 300), (106, "AC" * 200), (107, data[0][1]), (108, data[0][1])]


@pytest.mark.parametrize("seed,k,t", [(1, 12, 0.6), (2, 12, 0.8), (3, 5, 0.55), (4, 12, 1.0)])
def test_against_brute_force(spark, seed, k, t, monkeypatch):
    if seed == 2:  # heavy grams, small steps
        for name, value in (("HEAVY", 3), ("ROWS", 50), ("PAIRS", 7)):
            monkeypatch.setattr(neardup, name, value)
    data = make(seed)
    df = spark.createDataFrame([(i, s, "clash") for i, s in data], "record_id long, seq string, node string")
    want = brute(data, k, t)
    assert len(want) > 5
    assert rows(neardup.record_pairs(df, k, t)) == want


def test_groups(spark):
    data = make(5)
    df = spark.createDataFrame(data, "record_id long, seq string")
    want = brute(data, 12, 0.6)
    parent = {i: i for i, s in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    same = {}
    for i, s in data:
        same.setdefault(re.sub("[^A-Z]", "", (s or "").upper()), []).append(i)
    got = {r.record_id: r for r in neardup.near_groups(df).collect()}
    assert set(got) == {i for c, v in same.items() if c for i in v}
    for c, v in same.items():
        for i in v if c else []:
            assert got[i].class_id == min(v) and got[i].n_copies == len(v)
            if len(c) >= 12:
                assert got[i].group_id == find(i)


def test_bad_parameters_and_empty(spark):
    df = spark.createDataFrame([], "record_id long, seq string")
    with pytest.raises(ValueError):
        neardup.record_pairs(df, 12, 0.4)
    assert rows(neardup.record_pairs(df)) == [] and rows(neardup.near_groups(df)) == []
