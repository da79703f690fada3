import random

import pytest

from exonloom import runtime
from exonloom.llm import splits
from exonloom.llm.forest import spanning_forest
from tests.conftest import rows


def components(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, g, s in data:
        find(("i", i))
        for k, v in (("g", g), ("s", s)):
            v = " ".join((v or "").upper().split())
            if v not in splits.STAND_INS:
                parent[find(("i", i))] = find((k, v))
    least = {}
    for i, _, _ in data:
        r = find(("i", i))
        least[r] = min(least.get(r, i), i)
    return sorted({(least[find(("i", i))], i) for i, _, _ in data}, key=repr)


def make(seed, n, genes):
    rng = random.Random(seed)
    name = lambda p, m: rng.choice([None, "", "n/a", "-", " Unknown ", "anonymous"]) if rng.random() < 0.2 else rng.choice(["{}{}", " {} {} ", "{}  {}"]).format(p, rng.randrange(m)).replace("  ", rng.choice([" ", "  "]))
    return [(i, name("g", genes), name("s", genes)) for i in range(1, n)]


def test_groups_against_union_find(spark):
    for seed, n, genes in ((1, 200, 150), (2, 200, 12), (3, 60, 400)):
        d = make(seed, n, genes)
        df = spark.createDataFrame([*d, *d[:7]], "sample_id long, gene string, submitter string")
        assert rows(splits.related_groups(df).select("group_id", "id")) == components(d)


def test_a_long_chain_and_a_hub(spark):
    chain = [(i, f"g{i}", f"s{i // 2}" if i % 2 else f"s{i // 2}") for i in range(1, 120)]
    chain = [(i, f"g{i // 2}", f"s{(i + 1) // 2}") for i in range(1, 120)]
    hub = [(1000 + i, "hub", f"h{i}") for i in range(150)]
    df = spark.createDataFrame(chain + hub, "sample_id long, gene string, submitter string")
    assert rows(splits.related_groups(df).select("group_id", "id")) == components(chain + hub)


def test_forest_is_a_minimum_spanning_forest(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(10)) for _ in range(120)] + [(1, 1, 0), (None, 2, 0)]
    forest, labels = spanning_forest(spark.createDataFrame(edges, "u int, v int, w int"))
    best = {}
    for u, v, w in edges:
        if u is not None and u != v:
            k = (min(u, v), max(u, v))
            best[k] = min(best.get(k, w), w)
    parent = {x: x for e in best for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for (u, v), w in sorted(best.items(), key=lambda x: (x[1], x[0])):
        if find(u) != find(v):
            parent[find(u)] = find(v)
            want.append((u, v, w))
    assert sorted(tuple(r) for r in forest.collect()) == sorted(want)
    root = {r.node: r.root for r in labels.collect()}
    assert all((root[a] == root[b]) == (find(a) == find(b)) for a in parent for b in parent)
    assert spanning_forest(spark.createDataFrame([], "u int, v int, w int"))[1].count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(9)
    d = [(i, f"g{int(rng.expovariate(0.004))}", None) for i in range(1, 4000)]
    df = spark.createDataFrame(d, "sample_id long, gene string, submitter string")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None)], "split string, target_share double")
    got = splits.assign(splits.related_groups(df), targets).cache()
    assert got.count() == 3999
    assert got.groupBy("group_id").agg({"split": "count"}).count() == got.select("group_id", "split").distinct().count()
    share = {r.split: r.actual_share for r in splits.split_report(got, targets).collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02 and share["none"] == 0


@pytest.mark.parametrize("n", [50, 5000])
def test_every_band_is_dealt_the_same_way(spark, n):
    rng = random.Random(n)
    sizes = [(i, max(1, int(rng.paretovariate(1.1)))) for i in range(n)]
    sizes[0] = (0, sum(x for _, x in sizes) // 2)  # a third of all rows in one group
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, target_share double")
    got = splits.deal_groups(spark.createDataFrame(sizes, "group_id long, n long"), targets).collect()
    assert sorted((r.group_id, r.n) for r in got) == sizes
    total, most = sum(x for _, x in sizes), sorted(x for _, x in sizes)[-2]
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r.n for r in got if r.split == name) - share * total) <= max(0.02 * total, most / 2)


def test_the_forest_is_kept_and_holds_the_groups(spark, tmp_path, monkeypatch):
    d = make(5, 300, 60)
    df = spark.createDataFrame(d, "sample_id long, gene string, submitter string")
    monkeypatch.setattr(runtime, "KEY_ROWS", 3)  # most roots are hot
    path = f"{tmp_path}/forest"
    assert rows(splits.related_groups(df, forest_path=path).select("group_id", "id")) == components(d)
    kept, roots = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/roots")
    assert kept.count() == roots.count() - roots.select("root").distinct().count()  # a forest over its nodes


def test_empty(spark):
    df = spark.createDataFrame([], "sample_id long, gene string, submitter string")
    targets = spark.createDataFrame([("train", 1.0)], "split string, target_share double")
    g = splits.related_groups(df)
    assert rows(g) == [] and rows(splits.assign(g, targets)) == []
    one = splits.related_groups(spark.createDataFrame([(1, None, None)], "sample_id long, gene string, submitter string"))
    assert rows(splits.assign(one, targets.limit(0))) == []
