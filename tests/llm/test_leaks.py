import random
import re

import pytest

from exonloom import runtime
from exonloom.llm import bloom, leaks
from tests.conftest import rows

W = lambda s: re.findall("[a-z0-9]+", (s or "").lower())


def make():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 13, 14, 60])))) for i in range(30)]
    items += [(40, items[4][1] + " tail " + items[5][1]), (41, None), (42, ""), (43, "a b " * 20)]
    docs = []
    for i in range(200):
        w = [word() for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            t = W(rng.choice(items)[1])
            n = rng.randint(1, max(1, len(t)))
            at = rng.randrange(max(1, len(t) - n + 1))
            cut = t[at : at + n]
            if rng.random() < 0.3 and cut:
                cut[rng.randrange(len(cut))] = "zzz"
            w[len(w) // 2 : len(w) // 2] = cut
        docs.append((i, rng.choice([" ", "\n+", "_", "--", "é"]).join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    return docs + [(900, None), (901, ""), (902, "Kelvin"), (903, "a b " * 30)], items


def brute(docs, items):
    out = set()
    for i, d in docs:
        w = W(d)
        have = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for j, t in items:
            u = W(t)
            if any(tuple(u[k : k + 13]) in have for k in range(len(u) - 12)):
                out.add((i, j))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "s", "clash") for d in docs], "doc_id long, text string, source string, item_id string"), spark.createDataFrame([(*t, "x", "test") for t in items], "item_id long, text string, suite string, eval_split string")


def test_against_brute_force(spark, monkeypatch):
    docs, items = make()
    d, t = frames(spark, docs + docs[:3], items + items[:3])
    want = brute(docs, items)
    assert len(want) > 30
    assert rows(leaks.leaks(d, t).select("doc_id", "item_id")) == want
    monkeypatch.setattr(bloom, "BITS", (6, 8))  # a filter that lets everything through
    monkeypatch.setattr(runtime, "KEY_ROWS", 2)  # most hashes are hot
    assert rows(leaks.leaks(d, t).select("doc_id", "item_id")) == want


def test_substitution_is_tolerated(spark):
    t = [f"w{i}" for i in range(30)]
    for hit in range(30):
        changed = [*t[:hit], "other", *t[hit + 1 :]]
        d, i = frames(spark, [(1, " ".join(changed))], [(7, " ".join(t))]) if hit in (0, 5, 15, 29) else (None, None)
        if d is not None:
            got = leaks.leaks(d, i, tolerant_words=25).collect()
            assert [(r.doc_id, r.item_id, r.tolerant_words) for r in got] == [(1, 7, 29)]


def test_report_and_empty(spark):
    docs, items = make()
    d, t = frames(spark, docs, items)
    got = {r.item_id: r.n_docs for r in leaks.leaked_items(d, t).collect()}
    want = brute(docs, items)
    assert set(got) == {i for i, _ in items} and all(got[j] == sum(x[1] == j for x in want) for j in got)
    assert rows(leaks.leaks(d.limit(0), t)) == [] and rows(leaks.leaks(d, t.limit(0))) == []
    with pytest.raises(ValueError):
        leaks.leaks(d, t, min_words=5)


def brute_tolerant(docs, items, least):
    """Longest run and best stretch over all ways to lay a document beside an item, for pairs that reach `least`."""
    out = []
    for i, d in docs:
        for j, t in items:
            w, u, best = W(d), W(t), (0, 0)
            for k in range(-len(u), len(w)):
                run = loose = missed = 0
                for a in range(max(0, k), min(len(w), k + len(u))):
                    if w[a] == u[a - k]:
                        run, loose, missed = run + 1, loose + 1, 0
                    else:
                        run, missed = 0, missed + 1
                        loose = loose if missed < 2 else 0
                    best = max(best[0], run), max(best[1], loose)
            if best[1] >= least:
                out.append((i, j, best[1]))
    return sorted(out, key=repr)


def test_substitutions_at_any_spacing(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(70))) for i in range(12)]
    docs = []
    for i, (_, t) in enumerate(items):
        for every in range(2, 8):
            docs.append((100 * i + every, "x " * rng.randint(0, 9) + " ".join("zz" if k % every == 1 else w for k, w in enumerate(W(t)))))
        w = W(t)[:60]
        for k in range(1, 60):
            if w[k - 1] != "zz" and rng.random() < 0.5:
                w[k] = "zz"
        docs.append((100 * i + 10, " ".join(w)))
        docs.append((100 * i + 11, " ".join("zz" if k % 3 else x for k, x in enumerate(W(t)))))  # two in a row
    d, t = frames(spark, docs, items)
    for least in (20, 5, 2):
        want = brute_tolerant(docs, items, least)
        assert {x[0] % 100 for x in want} >= set(range(2, 8))
        assert rows(leaks.leaks(d, t, tolerant_words=least).select("doc_id", "item_id", "tolerant_words")) == want


def test_masks_hit_every_sequence_of_steps():
    for least in (1, 2, 3, 4, 12, 13, 20):
        kept = ["".join(map(str, m[1:] - m[:-1])) for m in leaks.masks(least)]
        n = min(least, 13) - 1
        for code in range(1 << n):
            steps = "".join("12"[code >> k & 1] for k in range(n))
            assert any(g in steps for g in kept)


def test_one_id_with_several_texts(spark):
    docs, items = make()
    t = [(1, items[i][1]) for i in (4, 5, 9)] + [(2, items[4][1])]
    d, i = frames(spark, docs, t)
    assert rows(leaks.leaks(d, i).select("doc_id", "item_id")) == brute(docs, t)
