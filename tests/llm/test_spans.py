import random
import re
from collections import defaultdict

import pytest

from exonloom.llm import bloom, spans
from tests.conftest import rows


def brute(data, n):
    seqs = {i: re.sub("[^A-Z]", "", (s or "").upper()) for i, s in data}
    at = defaultdict(set)
    for i, s in seqs.items():
        for k in range(len(s) - n + 1):
            at[s[k : k + n]].add(i)
    out = []
    for i, s in seqs.items():
        cur = None
        for k in range(len(s) - n + 1):
            w = s[k : k + n]
            if len(at[w]) > 1 and set(w) <= set("ACGT"):
                if cur and k <= cur[1]:
                    cur[1] = k + n
                else:
                    out += [cur] if cur else []
                    cur = [k, k + n]
        out += [cur] if cur else []
        out = [(x if isinstance(x, tuple) else (i, x[0] + 1, x[1])) for x in out]
    return sorted(out, key=repr)


def family(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(4)]
    data = []
    for i in range(n):
        b = rng.choice(base)
        a, z = sorted(rng.sample(range(300), 2))
        s = b[a:z] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 60))) + rng.choice(["", "N", "A" * 70, b[z:]])
        data.append((i, rng.choice([s, s.lower(), "\n".join(s[k : k + 50] for k in range(0, len(s), 50))])))
    return data + [(100, None), (101, ""), (102, "ACGT"), (103, data[0][1]), (104, data[0][1])]


@pytest.mark.parametrize("length", [50, 21, 65, 100])
def test_against_brute_force(spark, length, monkeypatch):
    if length == 21:
        monkeypatch.setattr(bloom, "BITS", (6, 8))  # a full filter
    data = family(length)
    df = spark.createDataFrame([(i, s, 1) for i, s in data], "record_id long, seq string, rep int")
    assert rows(spans.shared_spans(df, length)) == brute(data, length)


def test_amount(spark):
    s = "ACGTTGCAAC" * 8
    df = spark.createDataFrame([(1, s), (2, s), (3, "A" * 90), (4, None)], "record_id long, seq string")
    got = {r.record_id: (r.n_symbols, r.n_shared) for r in spans.shared_amount(df, spans.shared_spans(df)).collect()}
    assert got == {1: (80, 80), 2: (80, 80), 3: (90, 0)}


def test_repeat_within_one_record_is_not_shared(spark):
    s = "".join(random.Random(5).choice("ACGT") for _ in range(60))
    df = spark.createDataFrame([(1, s + "N" + s), (1, s + "N" + s), (2, "ACGT" * 30)], "record_id long, seq string")
    assert rows(spans.shared_spans(df)) == []


def test_empty_and_bad_length(spark):
    df = spark.createDataFrame([], "record_id long, seq string")
    assert rows(spans.shared_spans(df)) == []
    with pytest.raises(ValueError):
        spans.shared_spans(df, 1)
