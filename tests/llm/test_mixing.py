import random

from pyspark.sql import functions as F

from exonloom.llm import mixing
from tests.conftest import rows

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.1, 2), ("d", None, 1), (None, 0.5, 1)]
SCHEMA = "source string, target_share double, max_repeats int"


def docs(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("aaaaaabbcd") if i % 50 else None, " ".join(rng.choice(["fix", "the", "x1", "merge"]) for _ in range(rng.randint(1, 60)))) for i in range(600)]
    return spark.createDataFrame([*data, (900, "a", None), (901, "a", ""), (902, "c", "word " * 500)], "doc_id long, source string, text string").withColumn("key", F.lit("clash")).withColumn("w", F.lit(1))


def test_shares_and_caps(spark):
    used, shares = mixing.mix(docs(spark), spark.createDataFrame(TARGETS, SCHEMA))
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"a", "b", "c", "d", "gone"}
    for k, want in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(s[k].actual_share - want) < 0.02 and s[k].most_uses <= s[k].max_repeats
    assert s["gone"].mixed_tokens == 0 and s["d"].mixed_tokens == 0
    u = used.collect()
    assert len({r.doc_id for r in u}) == len(u) and not {900, 901} & {r.doc_id for r in u}
    for k in "abc":
        n = {r.n_uses for r in u if r.source == k}
        assert max(n) - min(n) <= 1  # whole passes come first
    assert rows(used) == rows(mixing.mix(docs(spark), spark.createDataFrame(TARGETS, SCHEMA))[0])


def test_given_total_and_brute_force_order(spark):
    d, t = docs(spark), spark.createDataFrame([("a", 1.0, 2)], SCHEMA)
    counts = {r.doc_id: r.n_tokens for r in mixing.token_counts(d.where("source = 'a'").select("doc_id", "text")).collect()}
    total = sum(counts.values())
    used = {r.doc_id: r.n_uses for r in mixing.mix(d, t, total_tokens=int(total * 1.4))[0].collect()}
    key = {r.doc_id: r.k for r in d.where("source = 'a'").select("doc_id", (-F.ln((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11) + 0.5) / float(1 << 53)) / mixing.quality(F.col("text"))).alias("k")).collect()}
    left, want = int(total * 1.4) - total, {}
    cum = 0
    for i in sorted((i for i in counts if counts[i]), key=lambda i: (key[i], i)):
        want[i] = 1 + (cum + counts[i] / 2 <= left)
        cum += counts[i]
    assert used == want
    capped = {r.source: r for r in mixing.mix(d, t, total_tokens=total * 9)[1].collect()}
    assert capped["a"].mixed_tokens == 2 * total and capped["a"].most_uses == 2


def test_empty(spark):
    d, t = docs(spark), spark.createDataFrame(TARGETS, SCHEMA)
    assert rows(mixing.mix(d.limit(0), t)[0]) == []
    used, shares = mixing.mix(d, t.limit(0))
    assert rows(used) == [] and all(r.mixed_tokens == 0 for r in shares.collect())
