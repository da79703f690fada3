import pytest
from pyspark.sql import functions as F

from exonloom.llm import queries as q
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_matches_sql(spark, sf, name):
    assert_same(spark, connect(sf), sf, q.QUERIES[name], q.ORACLE[name])


def _all(spark, sf, name):
    return q.QUERIES[name](spark, sf).collect()


def test_assignment_parts_no_group(spark, sf):
    got, found = _all(spark, sf, "p6_assignment"), _all(spark, sf, "p6_found")
    assert sorted((r.group_id, r.sample_id) for r in got) == sorted((r.group_id, r.sample_id) for r in found)
    assert len({(r.group_id, r.split) for r in got}) == len({r.group_id for r in got})
    report = {r.split: r for r in _all(spark, sf, "p6_split_report")}
    assert {s: r.n_samples for s, r in report.items()} == {s: sum(r.split == s for r in got) for s in report}
    assert all(abs(r.actual_share - r.target_share) < 0.1 for r in report.values())


def test_tolerant_leaks_hold_the_exact_ones(spark, sf):
    exact, loose = _all(spark, sf, "p7_found"), _all(spark, sf, "p7_tolerant")
    assert {(r.doc_id, r.item_id) for r in exact} == {(r.doc_id, r.item_id) for r in loose if r.exact_words >= 13}
    assert all(r.tolerant_words >= r.exact_words and (r.exact_words >= 13 or r.tolerant_words >= 20) for r in loose)


def test_mix_follows_its_plan(spark, sf):
    used, shares = _all(spark, sf, "p8_mixed_documents"), {r.source: r for r in _all(spark, sf, "p8_shares")}
    for s, r in shares.items():
        mine = [u for u in used if u.source == s]
        assert r.n_used == len(mine) and r.mixed_tokens == sum(u.n_tokens * u.n_uses for u in mine)
        assert all(1 <= u.n_uses <= r.max_repeats for u in mine) and max((u.n_uses for u in mine), default=0) - min((u.n_uses for u in mine), default=0) <= 1
    listed = [r for r in shares.values() if r.mixed_tokens]
    want = sum(r.target_share for r in listed)
    assert len(used) == len({u.doc_id for u in used}) and all(abs(r.actual_share - r.target_share / want) < 0.02 for r in listed)


def test_residue_and_the_rest_make_up_the_documents(spark, sf):
    found, reasons = {r.doc_id for r in _all(spark, sf, "p9_found")}, _all(spark, sf, "p9_reasons")
    assert found and found == {r.doc_id for r in reasons} and {r.reason for r in reasons} <= {"placeholder", "filler", "error_page", "scripts_required"}
    docs = q.table(spark, sf, "documents")
    left = docs.where(~F.col("doc_id").isin(*found)).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("s"))
    assert sorted(map(tuple, _all(spark, sf, "p9_clean_documents")), key=repr) == sorted(map(tuple, left.collect()), key=repr)
    slots = _all(spark, sf, "p9_open_slots")
    assert slots and not found & {r.doc_id for r in slots} and all(r.slots + r.slots_below > 0 for r in slots)
