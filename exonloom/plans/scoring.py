"""Registered queries on the models' tables and scores: fitted on the training side of a strict donor split, scoring its test side."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import functions as F

from exonloom.operators import evaluate, models, stats
from exonloom.operators.scan import scan
from exonloom.operators.windows import sequences
from exonloom.plans.sequences import SEQS, strict, strict_windows
from exonloom.runtime import write_table
from exonloom.sources.tables import table
from exonloom.spec import ACCEPTOR, DONOR

L = DONOR.window


def _data(spark, sf_dir, spec=DONOR):
    return write_table(strict_windows(spark, sf_dir, spec), "strict")


def _train(spark, sf_dir, spec=DONOR):
    return _data(spark, sf_dir, spec).where("split = 'train'").select("label", "w")


def _pos(spark, sf_dir, spec=DONOR):
    return _train(spark, sf_dir, spec).where("label = 1").select("w")


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def background_freq_raw(spark, sf_dir):
    return _r(stats.background(_train(spark, sf_dir).where("label = 0").select("w")), "freq")


def background_freq_smoothed(spark, sf_dir):
    return _r(stats.background(_train(spark, sf_dir).where("label = 0").select("w"), pseudo=0.5), "freq")


def position_freq(spark, sf_dir):
    return _r(stats.position_freq(_pos(spark, sf_dir), L), "p")


def wmm_logodds(spark, sf_dir, spec=DONOR):
    return _r(models.wmm_table(_train(spark, sf_dir, spec), spec.window), "p", "bg", "log_odds")


def wam_cond_prob(spark, sf_dir):
    return _r(stats.conditional_freq(_pos(spark, sf_dir), L), "p")


def wam_information_content(spark, sf_dir, spec=DONOR):
    return _r(models.information_content(models.wam_tables(_train(spark, sf_dir, spec), spec.window)), "bits")


def wam_top_transition(spark, sf_dir):
    return _r(models.top_transitions(models.wam_tables(_train(spark, sf_dir), L)), "p")


def chi2_pairs(spark, sf_dir, spec=DONOR):
    return _r(stats.chi2_pairs(stats.pair_counts(_pos(spark, sf_dir, spec), spec.window)), "score")


def dependency_pairs_topk(spark, sf_dir, spec=DONOR):
    return _r(stats.dependency_pairs(stats.chi2_pairs(stats.pair_counts(_pos(spark, sf_dir, spec), spec.window))), "score")


def dependency_strength(spark, sf_dir, spec=DONOR):
    return _r(stats.dependency_strength(stats.chi2_pairs(stats.pair_counts(_pos(spark, sf_dir, spec), spec.window))), "strength")


def pair_logodds(spark, sf_dir, spec=DONOR):
    return _r(models.pair_log_odds(_train(spark, sf_dir, spec), spec.window), "log_odds")


def joint_smoothed(spark, sf_dir):
    return _r(stats.joint_smoothed(stats.pair_counts(_pos(spark, sf_dir), L)), "p")


def _mi(pos, length=L):
    return stats.mutual_information(stats.joint_smoothed(stats.pair_counts(pos, length)), stats.position_freq(pos, length))


def mutual_information(spark, sf_dir, spec=DONOR):
    return _r(_mi(_pos(spark, sf_dir, spec), spec.window), "mi")


def chowliu_edges(spark, sf_dir, spec=DONOR):
    return models.parents_table(spark, models.chow_liu_parents(_mi(_pos(spark, sf_dir, spec), spec.window), spec.window)).select("child", "parent")


def bn_long_range_edges(spark, sf_dir):
    m = models.Network(L, "chow-liu").fit(_train(spark, sf_dir))
    e = spark.createDataFrame(m.long_range(), "child int, parent int")
    mi = _mi(_pos(spark, sf_dir))
    return _r(e.join(mi, (F.least("child", "parent") == F.col("i")) & (F.greatest("child", "parent") == F.col("j"))).select("child", "parent", "mi"), "mi")


def ebn_parents(spark, sf_dir, spec=DONOR):
    return models.parents_table(spark, models.ebn_parents(stats.chi2_pairs(stats.pair_counts(_pos(spark, sf_dir, spec), spec.window)), spec.window))


def ebn_cpt(spark, sf_dir, spec=DONOR):
    m = models.Network(spec.window, "ebn").fit(_train(spark, sf_dir, spec))
    return _r(m.fg, "p")


def fixed_network_cpt(spark, sf_dir):
    parents = [[i - 1, i - 2][: min(i, 2)] for i in range(L)]
    return _r(models.network_cpt(_pos(spark, sf_dir), parents), "p")


def _scored(d, score):
    return _r(d.where("split = 'test'").select("label", "w", score(F.col("w")).alias("score")), "score")


def wmm_score(spark, sf_dir):
    d = _data(spark, sf_dir)
    t = models.wmm_table(d.where("split = 'train'"), L)
    return _scored(d, lambda w: models.wmm_score(w, t))


def wam_score(spark, sf_dir, spec=DONOR):
    d = _data(spark, sf_dir, spec)
    t = models.wam_tables(d.where("split = 'train'"), spec.window)
    return _scored(d, lambda w: models.wam_score(w, t))


def depwam_score(spark, sf_dir, spec=DONOR):
    d = _data(spark, sf_dir, spec)
    train = d.where("split = 'train'")
    t, p = models.wam_tables(train, spec.window), models.pair_log_odds(train, spec.window)
    return _scored(d, lambda w: models.wam_score(w, t) + models.pair_score(w, p))


def _network(spark, sf_dir, structure, spec):
    d = _data(spark, sf_dir, spec)
    return _scored(d, models.Network(spec.window, structure).fit(d.where("split = 'train'")).score)


def bn_chain_score(spark, sf_dir, spec=DONOR):
    return _network(spark, sf_dir, "chain", spec)


def bn_chowliu_score(spark, sf_dir, spec=DONOR):
    return _network(spark, sf_dir, "chow-liu", spec)


def ebn_score(spark, sf_dir, spec=DONOR):
    return _network(spark, sf_dir, "ebn", spec)


def model_comparison(spark, sf_dir):
    """All generative models side by side: independent, chain, chain with pairs, and the three networks."""
    d = _data(spark, sf_dir)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    wmm, wam, pairs = models.wmm_table(train, L), models.wam_tables(train, L), models.pair_log_odds(train, L)
    w = F.col("w")
    chain = models.wam_score(w, wam)
    scores = {"WMM": models.wmm_score(w, wmm), "WAM": chain, "Dep-WAM": chain + models.pair_score(w, pairs)}
    scores |= {f"BN {s}": models.Network(L, s).fit(train).score(w) for s in ("chain", "chow-liu", "ebn")}
    x = test.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("score")) for k, v in scores.items()])).alias("x")).select("x.model", "label", "x.score")
    return _r(evaluate.compare(write_table(evaluate.usable(x, "model"), "model-scores")), "value")


def wmm_evaluation(spark, sf_dir):
    d = _data(spark, sf_dir)
    t = models.wmm_table(d.where("split = 'train'"), L)
    x = d.where("split = 'test'").select(F.lit("WMM").alias("model"), "label", F.round(models.wmm_score(F.col("w"), t), 6).alias("score"))
    rows = write_table(evaluate.usable(x, "model"), "wmm-scores")
    m = evaluate.confusion(rows).join(evaluate.roc_auc(rows), "model")
    return _r(m, "sensitivity", "specificity", "precision", "f1", "mcc", "auc")


def wmm_backgrounds(spark, sf_dir):
    """The position model under each background: raw shares, smoothed shares, uniform."""
    train = _train(spark, sf_dir)
    parts = [models.wmm_table(train, L, b).select(F.lit(b).alias("background"), "pos", "base", "log_odds") for b in ("raw", "smoothed", "uniform")]
    return _r(parts[0].unionByName(parts[1]).unionByName(parts[2]), "log_odds")


def acceptor_score(spark, sf_dir):
    d = write_table(strict_windows(spark, sf_dir, ACCEPTOR), "strict")
    t = models.wmm_table(d.where("split = 'train'"), ACCEPTOR.window)
    return _scored(d, lambda w: models.wmm_score(w, t))


def bn_summary(spark, sf_dir):
    m = models.Network(L, "chow-liu").fit(_train(spark, sf_dir))
    n = spark.createDataFrame([(c, p) for c, ps in enumerate(m.parents) for p in ps], "child int, parent int")
    return n.agg(F.count("*").alias("n_edges"), F.count_if(F.abs(F.col("child") - F.col("parent")) > 1).alias("n_long_range"))


def predictions(spark, sf_dir):
    """Given scores as 0/1 predictions at threshold 0; scores that are missing or NaN predict nothing."""
    s = table(spark, sf_dir, "scores").where(F.col("score").isNotNull() & ~F.isnan("score"))
    return s.select("sample_id", "model_name", "label", (F.col("score") >= 0).cast("int").alias("predicted"))


def _scan(spark, sf_dir, threshold, context=None, spec=DONOR):
    t = models.wmm_table(_train(spark, sf_dir, spec), spec.window)
    s = sequences(table(spark, sf_dir, "gene_records"), "record_id")
    return scan(s, "record_id", spec, lambda w: F.round(models.wmm_score(w, t), 6), threshold, context)


def genome_scan(spark, sf_dir, spec=DONOR):
    return _r(_scan(spark, sf_dir, 1.0, spec=spec), "score")


def scan_context(spark, sf_dir):
    return _scan(spark, sf_dir, 2.0, (2, 5)).select("record_id", "pos", "context")


QUERIES = {
    f.__name__: f
    for f in (
        wmm_score, background_freq_raw, background_freq_smoothed, position_freq, wmm_logodds, wam_cond_prob, wam_score, wam_information_content, wam_top_transition, chi2_pairs, dependency_pairs_topk,
        dependency_strength, pair_logodds, depwam_score, joint_smoothed, mutual_information, chowliu_edges, bn_chain_score, bn_chowliu_score, bn_long_range_edges, ebn_parents, ebn_cpt, fixed_network_cpt,
        ebn_score, model_comparison, wmm_evaluation, wmm_backgrounds, acceptor_score, bn_summary, predictions, genome_scan, scan_context,
    )
}
#: The same on acceptor windows (23 symbols, 253 pairs of positions).
AT_ACCEPTORS = [
    f.__name__
    for f in (
        wam_score, depwam_score, chi2_pairs, dependency_pairs_topk, dependency_strength, pair_logodds, mutual_information, chowliu_edges,
        bn_chain_score, bn_chowliu_score, ebn_parents, ebn_cpt, ebn_score, wmm_logodds, wam_information_content, genome_scan,
    )
]
QUERIES |= {f"acceptor_{name}": partial(QUERIES[name], spec=ACCEPTOR) for name in AT_ACCEPTORS}

_B = "(VALUES ('A'), ('C'), ('G'), ('T'))"
_POS = f"{strict()}, pw AS (SELECT w FROM tp), nw AS (SELECT w FROM tn), tw AS (SELECT label, w FROM st WHERE split = 'test')"
_BG = f"bs AS (SELECT b.base, coalesce(n, 0)::DOUBLE AS n FROM {_B} b(base) LEFT JOIN (SELECT substring(w, p::INTEGER, 1) AS base, count(*) AS n FROM (SELECT w, unnest(range(1, 10)) AS p FROM nw) GROUP BY 1) USING (base)), bg AS (SELECT base, n / sum(n) OVER () AS freq FROM bs)"
_FREQ = f"""sy AS (SELECT (p - 1)::INTEGER AS pos, substring(w, p::INTEGER, 1) AS base, count(*) AS n FROM (SELECT w, unnest(range(1, 10)) AS p FROM pw) GROUP BY ALL),
pf AS (SELECT g.pos, g.base, coalesce(n, 0) AS n, (coalesce(n, 0) + 0.5e0) / ((SELECT count(*) FROM pw) + 2e0) AS p FROM (SELECT i::INTEGER AS pos, base FROM range(0, 9) r(i), {_B} b(base)) g LEFT JOIN sy USING (pos, base))"""
_WMM = f"{_POS}, {_BG}, {_FREQ}, lo AS (SELECT pos, base, p, freq AS bg, ln(greatest(p, 1e-9) / greatest(freq, 1e-9)) AS log_odds FROM pf JOIN bg USING (base))"


def _cond(src: str, name: str) -> str:
    """Conditional shares of neighbours in the windows of src."""
    return f"""{name}c AS (SELECT p::INTEGER AS pos, substring(w, p::INTEGER, 1) AS prev, substring(w, p::INTEGER + 1, 1) AS curr, count(*) AS n FROM (SELECT w, unnest(range(1, 9)) AS p FROM {src}) GROUP BY ALL),
{name} AS (SELECT g.pos, g.prev, g.curr, coalesce(n, 0) AS n, (coalesce(n, 0) + 0.5e0) / (sum(coalesce(n, 0)) OVER (PARTITION BY g.pos, g.prev) + 2e0) AS p FROM (SELECT i::INTEGER AS pos, a.base AS prev, b.base AS curr FROM range(1, 9) r(i), {_B} a(base), {_B} b(base)) g LEFT JOIN {name}c USING (pos, prev, curr))"""


_WAM = f"{_POS}, {_BG}, {_FREQ}, {_cond('pw', 'cf')}"
_WAM_SCORE = """ws AS (SELECT label, w, sum(v) AS score FROM (
 SELECT t.label, t.w, ln(f.p / greatest(b.freq, 1e-9)) AS v FROM tw t JOIN pf f ON f.pos = 0 AND f.base = substring(t.w, 1, 1) JOIN bg b ON b.base = f.base
 UNION ALL SELECT t.label, t.w, ln(c.p / greatest(b.freq, 1e-9)) FROM (SELECT label, w, unnest(range(1, 9)) AS p FROM tw) t JOIN cf c ON c.pos = t.p AND c.prev = substring(t.w, t.p::INTEGER, 1) AND c.curr = substring(t.w, t.p::INTEGER + 1, 1) JOIN bg b ON b.base = c.curr) GROUP BY label, w)"""


def _pairs(src: str, name: str) -> str:
    return f"""{name} AS (SELECT i::INTEGER AS i, j::INTEGER AS j, substring(w, i::INTEGER + 1, 1) AS a, substring(w, j::INTEGER + 1, 1) AS b, count(*) AS n FROM (SELECT w, i, unnest(range(i + 1, 9)) AS j FROM (SELECT w, unnest(range(0, 8)) AS i FROM {src})) GROUP BY ALL)"""


_CHI = f"""{_POS}, {_pairs('pw', 'pc')}, mr AS (SELECT i, j, a, sum(n)::DOUBLE AS r FROM pc GROUP BY ALL), mc AS (SELECT i, j, b, sum(n)::DOUBLE AS c FROM pc GROUP BY ALL),
ch AS (SELECT i, j, greatest(0e0, (SELECT count(*) FROM pw) * (sum(n * n / (r * c)) - 1)) AS score FROM pc JOIN mr USING (i, j, a) JOIN mc USING (i, j, b) GROUP BY i, j),
dp AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, i, j) AS rank FROM ch WHERE score >= 6 OR (SELECT max(score) FROM ch) < 6 QUALIFY rank <= 16)"""
_ODDS = f"""{_pairs('nw', 'nc')}, od AS (SELECT d.rank, d.i, d.j, a.base AS a, b.base AS b, ln(greatest((coalesce(p.n, 0) + 0.5e0) / ((SELECT count(*) FROM pw) + 8e0), 1e-10) / greatest((coalesce(q.n, 0) + 0.5e0) / ((SELECT count(*) FROM nw) + 8e0), 1e-10)) AS log_odds
 FROM (SELECT d.*, a.base AS ba, b.base AS bb FROM dp d, {_B} a(base), {_B} b(base)) d JOIN {_B} a(base) ON a.base = d.ba JOIN {_B} b(base) ON b.base = d.bb LEFT JOIN pc p ON p.i = d.i AND p.j = d.j AND p.a = d.ba AND p.b = d.bb LEFT JOIN nc q ON q.i = d.i AND q.j = d.j AND q.a = d.ba AND q.b = d.bb)"""
_JOINT = f"{_POS}, {_FREQ}, {_pairs('pw', 'pc')}, jt AS (SELECT i, j, a, b, (n + 0.5e0) / (sum(n) OVER (PARTITION BY i, j) + 0.5e0 * count(*) OVER (PARTITION BY i, j)) AS p FROM pc)"
_MI = f"""{_JOINT}, mi AS (SELECT i, j, greatest(0e0, sum(q * ln(q / (pa * pb)))) AS mi FROM (SELECT x.pos AS i, y.pos AS j, x.p AS pa, y.p AS pb, coalesce(jt.p, 1e-10) AS q FROM pf x JOIN pf y ON x.pos < y.pos
 LEFT JOIN jt ON jt.i = x.pos AND jt.j = y.pos AND jt.a = x.base AND jt.b = y.base) GROUP BY i, j)"""
#: An edge belongs to the tree if its ends are not connected by edges before it; then the tree is walked from position 0.
_TREE = f"""{_MI}, rk AS (SELECT i, j, mi, row_number() OVER (ORDER BY round(mi, 10) DESC, i DESC, j DESC) AS r FROM mi),
re AS (SELECT r, i AS node FROM rk UNION SELECT re.r, CASE WHEN e.i = re.node THEN e.j ELSE e.i END FROM re JOIN rk e ON e.r < re.r AND (e.i = re.node OR e.j = re.node)),
te AS (SELECT i, j, mi FROM rk WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.r = rk.r AND re.node = rk.j)),
wk AS (SELECT 0 AS child, -1 AS parent UNION SELECT CASE WHEN t.i = wk.child THEN t.j ELSE t.i END, wk.child FROM wk JOIN te t ON (t.i = wk.child OR t.j = wk.child) AND (CASE WHEN t.i = wk.child THEN t.j ELSE t.i END) <> wk.parent)"""


def _tree_cpt(src: str, name: str) -> str:
    return f"""{name}c AS (SELECT child, parent, CASE WHEN parent < 0 THEN '' ELSE substring(w, parent + 1, 1) END AS key, substring(w, child + 1, 1) AS base, count(*) AS n FROM {src}, wk GROUP BY ALL),
{name} AS (SELECT g.child, g.key, g.base, (coalesce(n, 0) + 0.5e0) / (sum(coalesce(n, 0)) OVER (PARTITION BY g.child, g.key) + 2e0) AS p FROM
 (SELECT child, CASE WHEN parent < 0 THEN '' ELSE k.base END AS key, b.base FROM wk, {_B} k(base), {_B} b(base) WHERE parent >= 0 OR k.base = 'A') g LEFT JOIN {name}c c ON c.child = g.child AND c.key = g.key AND c.base = g.base)"""


def _network_sql(head: str, wk: str = "") -> str:
    return f"""WITH RECURSIVE {head}{wk}, {_tree_cpt('pw', 'fc')}, {_tree_cpt('nw', 'bc')}
SELECT t.label, t.w, round(sum(ln(greatest(f.p, 1e-10)) - ln(greatest(b.p, 1e-10))), 6) AS score FROM (SELECT label, w, child, CASE WHEN parent < 0 THEN '' ELSE substring(w, parent + 1, 1) END AS key, substring(w, child + 1, 1) AS base FROM tw, wk) t
 JOIN fc f ON f.child = t.child AND f.key = t.key AND f.base = t.base JOIN bc b ON b.child = t.child AND b.key = t.key AND b.base = t.base GROUP BY t.label, t.w"""


#: The walk keeps its order in a list: each step appends the linked positions that are not there yet.
_EBN = f"""{_CHI}, cs AS (SELECT i AS u, j AS v, round(score, 9) AS s FROM ch UNION ALL SELECT j, i, round(score, 9) FROM ch),
lk AS (SELECT u, v, s FROM cs WHERE s >= 6), lo1 AS (SELECT u, max_by(v, s) AS v FROM cs WHERE u NOT IN (SELECT u FROM lk) GROUP BY u),
nb AS (SELECT u, v, s FROM lk UNION SELECT cs.u, cs.v, cs.s FROM cs JOIN lo1 ON (cs.u = lo1.u AND cs.v = lo1.v) OR (cs.v = lo1.u AND cs.u = lo1.v)),
sg AS (SELECT u, sum(s) AS t FROM cs GROUP BY u),
bf(ord, k) AS (SELECT [(SELECT u FROM sg ORDER BY t DESC, u LIMIT 1)], 1 UNION ALL
 SELECT bf.ord || coalesce((SELECT list(nb.v ORDER BY nb.s DESC, nb.v) FROM nb WHERE nb.u = bf.ord[bf.k] AND NOT list_contains(bf.ord, nb.v)), []), bf.k + 1 FROM bf WHERE bf.k <= len(bf.ord)),
wo AS (SELECT ord FROM bf ORDER BY k DESC LIMIT 1), ro AS (SELECT ord || coalesce((SELECT list(u ORDER BY t DESC, u) FROM sg, wo WHERE NOT list_contains(ord, u)), []) AS ord FROM wo),
od AS (SELECT unnest(ord) AS node, unnest(range(0, len(ord))) AS k FROM ro),
pa AS (SELECT a.node::INTEGER AS child, b.node::INTEGER AS parent, (row_number() OVER (PARTITION BY a.node ORDER BY s DESC, b.k) - 1)::INTEGER AS rank FROM od a JOIN od b ON b.k < a.k JOIN cs ON cs.u = a.node AND cs.v = b.node QUALIFY rank < 2)"""


def _ebn_cells(src: str, keep: str = "w") -> str:
    """Key and symbol of each node in the windows of src."""
    return f"""(SELECT {keep}, n.node, coalesce(string_agg(substring(w, parent + 1, 1), '' ORDER BY rank), '') AS key, substring(w, n.node + 1, 1) AS base FROM {src} CROSS JOIN (SELECT i::INTEGER AS node FROM range(0, 9) r(i)) n LEFT JOIN pa ON pa.child = n.node GROUP BY {keep}, n.node)"""


def _ebn_cpt(src: str, name: str) -> str:
    return f"""{name}x AS (SELECT node, key, base, count(*) AS n FROM {_ebn_cells(src)} GROUP BY ALL), {name}t AS (SELECT node, key, sum(n) AS t FROM {name}x GROUP BY ALL),
{name} AS (SELECT t.node, t.key, b.base, coalesce(n, 0) AS n, (coalesce(n, 0) + 1e0) / (t + 4e0) AS p FROM {name}t t CROSS JOIN {_B} b(base) LEFT JOIN {name}x x ON x.node = t.node AND x.key = t.key AND x.base = b.base)"""


def _ebn_score(src: str, keep: str) -> str:
    return f"""eb AS (SELECT {keep}, sum(ln(greatest(coalesce(f.p, 0.25e0), 1e-10)) - ln(greatest(coalesce(g.p, 0.25e0), 1e-10))) AS score FROM {_ebn_cells(src, keep)} c
 LEFT JOIN ef f ON f.node = c.node AND f.key = c.key AND f.base = c.base LEFT JOIN eg g ON g.node = c.node AND g.key = c.key AND g.base = c.base GROUP BY {keep})"""


_EBN_TABLES = f"{_EBN}, {_ebn_cpt('pw', 'ef')}, {_ebn_cpt('nw', 'eg')}"
_WMM_TEST = "sc AS (SELECT label, w, round(sum(log_odds), 6) AS score FROM (SELECT label, w, unnest(range(1, 10)) AS p FROM tw) t JOIN lo ON lo.pos = t.p - 1 AND lo.base = substring(w, t.p::INTEGER, 1) GROUP BY label, w)"
_SCAN_OF = lambda wmm, x: f"""{wmm}, {SEQS}, ww AS (SELECT record_id, i::INTEGER AS i, substring(s, i::INTEGER + 1, {x.window}) AS win FROM (SELECT record_id, s, unnest(range(0, length(s) - {x.window - 1})) AS i FROM s WHERE length(s) >= {x.window}) WHERE substring(s, i::INTEGER + {x.offset + 1}, 2) = '{x.motif}'),
hs AS (SELECT record_id, i + {x.offset} AS pos, win, round(sum(log_odds), 6) AS score FROM (SELECT record_id, i, win, unnest(range(1, {x.window + 1})) AS p FROM ww) x JOIN lo ON lo.pos = x.p - 1 AND lo.base = substring(win, x.p::INTEGER, 1) GROUP BY record_id, i, win)"""  # noqa: E731
_SCAN = _SCAN_OF(_WMM, DONOR)

ORACLE = {
    "background_freq_raw": f"WITH {_POS}, {_BG} SELECT base, round(freq, 6) AS freq FROM bg",
    "background_freq_smoothed": f"WITH {_POS}, {_BG} SELECT base, round((n + 0.5e0) / ((SELECT sum(n) FROM bs) + 2e0), 6) AS freq FROM bs",
    "position_freq": f"WITH {_POS}, {_FREQ} SELECT pos, base, n, round(p, 6) AS p FROM pf",
    "wmm_logodds": f"WITH {_WMM} SELECT pos, base, round(p, 6) AS p, round(bg, 6) AS bg, round(log_odds, 6) AS log_odds FROM lo",
    "wmm_score": f"WITH {_WMM}, {_WMM_TEST} SELECT label, w, score FROM sc",
    "wam_cond_prob": f"WITH {_WAM} SELECT pos, prev, curr, n, round(p, 6) AS p FROM cf",
    "wam_score": f"WITH {_WAM}, {_WAM_SCORE} SELECT label, w, round(score, 6) AS score FROM ws",
    "wam_information_content": f"""WITH {_WAM} SELECT 0 AS pos, round(sum(p * log2(p / greatest(freq, 1e-9))), 6) AS bits FROM pf JOIN bg USING (base) WHERE pos = 0
 UNION ALL SELECT pos, round(sum(0.25e0 * p * log2(p / greatest(freq, 1e-9))), 6) FROM cf JOIN bg ON bg.base = cf.curr GROUP BY pos""",
    "wam_top_transition": f"""WITH {_WAM} SELECT 0 AS pos, NULL::VARCHAR AS prev, base AS curr, round(p, 6) AS p FROM (SELECT * FROM pf WHERE pos = 0 ORDER BY p DESC, base LIMIT 1)
 UNION ALL SELECT pos, prev, curr, round(p, 6) FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY p DESC, prev, curr) AS r FROM cf) WHERE r = 1""",
    "chi2_pairs": f"WITH {_CHI} SELECT i, j, round(score, 6) AS score FROM ch",
    "dependency_pairs_topk": f"WITH {_CHI} SELECT i, j, round(score, 6) AS score, rank::INTEGER AS rank FROM dp",
    "dependency_strength": f"WITH {_CHI} SELECT pos, round(sum(score), 6) AS strength FROM (SELECT i AS pos, score FROM ch UNION ALL SELECT j, score FROM ch) GROUP BY 1",
    "pair_logodds": f"WITH {_CHI}, {_ODDS} SELECT rank::INTEGER AS rank, i, j, a, b, round(log_odds, 6) AS log_odds FROM od",
    "depwam_score": f"""WITH {_CHI}, {_ODDS}, {_BG}, {_FREQ}, {_cond('pw', 'cf')}, {_WAM_SCORE}, ps AS (SELECT w, sum(log_odds) AS extra FROM tw JOIN od ON od.a = substring(w, i + 1, 1) AND od.b = substring(w, j + 1, 1) GROUP BY w)
SELECT label, w, round(score + coalesce(extra, 0), 6) AS score FROM ws LEFT JOIN ps USING (w)""",
    "joint_smoothed": f"WITH {_JOINT} SELECT i, j, a, b, round(p, 6) AS p FROM jt",
    "mutual_information": f"WITH {_MI} SELECT i, j, round(mi, 6) AS mi FROM mi",
    "chowliu_edges": f"WITH RECURSIVE {_TREE} SELECT child, parent FROM wk WHERE parent >= 0",
    "bn_long_range_edges": f"WITH RECURSIVE {_TREE} SELECT child, parent, round(mi, 6) AS mi FROM wk JOIN te ON te.i = least(child, parent) AND te.j = greatest(child, parent) WHERE parent >= 0 AND abs(child - parent) > 1",
    "bn_chain_score": _network_sql(_POS, ", wk AS (SELECT i::INTEGER AS child, (i - 1)::INTEGER AS parent FROM range(0, 9) r(i))"),
    "bn_chowliu_score": _network_sql(_TREE),
    "fixed_network_cpt": f"""WITH {_POS}, x AS (SELECT p::INTEGER AS node, CASE WHEN p >= 1 THEN substring(w, p::INTEGER, 1) ELSE '' END || CASE WHEN p >= 2 THEN substring(w, p::INTEGER - 1, 1) ELSE '' END AS key, substring(w, p::INTEGER + 1, 1) AS base FROM (SELECT w, unnest(range(0, 9)) AS p FROM pw)),
c AS (SELECT node, key, base, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT node, key, sum(n) AS t FROM c GROUP BY ALL)
SELECT t.node, t.key, b.base, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1e0) / (t + 4e0), 6) AS p FROM t CROSS JOIN {_B} b(base) LEFT JOIN c ON c.node = t.node AND c.key = t.key AND c.base = b.base""",
    "ebn_parents": f"WITH RECURSIVE {_EBN} SELECT child, parent, rank FROM pa",
    "ebn_cpt": f"WITH RECURSIVE {_EBN}, {_ebn_cpt('pw', 'ef')} SELECT node, key, base, n, round(p, 6) AS p FROM ef",
    "ebn_score": f"WITH RECURSIVE {_EBN_TABLES}, {_ebn_score('tw', 'label, w')} SELECT label, w, round(score, 6) AS score FROM eb",
    "wmm_evaluation": f"""WITH {_WMM}, {_WMM_TEST}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0) AS tp, count(*) FILTER (label = 0 AND score >= 0) AS fp, count(*) FILTER (label = 0 AND score < 0) AS tn, count(*) FILTER (label = 1 AND score < 0) AS fn FROM sc),
k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM sc),
a AS (SELECT (sum(r) FILTER (label = 1) - (tp + fn) * (tp + fn + 1) / 2e0) / ((tp + fn)::DOUBLE * (tn + fp)) AS auc FROM k, c GROUP BY tp, fp, tn, fn),
m AS (SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision FROM c)
SELECT 'WMM' AS model, tp, fp, tn, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(precision, 6) AS precision, round(coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0), 6) AS f1,
 round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, round(auc, 6) AS auc FROM m, a""",
    "genome_scan": f"WITH {_SCAN} SELECT record_id, pos, score, win FROM hs WHERE score >= 1",
    "scan_context": f"WITH {_SCAN} SELECT record_id, pos, substring(s.s, greatest(0, pos - 2) + 1, pos + 5 - greatest(0, pos - 2)) AS context FROM hs JOIN s USING (record_id) WHERE score >= 2",
    "wmm_backgrounds": f"""WITH {_WMM}, sm AS (SELECT base, (n + 0.5e0) / ((SELECT sum(n) FROM bs) + 2e0) AS f FROM bs)
SELECT 'raw' AS background, pos, base, round(log_odds, 6) AS log_odds FROM lo UNION ALL SELECT 'smoothed', pos, base, round(ln(p / f), 6) FROM pf JOIN sm USING (base) UNION ALL SELECT 'uniform', pos, base, round(ln(p / 0.25e0), 6) FROM pf""",
    "acceptor_score": f"""WITH {strict(ACCEPTOR)}, b AS (SELECT base, count(*) / sum(count(*)) OVER () AS f FROM (SELECT substring(w, p::INTEGER, 1) AS base FROM (SELECT w, unnest(range(1, 24)) AS p FROM tn)) GROUP BY 1),
n AS (SELECT p, substring(w, p::INTEGER, 1) AS base, count(*) AS n FROM (SELECT w, unnest(range(1, 24)) AS p FROM tp) GROUP BY ALL),
lo AS (SELECT g.p, b.base, ln((coalesce(n, 0) + 0.5e0) / ((SELECT count(*) FROM tp) + 2e0) / greatest(f, 1e-9)) AS v FROM (SELECT unnest(range(1, 24)) AS p) g CROSS JOIN b LEFT JOIN n ON n.p = g.p AND n.base = b.base)
SELECT label, w, round(sum(v), 6) AS score FROM (SELECT label, w, unnest(range(1, 24)) AS q FROM st WHERE split = 'test') t JOIN lo ON lo.p = t.q AND lo.base = substring(w, t.q::INTEGER, 1) GROUP BY label, w""",
    "bn_summary": f"WITH RECURSIVE {_TREE} SELECT count(*) AS n_edges, count(*) FILTER (abs(child - parent) > 1) AS n_long_range FROM wk WHERE parent >= 0",
    "predictions": "SELECT sample_id, model_name, label, (score >= 0)::INTEGER AS predicted FROM scores WHERE score IS NOT NULL AND NOT isnan(score)",
}


def _at_acceptors(sql: str) -> str:
    """SQL on donor windows, as SQL on acceptor windows: the other split, and ranges of positions that much longer."""
    more = ACCEPTOR.window - DONOR.window
    return re.sub(r"range\((0|1|i \+ 1), (8|9|10)\)", lambda m: f"range({m[1]}, {int(m[2]) + more})", sql.replace(strict(), strict(ACCEPTOR)))


ORACLE |= {f"acceptor_{name}": _at_acceptors(ORACLE[name]) for name in AT_ACCEPTORS if name != "genome_scan"}
ORACLE["acceptor_genome_scan"] = f"WITH {_SCAN_OF(_at_acceptors(_WMM), ACCEPTOR)} SELECT record_id, pos, score, win FROM hs WHERE score >= 1"
