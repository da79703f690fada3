"""Scoring models of fixed-length windows: independent positions, first-order chain, chain with dependency pairs, Bayesian networks.

Fitting is grouped counting (see stats) and yields small tables. Scoring turns a table into literal arrays - positions x 16 numbers at
most - so that a score is one expression per row inside whole-stage code, without joins, shuffles or Python, and works alike on a
stream. Invalid windows score null; log-odds of valid ones are finite."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.operators import stats
from exonloom.runtime import write_table
from exonloom.spec import DEPENDENCY_THRESHOLD, MAX_PAIRS, MAX_PARENTS

FLOOR = 1e-9


def code(win: Column, pos: int) -> Column:
    """0..3 of the symbol at a position; null beyond the window's end, -1 for other symbols."""
    return F.position(F.nullif(win.substr(pos + 1, 1), F.lit("")), F.lit("ACGT")) - 1


def _pick(values: list[float], index: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), index)


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def exact_length(win: Column, length: int) -> Column:
    """The window itself; the job fails with a message if its length differs. Null stays null."""
    return F.when(F.length(win) != length, F.raise_error(F.concat(F.lit(f"window of {length} symbols expected, got "), win)).cast("string")).otherwise(win)


def _split(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    return train.where("label = 1").select("w"), train.where("label = 0").select("w")


def require_positives(pos: DataFrame) -> None:
    if pos.isEmpty():
        raise ValueError("no valid positive windows")


# -- independent positions ---------------------------------------------------------------------------------------------------


def wmm_table(train: DataFrame, length: int, bg: str = "raw") -> DataFrame:
    """(pos, base, p, bg, log_odds) from (label, w). bg: 'raw' (shares in the negatives), 'smoothed' (0.5 added), 'uniform'."""
    pos, neg = _split(train)
    freq = stats.position_freq(pos, length)
    b = _background(neg, bg)
    floor = FLOOR if bg == "raw" else 1e-10
    t = freq.join(F.broadcast(b), "base")
    return t.select("pos", "base", "p", F.col("freq").alias("bg"), F.ln(F.greatest("p", F.lit(floor)) / F.greatest("freq", F.lit(floor))).alias("log_odds"))


def wmm_score(win: Column, table: DataFrame) -> Column:
    """Sum of log-odds. RuntimeError for an empty (untrained) table."""
    rows = {(r.pos, r.base): r.log_odds for r in table.select("pos", "base", "log_odds").collect()}
    if not rows:
        raise RuntimeError("the model is not trained")
    n = max(p for p, _ in rows) + 1
    return _total([_pick([rows[p, b] for b in stats.BASES], code(win, p)) for p in range(n)])


# -- first-order chain -------------------------------------------------------------------------------------------------------


def _background(neg: DataFrame, bg: str) -> DataFrame:
    """'raw' (shares in the negatives), 'smoothed' (0.5 added) or 'uniform'."""
    if bg == "uniform":
        return stats.grid(neg.sparkSession, 1).select("base", F.lit(0.25).alias("freq"))
    return stats.background(neg, pseudo={"raw": 0.0, "smoothed": 0.5}[bg])


def wam_tables(train: DataFrame, length: int, bg: str = "raw") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, cond, bg): symbol shares at position 0, conditional shares after it, and the zero-order background as in wmm_table."""
    pos, neg = _split(train)
    require_positives(pos)
    return stats.position_freq(pos, length).where("pos = 0"), stats.conditional_freq(pos, length), _background(neg, bg)


def wam_score(win: Column, tables: tuple[DataFrame, DataFrame, DataFrame]) -> Column:
    first, cond, bg = tables
    b = {r.base: max(r.freq, FLOOR) for r in bg.collect()}
    f = {r.base: r.p for r in first.collect()}
    c = {(r.pos, r.prev, r.curr): r.p for r in cond.select("pos", "prev", "curr", "p").collect()}
    parts = [_pick([math.log(f[x] / b[x]) for x in stats.BASES], code(win, 0))]
    for i in sorted({k[0] for k in c}):
        parts.append(_pick([math.log(c[i, x, y] / b[y]) for x in stats.BASES for y in stats.BASES], code(win, i - 1) * 4 + code(win, i)))
    return _total(parts)


def information_content(tables: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(pos, bits): information of each position against the background; at later positions averaged over the four predecessors."""
    first, cond, bg = tables
    b = F.broadcast(bg)
    a = first.join(b, "base").groupBy("pos").agg(F.sum(F.col("p") * F.log2(F.col("p") / F.greatest("freq", F.lit(FLOOR)))).alias("bits"))
    z = cond.join(b, F.col("curr") == F.col("base")).groupBy("pos").agg(F.sum(0.25 * F.col("p") * F.log2(F.col("p") / F.greatest("freq", F.lit(FLOOR)))).alias("bits"))
    return a.unionByName(z)


def top_transitions(tables: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(pos, prev, curr, p): the likeliest transition of each position, at position 0 the likeliest symbol (prev null); ties in ACGT order."""
    first, cond, _ = tables
    a = first.groupBy("pos").agg(F.min(F.struct((-F.col("p")).alias("m"), "base")).alias("x")).select("pos", F.lit(None).cast("string").alias("prev"), F.col("x.base").alias("curr"), (-F.col("x.m")).alias("p"))
    z = cond.groupBy("pos").agg(F.min(F.struct((-F.col("p")).alias("m"), "prev", "curr")).alias("x")).select("pos", "x.prev", "x.curr", (-F.col("x.m")).alias("p"))
    return a.unionByName(z)


# -- chain with dependency pairs ---------------------------------------------------------------------------------------------


def pair_log_odds(train: DataFrame, length: int, threshold: float = DEPENDENCY_THRESHOLD, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(rank, i, j, a, b, log_odds) of the selected pairs, for all 16 cells; the positives themselves are the background if there are no
    negatives."""
    pos, neg = _split(train)
    fg = write_table(stats.pair_counts(pos, length), "pair-counts")
    chosen = stats.dependency_pairs(stats.chi2_pairs(fg), threshold, max(1, max_pairs))
    bg = stats.pair_counts(neg, length)
    bg = fg if neg.isEmpty() else bg
    base = F.array(*[F.lit(b) for b in stats.BASES])
    cells = chosen.select("rank", "i", "j", F.explode(base).alias("a")).select("rank", "i", "j", "a", F.explode(base).alias("b"))
    total = lambda t, o: t.groupBy("i", "j").agg(F.sum("n").alias(o))
    x = cells.join(F.broadcast(fg.withColumnRenamed("n", "f")), ["i", "j", "a", "b"], "left").join(F.broadcast(bg.withColumnRenamed("n", "g")), ["i", "j", "a", "b"], "left")
    x = x.join(F.broadcast(total(fg, "ft")), ["i", "j"]).join(F.broadcast(total(bg, "gt")), ["i", "j"])
    p = lambda n, t: (F.coalesce(F.col(n), F.lit(0)) + 0.5) / (F.col(t) + 8.0)
    return x.select("rank", "i", "j", "a", "b", stats.log_odds(p("f", "ft"), p("g", "gt")).alias("log_odds"))


def pair_score(win: Column, table: DataFrame, length: int | None = None) -> Column:
    """Sum of the pairs' log-odds; with a length, windows of another one fail the job."""
    win = win if length is None else exact_length(win, length)
    rows = {(r.i, r.j, r.a, r.b): r.log_odds for r in table.collect()}
    pairs = sorted({k[:2] for k in rows})
    return _total([F.lit(0.0), *[_pick([rows[i, j, a, b] for a in stats.BASES for b in stats.BASES], code(win, i) * 4 + code(win, j)) for i, j in pairs]])


# -- Bayesian networks -------------------------------------------------------------------------------------------------------


def chain_parents(length: int) -> list[list[int]]:
    return [[]] + [[i] for i in range(length - 1)]


def chow_liu_parents(mi: DataFrame, length: int, root: int = 0) -> list[list[int]]:
    """Parents in the maximum spanning tree over mutual information, oriented from the root. The search runs over the positions' pairs,
    253 at most; of equal values (to ten decimals, so that the order
    of summation doesn't decide) the pair with larger i, then larger j, goes first."""
    pairs = sorted(((round(r.mi, 10), r.i, r.j) for r in mi.collect()), reverse=True)
    comp, near = list(range(length)), {i: [] for i in range(length)}
    for _, i, j in pairs:
        if comp[i] != comp[j]:
            old = comp[j]
            comp = [comp[i] if c == old else c for c in comp]
            near[i].append(j)
            near[j].append(i)
    parents, queue, seen = [[] for _ in range(length)], deque([root]), {root}
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in seen:
                seen.add(v)
                parents[v] = [u]
                queue.append(v)
    return parents


def ebn_parents(chi2: DataFrame, length: int, threshold: float = DEPENDENCY_THRESHOLD, max_parents: int = MAX_PARENTS) -> list[list[int]]:
    """Parents in the expanded network, from the pair table of 253 rows at most: positions are put in order by a breadth-first walk over
    dependent pairs from the position of greatest strength, the rest by strength; each then gets the max_parents earlier positions it
    depends on most. Equal values keep the earlier candidate."""
    score = np.zeros((length, length))
    for r in chi2.collect():
        score[[r.i, r.j], [r.j, r.i]] = round(r.score, 9)
    near = (score >= threshold) & ~np.eye(length, dtype=bool)
    for u in np.flatnonzero(~near.any(axis=1)) if length > 1 else ():
        if not near[u].any():  # still alone: it joins its strongest partner, which then isn't alone either
            v = int(np.argmax(np.where(np.arange(length) == u, -1.0, score[u])))
            near[u, v] = near[v, u] = True
    by_strength = np.argsort(-score.sum(axis=1), kind="stable").tolist()
    order = by_strength[:1]
    for u in order:  # grows while it is walked
        order += [v for v in np.argsort(-score[u], kind="stable").tolist() if near[u, v] and v not in order]
    order += [v for v in by_strength if v not in order]
    ranked = {v: sorted(order[:k], key=lambda p: -score[v, p]) for k, v in enumerate(order)}
    return [ranked[v][: max(1, max_parents)] for v in range(length)]


def parents_table(spark, parents: list[list[int]]) -> DataFrame:
    """(child, parent, rank) of a structure."""
    return spark.createDataFrame([(c, p, k) for c, ps in enumerate(parents) for k, p in enumerate(ps)], "child int, parent int, rank int")


def network_cpt(ws: DataFrame, parents: list[list[int]], laplace: float = 1.0, smooth_all: bool = False) -> DataFrame:
    """(node, key, base, n, p): symbol shares of each node given the symbols of its parents (key: their concatenation), with `laplace`
    added to each base. Only keys that occur are there, unless smooth_all (single-parent tables) makes up the others."""
    at = F.array(*[F.struct(F.lit(c).alias("node"), F.concat(F.lit(""), *[F.col("w").substr(p + 1, 1) for p in ps]).alias("key"), F.col("w").substr(c + 1, 1).alias("base")) for c, ps in enumerate(parents)])
    n = ws.select(F.explode(at).alias("x")).groupBy("x.node", "x.key", "x.base").agg(F.count("*").alias("n"))
    keys = n.select("node", "key").distinct()
    if smooth_all:
        spark = ws.sparkSession
        keys = spark.createDataFrame([(c, k) for c, ps in enumerate(parents) for k in (stats.BASES if ps else [""])], "node int, key string")
    cells = keys.select("node", "key", F.explode(F.array(*[F.lit(b) for b in stats.BASES])).alias("base"))
    x = cells.join(F.broadcast(n), ["node", "key", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    t = n.groupBy("node", "key").agg(F.sum("n").alias("t"))
    x = x.join(F.broadcast(t), ["node", "key"], "left")
    return x.select("node", "key", "base", "n", ((F.col("n") + laplace) / (F.coalesce("t", F.lit(0)) + 4 * laplace)).alias("p"))


def network_log_prob(win: Column, cpt: DataFrame, parents: list[list[int]]) -> Column:
    """Log-probability of a window; keys that never occurred give 0.25."""
    rows = {(r.node, r.key, r.base): r.p for r in cpt.select("node", "key", "base", "p").collect()}
    parts = []
    for node, ps in enumerate(parents):
        keys = [""]
        index = F.lit(0)
        for p in ps:
            keys = [k + b for k in keys for b in stats.BASES]
            index = index * 4 + code(win, p)
        parts.append(_pick([math.log(max(rows.get((node, k, b), 0.25), 1e-10)) for k in keys for b in stats.BASES], index * 4 + code(win, node)))
    return _total(parts)


class Network:
    """A Bayesian network: score = log-probability under the positives minus that under the negatives (the positives if there are none).

    structure: 'chain', 'chow-liu', 'ebn', or a list of parents (-1 for a root). ValueError for anything else."""

    def __init__(self, length: int, structure="chow-liu", threshold: float = DEPENDENCY_THRESHOLD, max_parents: int = MAX_PARENTS):
        if isinstance(structure, str) and structure == "greedy-bic":
            raise NotImplementedError("greedy-bic")
        if isinstance(structure, str) and structure not in ("chain", "chow-liu", "ebn"):
            raise ValueError(f"unknown structure: {structure!r}")
        self.length, self.structure, self.threshold, self.max_parents = length, structure, threshold, max_parents
        self.parents: list[list[int]] | None = None

    def fit(self, train: DataFrame, chi2: DataFrame | None = None) -> "Network":
        """chi2: the positives' pair table, if it is there already."""
        pos, neg = _split(train)
        require_positives(pos)
        neg = pos if neg.isEmpty() else neg
        if not isinstance(self.structure, str):
            self.parents = [[] if p < 0 else [p] for p in self.structure]
        elif self.structure == "chain":
            self.parents = chain_parents(self.length)
        elif self.structure == "chow-liu":
            counts = stats.pair_counts(pos, self.length)
            self.parents = chow_liu_parents(stats.mutual_information(stats.joint_smoothed(counts), stats.position_freq(pos, self.length)), self.length)
        else:
            self.parents = ebn_parents(stats.chi2_pairs(stats.pair_counts(pos, self.length)) if chi2 is None else chi2, self.length, self.threshold, self.max_parents)
        how = {"laplace": 1.0} if self.structure == "ebn" else {"laplace": 0.5, "smooth_all": True}
        self.fg, self.bg = (write_table(network_cpt(x, self.parents, **how), "network") for x in (pos, neg))
        return self

    def score(self, win: Column, strict: bool = False) -> Column:
        """Null for windows of another length; with strict they fail the job."""
        if self.parents is None:
            raise RuntimeError("the model is not trained")
        win = exact_length(win, self.length) if strict else win
        return network_log_prob(win, self.fg, self.parents) - network_log_prob(win, self.bg, self.parents)

    def long_range(self) -> list[tuple[int, int]]:
        """Edges (child, parent) between positions that are not neighbours."""
        return [(c, p) for c, ps in enumerate(self.parents or []) for p in ps if abs(c - p) > 1]
