"""Near-duplicate records with small edits (problem 5): all pairs whose sets of n-grams have a Jaccard similarity of t or more.

Method: prefix-tree join over globally ordered n-gram sets. The n-grams of all records share one order, rarest first (counts in a
table of constant size, ties by hash). A set is stored in the tree below each gram that can be the first one it shares with a
partner, together with the path of the grams that follow; sets below one gram meet in one task, which descends the tree: a set goes
to the child of each following gram while the remaining-length bound holds - grams shared so far plus grams that still follow must
come to the least overlap that the threshold asks for - and is pruned where that fails or where it is alone. Sets that share a
node share that partial overlap; below the second level what remains of their paths is compared, the partial overlap carried, and
the bound applied to both sides' sizes. Every pair that is left is verified on the full sets.

So that nodes are told apart by few grams, whatever the number of records, the gram universe is cut by hash into parts of a few
grams for each record. If J(A, B) >= t over the whole, J >= t holds in at least one part (the sums over the parts give the
whole), so a search within parts at the same t is exact. The number of parts follows the size of the sets in octaves; a set is
also stored in the next octave if its partner could lie there. For t > 0.5 two parts of more than one gram share two grams at
least.

Parts of a single gram would meet by chance in large collections. They are left out, still exactly: the search within parts runs
at a slightly lower threshold u < t. If at most a share (t - u) / (1 - u) of a record's grams lies in single-gram parts, and not
all do, then the other parts cannot all be below u (what the single ones can contribute is less than what the lower threshold gives away).
Records with a larger share of them - short ones - are stored with their single grams.

Below a gram that more than HEAVY records have, sets are stored at the second level, so that no common gram gathers them in one task.
Copies of one cleaned sequence are collapsed first and come back as members."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.functions.arrays import mix64, row_chunks, string_bytes, window_codes, window_ok
from exonloom.llm.forest import spanning_forest
from exonloom.llm.spans import sequence_classes
from exonloom.runtime import join_unique, shuffle_for, write_table

#: Hash buckets of the gram counts that make the global order; the only thing that is broadcast.
RARITY = 1 << 18
#: Grams per part, at the lower end of an octave.
PART = 4
#: Records with a gram (by its bucket) beyond which sets are stored one level below it.
HEAVY = 20_000
#: Rows and pairs that a task works on at a time.
ROWS, PAIRS = 1 << 17, 1 << 19


def _grams(col, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the distinct grams of each text, sorted by both. Grams of up to 12 letters are exact codes, mixed one-to-one."""
    raw, off = string_bytes(col)
    code = window_codes(raw - np.uint8(65), k, 5)
    at = np.flatnonzero(window_ok(off, k))
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[at]
    h = mix64(code[at])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(row) != 0) | (h[1:] != h[:-1])
    return row[new], h[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def gram_counts(classes: DataFrame, k: int) -> np.ndarray:
    """Records per bucket of grams, over all records; at most RARITY sums reach the driver."""

    def count(batches):
        total = np.zeros(RARITY, np.int64)
        for b in batches:
            for c in row_chunks(b, 0):
                total += np.bincount(_bucket(_grams(c.column(0), k)[1]), minlength=RARITY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = classes.select("seq").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, np.int32)
    out[got.column("bucket").to_numpy()] = np.minimum(got.column("n").to_numpy(), (1 << 31) - 1)
    return out


def _least(t: float, a: int) -> int:
    """Least overlap of a set of a grams with any set at similarity t."""
    return math.ceil(t * a - 1e-9)


def part_threshold(t: float) -> float:
    """The threshold u within parts for a threshold t over the whole; above 0.5."""
    return t - min(0.05, (t - 0.5) / 2)


def tree_nodes(classes: DataFrame, counts, k: int, t: float) -> DataFrame:
    """(node, rep, info, path): the first-level nodes (second-level ones below heavy grams) at which each set is stored. info packs the
    size of the whole set, the size of the part, the grams shared at the node and the children it may descend to; path has 16 bits of each gram
    that follows in the part."""
    u = part_threshold(t)
    spare = (t - u) / (1 - u)

    def run(batches):
        rarity = counts.value
        c1, c2, c3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

        def rows(node, rep, n, size, depth, children, grams, first, left):
            """Rows of sets of one size; grams: their parts' grams by row, first: where the path begins."""
            short = (grams >> np.uint64(20)).astype(np.uint16)
            path = np.ascontiguousarray(short[np.arange(len(first))[:, None], np.minimum(first[:, None] + np.arange(size), size - 1)])
            take = np.arange(size)[None, :] < left[:, None]
            offsets = np.concatenate([[0], np.cumsum(left * 2)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(path[take]))])
            info = (n << 24) | (min(size, 255) << 16) | (depth << 8) | np.clip(children, 0, 255)
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(rep), pa.array(info.astype(np.int64)), binary], names=["node", "rep", "info", "path"])

        for b in batches:
            for c in row_chunks(b, 1, 1 << 19):
                rep = c.column(0).to_numpy()
                row, h = _grams(c.column(1), k)
                if not len(h):
                    continue
                n = np.bincount(row, minlength=len(rep))
                octave = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
                met = rarity[_bucket(h)]
                cost = (np.log2(1.0 + met) * (1 << 15)).astype(np.uint64)  # 20 bits, in the order of the counts
                for up in (0, 1):
                    level = octave + up
                    parts = np.maximum(1, (1 << level) // PART)
                    take = np.ones(len(h), bool) if up == 0 else (n >= t * (1 << level) - 1e-9)[row]
                    r, g, m = row[take], h[take], met[take]
                    if not len(g):
                        continue
                    cell = (np.cumsum(parts) - parts)[r] + ((g & np.uint64(0xFFFFFFFF)) % parts[r].astype(np.uint64)).astype(np.int64)
                    order = np.lexsort((g, (cell.astype(np.uint64) << np.uint64(20)) | cost[take]))
                    r, g, m, cell = r[order], g[order], m[order], cell[order]
                    start = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0]))
                    size = np.diff(np.concatenate([start, [len(g)]]))
                    for a in np.unique(size).tolist():
                        at = start[size == a]
                        if a == 1:
                            single = np.bincount(r[at], minlength=len(rep))
                            at = at[((single > spare * n) | (single >= n))[r[at]]]
                            if len(at):
                                zero = np.zeros(len(at), np.int64)
                                yield rows(mix64(g[at] * c1 + level[r[at]].astype(np.uint64)), rep[r[at]], n[r[at]], 1, 1, zero, g[at][:, None], zero, zero)
                            continue
                        need = _least(u, a)
                        grams, common = g[at[:, None] + np.arange(a)], m[at[:, None] + np.arange(a)] > HEAVY
                        salt = level[r[at]].astype(np.uint64) * c3
                        for i in range(a - need + 1):
                            root = mix64(grams[:, i] * c1 + salt)
                            plain = np.flatnonzero(~common[:, i])
                            if len(plain):
                                of = r[at[plain]]
                                same = np.full(len(plain), 1)
                                yield rows(root[plain], rep[of], n[of], a, 1, same * (a - need - i + 1), grams[plain], same * (i + 1), same * (a - 1 - i))
                            heavy = np.flatnonzero(common[:, i])
                            for j in range(i + 1, a - need + 2) if len(heavy) else ():
                                of = r[at[heavy]]
                                same = np.full(len(heavy), 1)
                                yield rows(mix64(root[heavy] ^ (grams[heavy, j] * c2)), rep[of], n[of], a, 2, same * 0, grams[heavy], same * (j + 1), same * (a - 1 - j))

    return classes.select("rep", "seq").mapInArrow(run, "node long, rep long, info long, path binary")


def _pairs_of(group: np.ndarray):
    """Blocks of (x, y), x < y, over all rows of equal group (sorted), PAIRS at a time."""
    end = np.searchsorted(group, group, side="right")
    n = end - np.arange(len(group)) - 1  # partners after each row
    total = np.cumsum(n)
    for f in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        p = np.arange(f, min(f + PAIRS, int(total[-1])))
        x = np.searchsorted(total, p, side="right")
        yield x, x + 1 + p - (total[x] - n[x])


def descend(node: np.ndarray, rep: np.ndarray, info: np.ndarray, paths: pa.Array, t: float):
    """Candidate pairs (a, b), a < b, in blocks, of the sets below the nodes of a sorted batch that holds whole nodes."""
    u = part_threshold(t)
    alone = np.concatenate([[True], node[1:] != node[:-1]]) & np.concatenate([node[1:] != node[:-1], [True]])
    keep = np.flatnonzero(~alone)
    if not len(keep):
        return
    node, rep, info = node[keep], rep[keep], info[keep]
    width, part, depth, child = info >> 24, (info >> 16) & 255, (info >> 8) & 255, info & 255
    paths = paths.take(pa.array(keep))
    raw = np.frombuffer(paths.buffers()[2], np.uint16) if paths.buffers()[2] is not None else np.zeros(0, np.uint16)
    off = np.frombuffer(paths.buffers()[1], np.int32, count=len(paths) + 1, offset=4 * paths.offset) // 2
    left = np.diff(off)
    grams = np.full((len(keep), max(1, int(left.max()))), -1, np.int32)
    grams[np.repeat(np.arange(len(keep)), left), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], left)] = raw[off[0] : off[-1]]
    group = np.cumsum(np.concatenate([[0], node[1:] != node[:-1]]))
    # second level: one entry per child that the bound allows; nodes stored there already keep their place
    times = np.where(depth == 1, np.minimum(child, left), 0)
    row = np.repeat(np.arange(len(keep)), times)
    step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    deep = (group[row] << 16) | grams[row, step]
    here = np.flatnonzero((depth == 2) | (part == 1))
    for key, of, first in ((deep, row, step + 1), (group[here], here, np.zeros(len(here), np.int64))):
        order = np.argsort(key, kind="stable")
        key, of, first = key[order], of[order], first[order]
        for x, y in _pairs_of(key):
            p, q = of[x], of[y]
            a, b, fa, fb = part[p], part[q], first[x], first[y]
            shared = np.minimum(2, np.minimum(a, b))
            need = u / (1 + u) * (a + b) - 1e-9
            ok = (rep[p] != rep[q]) & (np.minimum(width[p], width[q]) >= t * np.maximum(width[p], width[q]) - 1e-9) & (shared + np.minimum(left[p] - fa, left[q] - fb) >= need)
            p, q, fa, fb, need, shared = p[ok], q[ok], fa[ok], fb[ok], need[ok], shared[ok]
            if len(p):
                at = np.arange(grams.shape[1])
                ga, gb = np.where(at >= fa[:, None], grams[p], -1), np.where(at >= fb[:, None], grams[q], -2)
                more = ((ga[:, :, None] == gb[:, None, :]) & (ga[:, :, None] >= 0)).any(2).sum(1)
                p, q = p[shared + more >= need], q[shared + more >= need]
                yield np.unique(np.stack([np.minimum(rep[p], rep[q]), np.maximum(rep[p], rep[q])], axis=1), axis=0)


def candidates(nodes: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: pairs of sets that meet below a node with enough shared grams in their part; a pair may come several times."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(table):
            cols = [table.column(i).combine_chunks() for i in range(4)]
            for pairs in descend(*(c.to_numpy() for c in cols[:3]), cols[3], t):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            node = table.column(0).to_numpy()
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            yield from work(table.slice(0, cut)) if cut else ()
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))

    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, k: int, t: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach t on their full sets. pairs: (a, b, seq_a, seq_b)."""

    def run(batches):
        for batch in batches:
            for c in row_chunks(batch, 2, 1 << 19):
                ra, ga = _grams(c.column(2), k)
                rb, gb = _grams(c.column(3), k)
                m = c.num_rows
                na, nb = np.bincount(ra, minlength=m), np.bincount(rb, minlength=m)
                row, g = np.concatenate([ra, rb]), np.concatenate([ga, gb])
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                same = (row[1:] == row[:-1]) & (g[1:] == g[:-1])
                both = np.bincount(row[1:][same], minlength=m)
                sim = both / np.maximum(1, na + nb - both)
                ok = np.flatnonzero((both > 0) & (sim >= t - 1e-12))
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(ok)), c.column(1).take(pa.array(ok)), pa.array(sim[ok])], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "seq_a", "seq_b").mapInArrow(run, "a long, b long, similarity double")


def similar_classes(classes: DataFrame, k: int = 12, t: float = 0.6) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of distinct sequences whose sets of k-grams have Jaccard similarity t or more.

    k <= 12, 0.5 < t <= 1. Sequences with fewer than k symbols have no grams and no partners."""
    if not 1 <= k <= 12 or not 0.5 < t <= 1:
        raise ValueError("k must lie in 1..12 and t in (0.5, 1]")
    counts = classes.sparkSession.sparkContext.broadcast(gram_counts(classes, k))
    symbols = classes.agg(F.sum(F.length("seq"))).first()[0] or 0
    with shuffle_for(classes.sparkSession, symbols):  # nodes: about one a symbol
        pairs = write_table(candidates(tree_nodes(classes, counts, k, t), t).distinct(), "neardup-candidates")
    left = join_unique(pairs, classes.select(F.col("rep").alias("a"), F.col("seq").alias("seq_a")), "a")
    partners = classes.select(F.col("rep").alias("b"), F.col("seq").alias("seq_b")).join(pairs.groupBy("b").agg(F.count("*").alias("n_pairs")), "b")
    return _verify(join_unique(left, partners, "b", "n_pairs"), k, t)


def near_pairs(df: DataFrame, k: int = 12, t: float = 0.6, id_col: str = "record_id", seq_col: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, classes, members): links between distinct sequences as in similar_classes, classes and members as in sequence_classes.
    Copies of one sequence are related by their class and are not expanded here."""
    classes, members = sequence_classes(df, id_col, seq_col)
    return write_table(similar_classes(classes, k, t), "neardup-links"), classes, members


def record_pairs(df: DataFrame, k: int = 12, t: float = 0.6, id_col: str = "record_id", seq_col: str = "seq") -> DataFrame:
    """(a, b): all pairs of record ids, copies included, with a < b. Null, empty and too short sequences have no pairs."""
    links, classes, members = near_pairs(df, k, t, id_col, seq_col)
    own = classes.where(f"n > 1 and length(seq) >= {k}").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    every = links.select("a", "b").unionByName(own)
    m = members.select("id", "rep")
    both = every.join(m.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(m.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b")
    return both.where("a <> b or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(df: DataFrame, k: int = 12, t: float = 0.6, id_col: str = "record_id", seq_col: str = "seq") -> DataFrame:
    """One row per record with a non-empty sequence: its class (smallest id of its copies), its group (smallest id of all records
    connected by links), the copies of its class and the links of its class to other classes."""
    links, classes, members = near_pairs(df, k, t, id_col, seq_col)
    _, labels = spanning_forest(links.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("w")))
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    rooted = write_table(classes.select("rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "neardup-roots")
    first = rooted.groupBy("root").agg(F.min("rep").alias("group_id"))
    per = join_unique(rooted, first, "root").join(ends, "rep", "left").select("rep", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    per = write_table(per.join(classes.select("rep", F.col("n").alias("copies")), "rep"), "neardup-classes")
    return join_unique(members, per, "rep", "copies").select(F.col("id").alias(id_col), F.col("rep").alias("class_id"), "group_id", F.col("n").alias("n_copies"), "n_links")
