"""Same or near-same records across splits (problem 4): pairs within an edit distance.

Method: exact prefix-filter bipartite join on rare shingles. Of each evaluation text the prefix is indexed: the k+1 rarest shingles
that don't overlap each other - k edits can break at most k of them, so one stays whole in any text within distance k. The
training texts are probed with all their shingles - those that no indexed one can equal are dropped before the shuffle by a filter of
bounded size (see bloom) -; a length filter (difference <= k) and a position filter (shift <= k) thin the
hits, and the edit distance of every distinct candidate pair is verified. No pair is lost.

Rarity comes from counts over all texts in RARITY hash buckets - a table of constant size, whatever the data. Texts are compared
once per distinct spelling and split; copies come back in at the end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.functions.arrays import mix64, string_bytes, window_ok
from exonloom.llm import bloom
from exonloom.runtime import join_unique, write_table

#: Hash buckets of the shingle counts; the only thing that is broadcast (8 bytes each).
RARITY = 1 << 18
#: Longest shingle; shorter texts use shorter ones.
MAX_Q = 11
EMIT = 1 << 19


def canon_window(c: Column) -> Column:
    """Trimmed of whitespace of any kind, in upper case."""
    return F.upper(F.regexp_replace(c, r"(?U)^[\s]+|[\s]+$", ""))


def shingle_size(n: np.ndarray, k: int, max_q: int) -> np.ndarray:
    """Longest shingle of which k+1 fit into n symbols without overlap, at most max_q; 0 for texts shorter than k+1."""
    return np.minimum(max_q, n // (k + 1))


def _hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes from each position on (polynomial, then mixed with q)."""
    h = np.zeros(len(raw), np.uint64)
    m = len(raw) - q + 1
    if m > 0 and q > 0:
        acc = np.zeros(m, np.uint64)
        for j in range(q):
            acc = acc * np.uint64(0x100000001B3) + raw[j : j + m].astype(np.uint64) + np.uint64(1)
        h[:m] = acc
    return mix64(h + np.uint64(q * 0x9E3779B97F4A7C15 % (1 << 64)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(RARITY)


def _sizes_probed(n: int, k: int, max_q: int) -> list[int]:
    """Shingle sizes under which an evaluation text within the length filter of n may be indexed."""
    return sorted({int(min(max_q, max(0, m) // (k + 1))) for m in range(n - k, n + k + 1)})


def shingle_counts(texts: DataFrame, k: int, max_q: int) -> np.ndarray:
    """How many shingles of all texts fall into each bucket. Partial counts are summed on the executors; the driver receives at
    most RARITY sums."""

    def count(batches):
        total = np.zeros(RARITY, np.int64)
        for b in batches:
            raw, off = string_bytes(b.column(0))
            size = np.repeat(shingle_size(np.diff(off), k, max_q), np.diff(off))
            for q in np.unique(size):
                if q:
                    h = _hashes(raw, int(q))
                    total += np.bincount(_bucket(h[(size == q) & window_ok(off, int(q))]).astype(np.int64), minlength=RARITY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY, np.int32)
    out[got.column("bucket").to_numpy()] = np.minimum(got.column("n").to_numpy(), (1 << 31) - 1)
    return out


def _rare_prefix(cost: np.ndarray, q: int, picks: int) -> np.ndarray:
    """For texts of one length (cost: texts x positions), the `picks` non-overlapping positions of least total cost."""
    n, m = cost.shape
    best = np.zeros((picks + 1, n, m + 1))
    best[1:, :, 0] = np.inf
    for p in range(1, picks + 1):
        for i in range(1, m + 1):
            before = best[p - 1, :, max(0, i - q)] if i - q >= 0 or p == 1 else np.full(n, np.inf)
            take = before + cost[:, i - 1]
            best[p, :, i] = np.minimum(best[p, :, i - 1], take)
    out = np.zeros((n, picks), np.int64)
    at = np.full(n, m)
    for p in range(picks, 0, -1):
        # the earliest end with the best value is where the last shingle was taken
        b = best[p]
        val = b[np.arange(n), at]
        cols = np.arange(m + 1)[None, :]
        first = np.argmax((b <= val[:, None]) & (cols <= at[:, None]), axis=1)
        out[:, p - 1] = first - 1
        at = np.maximum(first - q, 0)
    return out


def _batch(key, tid, pos, n):
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tid), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "tid", "pos", "n"])


_HITS = "key long, tid long, pos int, n int"


def index_prefixes(texts: DataFrame, counts, k: int, max_q: int) -> DataFrame:
    """(key, tid, pos, n) of the k+1 rarest disjoint shingles of each text."""

    def run(batches):
        rarity = counts.value
        for b in batches:
            raw, off = string_bytes(b.column(1))
            tid, length = b.column(0).to_numpy(), np.diff(off)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                q = int(shingle_size(np.array([n]), k, max_q)[0])
                if q == 0:  # too short for k+1 shingles: one common key, the length filter applies
                    key = np.full(len(rows), _hashes(np.zeros(1, np.uint8), 0)[0])
                    yield _batch(key, tid[rows], np.zeros(len(rows)), np.full(len(rows), n))
                    continue
                h = _hashes(raw, q)
                m = int(n) - q + 1
                at = off[rows][:, None] + np.arange(m)[None, :]
                pos = _rare_prefix(1.0 + rarity[_bucket(h[at]).astype(np.int64)], q, k + 1)
                key = h[off[rows][:, None] + pos]
                yield _batch(key.ravel(), np.repeat(tid[rows], k + 1), pos.ravel(), np.full(pos.size, n))

    return texts.select("tid", "text").mapInArrow(run, _HITS)


def probe_shingles(texts: DataFrame, k: int, max_q: int, sizes: set[int], sent) -> DataFrame:
    """(key, tid, pos, n) of the shingles of each text, in the sizes that an index entry within the length filter can have, that pass the
    index's filter (sent, a broadcast)."""

    def run(batches):
        for b in batches:
            raw, off = string_bytes(b.column(1))
            tid, length = b.column(0).to_numpy(), np.diff(off)
            row = np.repeat(np.arange(len(length)), length)
            hashed = {}
            for n in np.unique(length):
                for q in _sizes_probed(int(n), k, max_q):
                    if q not in sizes:
                        continue
                    if q == 0:
                        rows = np.flatnonzero(length == n)
                        yield _batch(np.full(len(rows), _hashes(np.zeros(1, np.uint8), 0)[0]), tid[rows], np.zeros(len(rows)), np.full(len(rows), n))
                        continue
                    if q not in hashed:
                        hashed[q] = _hashes(raw, q), window_ok(off, q)
                    h, ok = hashed[q]
                    at = np.flatnonzero(ok & (length[row] == n))
                    at = at[bloom.passing(sent.value, h[at])]
                    for i in range(0, len(at), EMIT):
                        s = at[i : i + EMIT]
                        yield _batch(h[s], tid[row[s]], s - off[row[s]], np.full(len(s), n))

    return texts.select("tid", "text").mapInArrow(run, _HITS)


def near_texts(left: DataFrame, right: DataFrame, k: int = 4, max_q: int = MAX_Q) -> DataFrame:
    """All (tid_l, tid_r, distance) of texts within k insertions, deletions or replacements. Both sides: (tid, text) of distinct,
    non-empty texts; `right` is the evaluation side that is indexed. Case and blanks are taken as they are."""
    spark = left.sparkSession
    whole = {"l": left, "r": right}
    left, right = (x.select("tid", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text")) for x in (left, right))  # one byte a symbol
    counts = spark.sparkContext.broadcast(shingle_counts(left.unionByName(right), k, max_q))
    sizes = {r[0] for r in right.select(F.least(F.lit(max_q), F.floor(F.length("text") / (k + 1))).cast("int").alias("q")).distinct().collect()}  # at most max_q + 1 numbers
    index = write_table(index_prefixes(right, counts, k, max_q).withColumnsRenamed({"tid": "tid_r", "pos": "pos_r", "n": "n_r"}), "split-index")
    probes = probe_shingles(left, k, max_q, sizes, spark.sparkContext.broadcast(bloom.build(index))).withColumnsRenamed({"tid": "tid_l", "pos": "pos_l", "n": "n_l"})
    hits = join_unique(write_table(probes, "split-probes"), index, "key").where((F.abs(F.col("n_l") - F.col("n_r")) <= k) & (F.abs(F.col("pos_l") - F.col("pos_r")) <= k))
    pairs = write_table(hits.select("tid_l", "tid_r").distinct(), "split-candidates")
    both = join_unique(pairs, whole["l"].select(F.col("tid").alias("tid_l"), F.col("text").alias("text_l")), "tid_l")
    partners = whole["r"].select(F.col("tid").alias("tid_r"), F.col("text").alias("text_r")).join(pairs.groupBy("tid_r").agg(F.count("*").alias("n_pairs")), "tid_r")
    both = join_unique(both, partners, "tid_r", "n_pairs")
    return both.withColumn("distance", F.levenshtein("text_l", "text_r", k)).where("distance >= 0").select("tid_l", "tid_r", "distance")


def linked_texts(df: DataFrame, k: int = 4, split: tuple[str, str] = ("train", "test")) -> tuple[DataFrame, DataFrame]:
    """(links, members): the overlaps between distinct texts of two splits (tid_l, tid_r, distance), and (sample_id, split, tid, copies)
    for each sample's text, copies counting the samples' rows with that text."""
    rows = df.select("sample_id", "split", canon_window(F.col("win")).alias("text")).where("text <> '' and split in ('%s', '%s')" % split).distinct()
    rows = write_table(rows.withColumn("text_key", F.concat_ws(":", "split", "text")), "split-rows")
    texts = write_table(rows.groupBy("text_key", "split", "text").agg(F.min("sample_id").alias("tid"), F.count("*").alias("n")), "split-texts")
    side = [texts.where(F.col("split") == s).select("tid", "text") for s in split]
    members = join_unique(rows.select("sample_id", "split", "text_key"), texts.select("text_key", "tid", F.col("n").alias("copies"), "n"), "text_key", "n")
    return write_table(near_texts(side[0], side[1], k), "split-pairs"), write_table(members.drop("text_key"), "split-members")


def overlaps(df: DataFrame, k: int = 4, split: tuple[str, str] = ("train", "test")) -> DataFrame:
    """All overlaps between two splits: train_id, test_id, distance, one row per pair of sample ids.

    Null and blank windows match nothing. Rows delivered again (same sample_id and window) count once. Symbols outside
    ASCII are told apart only in the final distance."""
    links, members = linked_texts(df, k, split)
    m = [members.where(F.col("split") == s).select(F.col("tid").alias(t), F.col("sample_id").alias(i)) for s, t, i in ((split[0], "tid_l", "train_id"), (split[1], "tid_r", "test_id"))]
    left = write_table(join_unique(links, m[0], "tid_l"), "split-expanded")
    return join_unique(left, m[1], "tid_r").select("train_id", "test_id", "distance")


def overlap_report(df: DataFrame, k: int = 4, split: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Overlaps per split, label and source: pairs, affected samples and exact ones; a null source is its own group. Pairs are counted
    from links and copies, not expanded."""
    links, members = linked_texts(df, k, split)
    copies = members.select("split", "tid", "copies").distinct()
    per = []
    for s, own, other in ((split[0], "tid_l", "tid_r"), (split[1], "tid_r", "tid_l")):
        far = copies.where(F.col("split") != s).select(F.col("tid").alias(other), "copies")
        n = join_unique(links, far, other).groupBy(own).agg(F.sum("copies").alias("links"), F.sum(F.when(F.col("distance") == 0, F.col("copies")).otherwise(0)).alias("exact"))
        per.append(n.select(F.lit(s).alias("split"), F.col(own).alias("tid"), "links", "exact"))
    counted = per[0].unionByName(per[1]).withColumn("text_key", F.concat_ws(":", "split", "tid"))
    rows = members.select("sample_id", "copies", F.concat_ws(":", "split", "tid").alias("text_key"))
    weights = counted.select("text_key", "links", "exact").join(rows.groupBy("text_key").agg(F.max("copies").alias("n")), "text_key")
    each = join_unique(rows.drop("copies"), write_table(weights, "split-counts"), "text_key", "n").groupBy("sample_id").agg(F.sum("links").alias("links"), F.sum("exact").alias("exact"))
    who = df.groupBy("sample_id").agg(F.first("split").alias("split"), F.first("label").alias("label"), F.first("source", True).alias("source"))
    return each.join(who, "sample_id").groupBy("split", "label", "source").agg(F.count("*").alias("n_samples"), F.sum("links").alias("n_pairs"), F.sum("exact").alias("n_exact"))
