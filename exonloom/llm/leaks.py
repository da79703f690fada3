"""Evaluation texts leaking into training text (problem 7).

Method: spaced-seed hashing. A mask keeps some words of a span and ignores those between them; the hash of the words that a mask
keeps is computed at every position of every document and every test item, and equal hashes are joined. Around each hit the
document and the item are laid side by side and their overlap is verified word by word, tolerating substitutions: the longest run
of equal words, and the longest stretch in which no two words in a row differ.

In such a stretch the next equal word is one or two words further. A mask is a word of such steps, and GAPS is a set of words of
which each sequence of 12 steps contains one: any stretch with 13 equal words is hit, wherever its differing words stand. Stretches
with fewer equal words are found by all words of three steps (or of fewer, for less than four equal words).

Both sides are hashed on the executors. The test side's hashes are a table; a Bloom filter of them, of bounded size, lets the
corpus emit only documents with hits - their words and hits, once - so that the corpus is read once and not shuffled, however many
items there are. Hits and index are then joined as relations, hot hashes salted, and the verification follows the join. Items of
one text are collapsed before and expanded after it."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.functions.arrays import mix64, row_chunks, string_bytes
from exonloom.llm import bloom
from exonloom.runtime import join_unique, write_table

SPAN = 13
#: Steps between the words that a mask keeps; every sequence of SPAN - 1 steps of 1 or 2 contains one of these.
GAPS = ("11111", "11112", "12112", "12121", "12122", "12212", "12222", "21111", "21112", "22112", "22212", "22222")
_P = np.uint64(0x100000001B3)
_P_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = max(n, 1 << 20)
        one = np.ones(1, np.uint64)
        _pow["p"] = np.concatenate([one, np.cumprod(np.full(size, _P))])
        _pow["i"] = np.concatenate([one, np.cumprod(np.full(size, _P_INV))])
    return _pow["p"], _pow["i"]


def words(col) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words - runs of a-z and 0-9 - of lower-cased texts, in order."""
    raw, off = string_bytes(col)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = _WORD[raw]
    before = np.concatenate([[False], w[:-1]])
    first = off[:-1][np.diff(off) > 0]
    before[first] = False
    after = np.concatenate([w[1:], [False]])
    after[first[1:] - 1] = False
    start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    p, inv = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n])])
    h = mix64((total[end] - total[start]) * inv[start])
    return h, np.searchsorted(off, start, side="right") - 1


def masks(least: int) -> list[np.ndarray]:
    """Offsets of the words that each mask keeps; together they hit every stretch of at least `least` equal words."""
    steps = GAPS if least >= SPAN else product("12", repeat=max(0, min(least, 4) - 1))
    return [np.cumsum([0, *map(int, g)]) for g in steps]


def seeds(h: np.ndarray, row: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the masked windows that lie within one row."""
    span = int(mask[-1]) + 1
    m = len(h) - span + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = mix64(np.arange(1, span + 1, dtype=np.uint64)) | np.uint64(1)
    acc = np.zeros(m, np.uint64)
    for k in mask.tolist():
        acc += h[k : k + m] * c[k]
    at = np.flatnonzero(row[span - 1 :] == row[:m])
    return mix64(acc[at]), at


def _keys(h: np.ndarray, row: np.ndarray, kept: list[np.ndarray]):
    """(hashes, positions) of every mask's windows; each mask has its own hashes."""
    for k, mask in enumerate(kept):
        s, at = seeds(h, row, mask)
        yield mix64(s + np.uint64(k)), at


def index_items(texts: DataFrame, kept: list[np.ndarray]) -> DataFrame:
    """(key, item, at): the masked windows of each distinct item text."""

    def run(batches):
        for b in (c for x in batches for c in row_chunks(x, 1)):
            item = b.column(0).to_numpy()
            h, row = words(b.column(1))
            begin = np.searchsorted(row, np.arange(len(item)))
            for key, at in _keys(h, row, kept):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(item[row[at]]), pa.array((at - begin[row[at]]).astype(np.int32))], names=["key", "item", "at"])

    return texts.select("item", "text").mapInArrow(run, "key long, item long, at int")


def documents_with_hits(docs: DataFrame, sent, kept: list[np.ndarray]) -> DataFrame:
    """(uid, doc_id, words, keys, ats): documents in which some masked window passes the filter, their words' hashes and those windows.
    docs: (uid, doc_id, text)."""

    def run(batches):
        for b in (c for x in batches for c in row_chunks(x, 2)):
            h, row = words(b.column(2))
            begin = np.searchsorted(row, np.arange(b.num_rows + 1))
            keys, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for key, at in _keys(h, row, kept):
                ok = bloom.passing(sent.value, key)
                keys.append(key[ok])
                ats.append(at[ok])
            key, at = np.concatenate(keys), np.concatenate(ats)
            order = np.argsort(at, kind="stable")
            key, at = key[order], at[order]
            hit = np.unique(row[at])
            if not len(hit):
                continue
            mine = np.isin(row, hit)
            lists = lambda n, v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v))
            n_keys = np.bincount(np.searchsorted(hit, row[at]), minlength=len(hit))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(hit)), b.column(1).take(pa.array(hit)), lists((begin[1:] - begin[:-1])[hit], h[mine].view(np.int64)), lists(n_keys, key.view(np.int64)), lists(n_keys, (at - begin[row[at]]).astype(np.int32))],
                names=["uid", "doc_id", "words", "keys", "ats"],
            )

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, words array<long>, keys array<long>, ats array<int>")


def _verified(same: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest run of equal words, and equal words in the best stretch without two differing words in a row, of each segment of
    `same`; first: where the segments begin (none is empty)."""
    starts = np.zeros(len(same) + 1, bool)
    starts[first] = starts[-1] = True
    old = np.concatenate([[False], same[:-1]])
    begin = np.flatnonzero(same & (starts[:-1] | ~old))
    end = np.flatnonzero(same & (starts[1:] | ~np.concatenate([same[1:], [False]]))) + 1
    exact, loose = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    if len(begin):
        run, seg = end - begin, np.searchsorted(first, begin, side="right") - 1
        np.maximum.at(exact, seg, run)
        cut = np.concatenate([[0], np.flatnonzero((begin[1:] - end[:-1] > 1) | (np.diff(seg) > 0)) + 1])
        np.maximum.at(loose, seg[cut], np.add.reduceat(run, cut))
    return exact, loose


def _measured(laid: DataFrame) -> DataFrame:
    """laid with `exact` and `loose` in the place of `same`, the equality of the words laid side by side."""
    keep = [c for c in laid.columns if c != "same"]

    def run(batches):
        for b in batches:
            same = b.column(0)
            first = same.offsets.to_numpy().astype(np.int64)
            exact, loose = _verified(same.flatten().to_numpy(zero_copy_only=False), first[:-1] - first[0])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(exact), pa.array(loose)], names=[*keep, "exact", "loose"])

    return laid.select("same", *keep).mapInArrow(run, laid.select(*keep, F.lit(0).cast("long").alias("exact"), F.lit(0).cast("long").alias("loose")).schema)


def leaks(docs: DataFrame, items: DataFrame, min_words: int = SPAN, tolerant_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, exact_words, tolerant_words): documents that contain `min_words` (SPAN at least) consecutive words of an
    item, or, if tolerant_words is given, a stretch of an item with at least so many equal words in which single words may differ,
    at whatever spacing. Both columns are the pair's largest; an exact_words under SPAN is that of the stretches that were met.

    docs: doc_id, text; items: item_id, text. Words are the runs of a-z and 0-9 of the lower-cased text. Null, empty and short texts
    leak nothing. Rows that occur twice in either table do not repeat in the result."""
    if min_words < SPAN:
        raise ValueError(f"min_words must be {SPAN} at least")
    kept = masks(min(min_words, tolerant_words or min_words))
    items = items.where("item_id is not null and text is not null").select("item_id", F.lower("text").alias("text")).distinct()
    items = write_table(items, "leak-items")
    texts = write_table(items.select("text").distinct().withColumn("item", F.xxhash64("text")), "leak-texts")
    index = write_table(index_items(texts, kept), "leak-index")
    sent = docs.sparkSession.sparkContext.broadcast(bloom.build(index))
    docs = docs.where("text is not null").select("doc_id", F.lower("text").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    met = write_table(documents_with_hits(docs, sent, kept).dropDuplicates(["uid", "doc_id"]), "leak-documents")
    hits = met.select("uid", "doc_id", F.explode(F.arrays_zip("keys", "ats")).alias("x")).select("uid", "doc_id", F.col("x.keys").alias("key"), F.col("x.ats").alias("p"))
    near = write_table(hits.join(index, "key", "left_semi"), "leak-hits")  # what the filter let through by chance goes
    diagonals = join_unique(near, index, "key").select("uid", "doc_id", "item", (F.col("p") - F.col("at")).alias("d")).distinct()
    both = join_unique(write_table(diagonals, "leak-diagonals"), _word_lists(texts), "item").join(met.select("uid", "doc_id", "words"), ["uid", "doc_id"])
    first = F.greatest(F.lit(0), F.col("d"))
    n = F.least(F.size("words"), F.size("item_words") + F.col("d")) - first
    same = F.zip_with(F.slice("words", first + 1, n), F.slice("item_words", first - F.col("d") + 1, n), lambda a, b: a == b)
    found = _measured(both.where(n > 0).select("doc_id", "item", same.alias("same"))).groupBy("doc_id", "item").agg(F.max("exact").alias("exact_words"), F.max("loose").alias("tolerant_words"))
    found = found.where((F.col("exact_words") >= min_words) | (F.col("tolerant_words") >= (tolerant_words or 1 << 62)))
    members = items.select("item_id", F.xxhash64("text").alias("item"))
    return join_unique(write_table(found, "leak-pairs"), members, "item").groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), F.max("tolerant_words").alias("tolerant_words"))


def _word_lists(texts: DataFrame) -> DataFrame:
    """(item, item_words): the hashes of each item's words, in order."""

    def run(batches):
        for b in (c for x in batches for c in row_chunks(x, 1)):
            h, row = words(b.column(1))
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["item", "item_words"])

    return texts.select("item", "text").mapInArrow(run, "item long, item_words array<long>")


def leaked_items(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Per test item: documents and sources that contain passages of it, and the longest overlap; zeros for items that didn't leak."""
    found = write_table(leaks(docs, items, **how), "leaks")
    per = found.join(docs.select("doc_id", "source"), "doc_id").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.max("tolerant_words").alias("longest"))
    return items.select("item_id", "suite", "eval_split").join(per, "item_id", "left").select("item_id", "suite", "eval_split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_sources", "longest")])
