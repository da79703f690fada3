"""Long exact spans shared between records (problem 3).

Method: fixed-block anchors. Of every distinct sequence the non-overlapping blocks of BLOCK symbols are indexed, one row per block
text. Every rolling window of BLOCK symbols of every sequence probes the index; a hit in another record is an anchor. As
BLOCK is at most 32 and 2 * BLOCK - 1 <= length, each shared run of `length` symbols holds a whole block, so no run escapes. Anchors are extended to both
sides: each run of `length` symbols around an anchor is looked up, exactly, among the runs of the others, and confirmed runs grow
together to maximal repeats.

No pairs are made at any point: a block, and likewise a run, keeps only the smallest and the largest record that has it, which
decides for every prober whether another record has it too. So a sequence family that holds a third of all records costs as much
as any other rows. Codes of ACGT runs are exact (2 bits a symbol, in words of up to 32 symbols), not hashes; runs with other symbols
are never shared. Windows that no block can match are dropped before the shuffle by a filter of bounded size (see bloom)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.functions.arrays import mix64, row_chunks, string_bytes, window_codes, window_ok
from exonloom.functions.symbols import letters
from exonloom.llm import bloom
from exonloom.runtime import join_unique, write_table

EMIT = 1 << 20
_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i


def sequence_classes(df: DataFrame, id_col: str = "record_id", seq_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row (rep, n, seq) per distinct non-empty cleaned sequence, and (id, rep, n) per record.

    Copies are collapsed here, with map-side combining, so that everything after it works on distinct texts."""
    src = df.select(F.col(id_col).alias("id"), letters(F.col(seq_col)).alias("seq")).where("seq <> ''").withColumn("seq_key", F.sha2("seq", 256))
    classes = write_table(src.groupBy("seq_key", "seq").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")), "sequence-classes")
    members = join_unique(src.select("id", "seq_key").distinct(), classes.select("seq_key", "rep", F.col("n").alias("copies"), "n"), "seq_key", "copies")
    return classes.select("rep", "n", "seq"), members.select("id", "rep", "n")


def _coded(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, off = string_bytes(col)
    code = _CODE[raw]
    bad = np.concatenate([[0], np.cumsum(code == 255)])
    return np.where(code == 255, 0, code), off, bad


def _clean_windows(off: np.ndarray, bad: np.ndarray, width: int) -> np.ndarray:
    ok = window_ok(off, width)
    i = np.flatnonzero(ok)
    return i[bad[i + width] == bad[i]]


def _anchors(classes: DataFrame, block: int, step: int, sent=None) -> DataFrame:
    """(key, rep, pos) of the windows of `block` symbols at every `step`-th position; key is the window's exact code, mixed one-to-one.
    sent: a broadcast filter that the keys must pass."""

    def run(batches):
        for b in (c for x in batches for c in row_chunks(x, 1)):
            code, off, bad = _coded(b.column(1))
            rep = b.column(0).to_numpy()
            row = np.repeat(np.arange(len(rep)), np.diff(off))
            at = _clean_windows(off, bad, block)
            if step > 1:
                at = at[(at - off[row[at]]) % step == 0]
            keys = mix64(window_codes(code, block, 2)[at])
            if sent is not None:
                ok = bloom.passing(sent.value, keys)
                at, keys = at[ok], keys[ok]
            for i in range(0, len(at), EMIT):
                s = at[i : i + EMIT]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + EMIT].view(np.int64)), pa.array(rep[row[s]]), pa.array((s - off[row[s]]).astype(np.int32))], names=["key", "rep", "pos"])

    return classes.select("rep", "seq").mapInArrow(run, "key long, rep long, pos int")


def word_names(length: int) -> list[str]:
    """Columns of the words of up to 32 symbols that cover a run."""
    return [f"w{k}" for k in range(max(2, -(-length // 32)))]


def _runs(found: DataFrame, length: int, block: int) -> DataFrame:
    """(w0, w1, ..., rep, start): the runs of `length` symbols that hold an anchor; the w are the exact codes of the words, of one length,
    that cover them. found: (rep, seq, anchors array<int>)."""
    names = word_names(length)
    size = -(-length // len(names))
    begins = [min(k * size, length - size) for k in range(len(names))]

    def run(batches):
        for b in (c for x in batches for c in row_chunks(x, 1)):
            code, off, bad = _coded(b.column(1))
            rep = b.column(0).to_numpy()
            row = np.repeat(np.arange(len(rep)), np.diff(off))
            lists = b.column(2)
            per = np.diff(lists.offsets.to_numpy())
            anchor = off[:-1].repeat(per) + lists.flatten().to_numpy()
            last = length - block  # a run that begins up to `last` before an anchor holds it
            edge = np.zeros(len(code) + 1, np.int32)
            np.add.at(edge, np.maximum(anchor - last, off[:-1].repeat(per)), 1)
            np.add.at(edge, anchor + 1, -1)
            near = np.cumsum(edge)[:-1] > 0
            at = _clean_windows(off, bad, length)
            at = at[near[at]]
            codes = window_codes(code, size, 2).view(np.int64)
            for i in range(0, len(at), EMIT):
                s = at[i : i + EMIT]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(codes[s + k]) for k in begins), pa.array(rep[row[s]]), pa.array((s - off[row[s]]).astype(np.int32))],
                    names=[*names, "rep", "start"],
                )

    return found.select("rep", "seq", "anchors").mapInArrow(run, ", ".join([*(f"{w} long" for w in names), "rep long", "start int"]))


def _maximal(df: DataFrame, length: int) -> DataFrame:
    """(rep, spans) from (rep, n, seq, starts): overlapping and touching runs are joined; of a copied sequence every run counts."""

    def run(batches):
        for b in (c for x in batches for c in row_chunks(x, 2)):
            rep, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            code, off, bad = _coded(b.column(2))
            row = np.repeat(np.arange(len(rep)), np.diff(off))
            lists = b.column(3).fill_null([])
            per = np.diff(lists.offsets.to_numpy())
            start = off[:-1].repeat(per) + lists.flatten().to_numpy()
            own = _clean_windows(off, bad, length)
            start = np.unique(np.concatenate([start, own[n[row[own]] > 1]])).astype(np.int64)
            if not len(start):
                continue
            new = np.ones(len(start), bool)
            new[1:] = (np.diff(start) > length) | (np.diff(row[start]) != 0)
            a = start[new]
            z = start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])] + length
            at = row[a]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array((a - off[at] + 1).astype(np.int32)), pa.array((z - off[at]).astype(np.int32))], names=["rep", "span_start", "span_end"])

    flat = df.select("rep", "n", "seq", "starts").mapInArrow(run, "rep long, span_start int, span_end int")
    return flat


def shared_spans(df: DataFrame, length: int = 50, id_col: str = "record_id", seq_col: str = "seq") -> DataFrame:
    """(id, span_start, span_end): the maximal stretches of each cleaned sequence that lie in runs of `length` symbols, all of ACGT,
    which also occur in another record; 1-based, inclusive. length: 2 or more.

    Null and empty sequences have none. Sequences shorter than `length`, or broken by N, have none there. A record that is
    delivered several times under one id counts once."""
    if length < 2:
        raise ValueError("length must be 2 at least")
    block = min(32, (length + 1) // 2)
    classes, members = sequence_classes(df, id_col, seq_col)
    index = write_table(_anchors(classes, block, block).groupBy("key").agg(F.min("rep").alias("lo_rep"), F.max("rep").alias("hi_rep")), "span-index")
    probes = _anchors(classes, block, 1, classes.sparkSession.sparkContext.broadcast(bloom.build(index)))
    hits = probes.join(index, "key").where("rep <> lo_rep or rep <> hi_rep").groupBy("rep").agg(F.collect_list("pos").alias("anchors"))
    hits = write_table(hits, "span-anchors")  # positions within one record: as many as it has symbols at most
    runs = _runs(hits.join(classes, "rep"), length, block)
    words = word_names(length)
    shared = runs.groupBy(*words).agg(F.min("rep").alias("lo_rep"), F.max("rep").alias("hi_rep")).where("lo_rep <> hi_rep").select(*words)
    starts = runs.join(shared, words).groupBy("rep").agg(F.collect_list("start").alias("starts"))
    spans = _maximal(classes.join(starts, "rep", "left").where("n > 1 or starts is not null"), length)
    per = write_table(spans.groupBy("rep").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"), F.lit(1).alias("one")), "spans")
    per = per.join(classes.select("rep", F.col("n").alias("copies")), "rep")
    out = join_unique(members.select("id", "rep"), per.select("rep", "spans", "copies"), "rep", "copies")
    return out.select(F.col("id").alias(id_col), F.inline("spans"))


def shared_amount(df: DataFrame, spans: DataFrame, id_col: str = "record_id", seq_col: str = "seq") -> DataFrame:
    """Per record with a non-empty sequence: its symbols, the shared ones and their share; 0 for records that share nothing."""
    size = df.select(id_col, F.length(letters(F.col(seq_col))).alias("n_symbols")).where("n_symbols > 0").distinct()
    amount = spans.groupBy(id_col).agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start") + 1).alias("n_shared"))
    return size.join(amount, id_col, "left").select(id_col, "n_symbols", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("n_shared", F.lit(0)).alias("n_shared")).withColumn("shared_part", F.col("n_shared") / F.col("n_symbols"))
