"""Windows over symbol sequences: every position, motif windows, windows at interval ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.functions.symbols import acgt, valid_window
from exonloom.spec import SiteSpec

#: Windows that begin in one chunk of a sequence.
CHUNK = 1 << 16
#: Symbols beyond which the chunks of one sequence are spread over tasks.
LONG = 1 << 20


def sequences(records: DataFrame, id_col: str = "record_id", seq_col: str = "seq") -> DataFrame:
    """(id, s, ranges if there): ACGT only, in upper case; null and empty sequences are left out. Removing N shifts what follows it."""
    keep = [c for c in ("ranges",) if c in records.columns]
    return records.select(id_col, acgt(F.col(seq_col)).alias("s"), *keep).where("s <> ''")


def chunks(seqs: DataFrame, id_col: str, length: int, before: int = 0, after: int = 0) -> DataFrame:
    """(id, i0, k0, b): each sequence as bytes in overlapping chunks, so that every window of `length`, with `before` and `after` symbols
    around it, lies in one; i0 is the 0-based start of the chunk's own windows in the sequence, k0 their start in the chunk.

    Sequences are ASCII. A place in bytes is found at once, while looking into a string costs the way from its start, so the work is
    linear in the symbols. Chunks of sequences over LONG symbols are spread over tasks; the others stay where they are read."""
    ok = seqs.select(id_col, F.col("s").cast("binary").alias("s")).where(F.length("s") >= length)

    def cut(x: DataFrame) -> DataFrame:
        at = x.select(id_col, "s", F.explode(F.when(F.length("s") >= length, F.sequence(F.lit(0), F.length("s") - length, F.lit(CHUNK)))).alias("i0"))
        k0 = F.least(F.col("i0"), F.lit(before))
        return at.select(id_col, "i0", k0.alias("k0"), F.substring("s", F.col("i0") - k0 + 1, k0 + CHUNK + length - 1 + after).alias("b"))

    spread = cut(ok.where(F.length("s") > LONG)).repartition(id_col, "i0")
    return cut(ok.where(F.length("s") <= LONG)).unionByName(spread)


def _starts(c: DataFrame, id_col: str, length: int, after: int) -> DataFrame:
    """One row per window of a chunk; k is its start in the chunk."""
    last = F.least(F.col("k0") + CHUNK - 1, F.length("b") - length)  # the last chunk may be short of `after`
    return c.select(id_col, "i0", "k0", "b", F.explode(F.when(last >= F.col("k0"), F.sequence(F.col("k0"), last))).alias("k"))


def all_windows(seqs: DataFrame, id_col: str, length: int) -> DataFrame:
    """(id, i, win) of every window of `length` symbols; i is the 0-based start. Shorter sequences have none."""
    w = _starts(chunks(seqs, id_col, length), id_col, length, 0)
    return w.select(id_col, (F.col("i0") + F.col("k") - F.col("k0")).alias("i"), F.substring("b", F.col("k") + 1, F.lit(length)).cast("string").alias("win"))


def canonical_windows(seqs: DataFrame, id_col: str, spec: SiteSpec, context: tuple[int, int] | None = None) -> DataFrame:
    """(id, i, win) of the windows whose motif stands at the site's offset; with context = (a, z) also `context`, the symbols from a
    before the motif to z after its first symbol (exclusive), cut at the sequence's ends. The motif is looked for before any window is
    cut out."""
    a, z = context or (0, 0)
    before, after = max(0, a - spec.offset), max(0, z - (spec.window - spec.offset))
    w = _starts(chunks(seqs, id_col, spec.window, before, after), id_col, spec.window, after)
    w = w.where(F.substring("b", F.col("k") + spec.offset + 1, F.lit(len(spec.motif))) == F.lit(spec.motif.encode()))
    cols = [F.col(id_col), (F.col("i0") + F.col("k") - F.col("k0")).alias("i"), F.substring("b", F.col("k") + 1, F.lit(spec.window)).cast("string").alias("win")]
    if context:
        first = F.greatest(F.lit(0), F.col("k") + spec.offset - a)
        cols.append(F.substring("b", first + 1, F.col("k") + spec.offset + z - first).cast("string").alias("context"))
    return w.select(*cols)


def interval_windows(seqs: DataFrame, id_col: str, spec: SiteSpec) -> DataFrame:
    """(id, pos, win) at the ends of annotated intervals (1-based, inclusive): a donor site begins after an interval's end, an acceptor
    site two symbols before its start. The motif must stand at the site and again at the window's offset, the window must fit.
    Every interval counts; null intervals and ranges none; reversed ones are taken as they are."""
    r = seqs.select(id_col, "s", F.explode("ranges").alias("r"))
    pos = F.col("r.range_end") if spec.name == "donor" else F.col("r.range_start") - 3
    r = r.select(id_col, "s", pos.alias("pos")).where((F.col("pos") >= 0) & (F.col("pos") + 1 < F.length("s")))
    r = r.where(F.col("s").substr(F.col("pos") + 1, F.lit(2)) == spec.motif)
    r = r.withColumn("b", F.greatest(F.lit(0), F.col("pos") - spec.offset)).where(F.col("b") + spec.window <= F.length("s"))
    r = r.select(id_col, "pos", F.col("s").substr(F.col("b") + 1, F.lit(spec.window)).alias("win"))
    return r.where(F.col("win").substr(spec.offset + 1, 2) == spec.motif)


def validated(df: DataFrame, spec: SiteSpec, win_col: str = "win") -> DataFrame:
    """Rows whose trimmed, upper-case window has the site's length and only ACGT; the window is replaced by that form."""
    return df.withColumn(win_col, valid_window(F.col(win_col), spec.window)).where(F.col(win_col).isNotNull())


def first_seen(df: DataFrame, win_col: str, order: list[str]) -> DataFrame:
    """Distinct windows with the place they were first seen at, by the order columns; no sort is needed."""
    return df.groupBy(win_col).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).select(win_col, "first.*", "n")


def hard_negatives(windows: DataFrame, positives: DataFrame, win_col: str = "win") -> DataFrame:
    """Distinct motif windows whose text is no positive. One grouping of both sides decides, so no side is broadcast."""
    both = windows.select(win_col, F.lit(0).alias("p")).unionByName(positives.select(win_col, F.lit(1).alias("p")))
    return both.groupBy(win_col).agg(F.max("p").alias("p")).where("p = 0").select(win_col)


def naive_windows(texts: DataFrame, id_col: str, spec: SiteSpec, text_col: str = "text", max_windows: int | None = None) -> DataFrame:
    """Every window of a cleaned free text, labelled 1 if the motif stands at the offset. max_windows (per label) keeps those that come
    first by id and position."""
    w = all_windows(sequences(texts, id_col, text_col), id_col, spec.window).withColumn("label", F.when(F.col("win").substr(spec.offset + 1, 2) == spec.motif, 1).otherwise(0))
    if max_windows is None:
        return w
    parts = [w.where(F.col("label") == k).orderBy(id_col, "i").limit(max_windows) for k in (1, 0)]
    return parts[0].unionByName(parts[1])
