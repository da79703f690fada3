"""Scanning sequences for sites: motif windows, scored and filtered. All expressions; works on streams as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.operators.windows import canonical_windows
from exonloom.spec import SiteSpec


def scan(seqs: DataFrame, id_col: str, spec: SiteSpec, score: Callable[[Column], Column], threshold: float = 0.0, context: tuple[int, int] | None = None) -> DataFrame:
    """(id, pos, score, win): motif windows of (id, s) whose score reaches the threshold; pos is the 0-based index of the motif's first
    symbol. Windows with symbols outside ACGT and scores that are null or NaN are no hits. With context = (before, after) also
    `context`, the symbols from `before` before a hit to `after` after it (exclusive), cut at the sequence's ends."""
    w = canonical_windows(seqs, id_col, spec, context).where(F.col("win").rlike(f"^[ACGT]{{{spec.window}}}$"))
    w = w.select(id_col, (F.col("i") + spec.offset).alias("pos"), score(F.col("win")).alias("score"), "win", *(["context"] if context else []))
    return w.where((F.col("score") >= threshold) & ~F.isnan("score"))


def scan_sequence(spark, text: str, spec: SiteSpec, score: Callable[[Column], Column], threshold: float = 0.0) -> DataFrame:
    """(pos, score, win) of one literal sequence, in order; upper-cased, other symbols stay (those outside ASCII as '?')."""
    one = spark.createDataFrame([(0, text.strip().upper().encode("ascii", "replace").decode())], "seq_id long, s string")
    return scan(one, "seq_id", spec, score, threshold).select("pos", "score", "win").orderBy("pos")
