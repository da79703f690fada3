"""Scoring and scanning of streams. Scores are row-wise expressions, so the batch operators apply as they are; tables of models are read
once when the query is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.functions.symbols import valid_window
from exonloom.operators.scan import scan
from exonloom.operators.windows import sequences
from exonloom.spec import SiteSpec


def score_windows(stream: DataFrame, spec: SiteSpec, score: Callable[[Column], Column], win_col: str = "win") -> DataFrame:
    """A stream of windows with `score`; invalid windows have a null score."""
    return stream.withColumn("score", score(valid_window(F.col(win_col), spec.window)))


def scan_records(stream: DataFrame, id_col: str, spec: SiteSpec, score: Callable[[Column], Column], threshold: float = 0.0) -> DataFrame:
    """Hits of a stream of gene records."""
    return scan(sequences(stream, id_col), id_col, spec, score, threshold)


def timed(stream: DataFrame, column: str = "extracted_at") -> DataFrame:
    """Event times need a zone; those without one are read in the session's."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def latest_windows(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Windows without redelivered copies (same record_id, site and i within the watermark on extracted_at); later copies are dropped, rows
    older than the watermark as well."""
    return timed(stream).withWatermark("extracted_at", delay).dropDuplicatesWithinWatermark(["record_id", "site", "i"])


def window_rates(stream: DataFrame, delay: str = "30 days", width: str = "7 days") -> DataFrame:
    """Windows per site and tumbling time window of extracted_at, with late rows accepted up to the delay."""
    return timed(stream).withWatermark("extracted_at", delay).groupBy(F.window("extracted_at", width).alias("period"), "site").agg(F.count("*").alias("n_windows")).select(F.col("period.start").alias("period_start"), "site", "n_windows")
