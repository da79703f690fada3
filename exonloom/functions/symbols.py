"""Column expressions on symbol sequences (ACGT) and free texts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def letters(c: Column) -> Column:
    """Upper case with everything but A-Z removed (N stays); null stays null."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def acgt(c: Column) -> Column:
    """Upper case with everything but ACGT removed; null stays null."""
    return F.regexp_replace(F.upper(c), "[^ACGT]", "")


def strip(c: Column) -> Column:
    """Without whitespace of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def valid_window(c: Column, length: int) -> Column:
    """The stripped upper-case window if it has `length` symbols, all of ACGT; else null."""
    w = strip(F.upper(c))
    return F.when(w.rlike(f"^[ACGT]{{{length}}}$"), w)


def base_code(c: Column) -> Column:
    """0..3 for A, C, G, T; -1 for anything else."""
    return F.position(c, F.lit("ACGT")) - F.lit(1)
