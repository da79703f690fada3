"""Text sources: annotated gene files in two layouts, FASTA, literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = "array<struct<range_start: int, range_end: int>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value): each *.txt file below a folder (any case of the ending) as one row; unreadable files are skipped. Of names
    equal but for case one is kept: upper-case endings first, then by name."""
    raw = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True, pathGlobFilter="*.[tT][xX][tT]", recursiveFileLookup=True)
    raw = raw.select(F.col("_metadata.file_name").alias("file_name"), "value")
    first = F.struct(F.when(F.col("file_name").endswith(".TXT"), 0).otherwise(1).alias("r"), "file_name", "value")
    return raw.groupBy(F.upper("file_name").alias("k")).agg(F.min(first).alias("x")).select("x.file_name", "x.value")


def _interval(part: Column) -> Column:
    num = lambda i: F.try_element_at(F.split(F.trim(part), r"\.\."), F.lit(i))
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("int"))
    return F.struct(whole(num(1)).alias("range_start"), whole(num(2)).alias("range_end"))


def intervals(listed: Column) -> Column:
    """Intervals of 'a..b, c..d'; parts without '..', with more than one or without whole numbers are skipped."""
    parts = F.filter(F.split(listed, ","), lambda x: F.size(F.split(x, r"\.\.")) == 2)
    return F.filter(F.transform(parts, _interval), lambda r: r["range_start"].isNotNull() & r["range_end"].isNotNull())


def parse_records(texts: DataFrame, value: str = "value", n_policy: str = "strip") -> DataFrame:
    """texts with `seq` and `ranges` of an annotated record. Layout by line 0: with '>' the ranges stand in the first brackets of line 1,
    else in `join(...)` of the first of ten lines that names CDS and join. The sequence begins at line 2; lines with anything but bases,
    N and blanks are dropped whole. n_policy: 'strip' keeps lines with N and removes the N; 'drop_line' drops them. Removed symbols
    shift what follows. Texts of fewer than three lines, and nulls, have an empty sequence and no ranges."""
    if n_policy not in ("strip", "drop_line"):
        raise ValueError(f"unknown n_policy: {n_policy!r}")
    lines = F.split(F.coalesce(F.col(value), F.lit("")), r"\r?\n")
    t = texts.withColumn("_l", lines)
    enough = F.size("_l") >= 3
    first = F.get("_l", F.lit(0))
    cds = F.try_element_at(F.filter(F.slice("_l", 1, 10), lambda x: x.contains("CDS") & x.contains("join")), F.lit(1))
    listed = F.when(first.startswith(">"), F.regexp_extract(F.get("_l", F.lit(1)), r"\(([^)]+)\)", 1)).otherwise(F.regexp_extract(F.coalesce(cds, F.lit("")), r"join\(\s*(.+?)\s*\)", 1))
    allowed = r"^[acgtnACGTN\s]+$" if n_policy == "strip" else r"^[acgtACGT\s]+$"
    body = F.filter(F.slice("_l", 3, F.greatest(F.size("_l"), F.lit(3))), lambda x: x.rlike(allowed))
    seq = F.regexp_replace(F.upper(F.array_join(body, "")), "[^ACGT]", "")
    empty = F.array().cast(RANGES)
    return t.withColumn("seq", F.when(enough, seq).otherwise("")).withColumn("ranges", F.when(enough & (listed != ""), intervals(listed)).otherwise(empty)).drop("_l")


def fasta_records(texts: DataFrame, id_col: str, value: str = "value") -> DataFrame:
    """(id, ord, seq) of the records of a FASTA text: lines after a '>' line up to the next, joined; empty records are skipped."""
    parts = F.split(F.coalesce(F.col(value), F.lit("")), r"(?m)^>[^\r\n]*(?:\r?\n|\z)")
    return texts.select(id_col, F.posexplode(parts).alias("ord", "seq")).withColumn("seq", F.regexp_replace("seq", r"[\r\n]", "")).where("seq <> ''")


def labelled_fasta(pos: DataFrame, neg: DataFrame, id_col: str, value: str = "value") -> DataFrame:
    """Records of two FASTA sources, labelled 1 and 0."""
    return fasta_records(pos, id_col, value).withColumn("label", F.lit(1)).unionByName(fasta_records(neg, id_col, value).withColumn("label", F.lit(0)))


def literal_sequence(spark: SparkSession, text: str, seq_id: int = 0) -> DataFrame:
    return spark.createDataFrame([(seq_id, text)], "seq_id long, seq string")
