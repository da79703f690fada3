"""Duplicates hidden by formatting differences (problem 2).

Method: byte-identical raw rows are collapsed first, with counts; only the distinct survivors are canonicalised; they are grouped
again on their full canonical text, summing the counts. Both groupings combine on the map side, so a group that holds a third of
all rows arrives as one row per map task. Members find their group by digests, through a join that salts hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.functions.symbols import letters
from exonloom.runtime import join_unique, write_table


def bare(c: Column) -> Column:
    """Text without whitespace of any kind, letter case and punctuation: only letters and digits are left, in lower case."""
    return F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{N}]", "")


def bare_fields(c: Column) -> Column:
    """The fields of `key=value; key: value | ...`, each bare, empty ones dropped, in sorted order."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(c, r"[;|]"), bare), lambda x: x != "")), ";")


#: Canonical form of each column of gene_records that takes part.
GENE_CANON = {"file_name": bare, "seq": letters, "annot": bare_fields}


def _key(cols: list[str]) -> Column:
    """Digest of several texts; lengths keep the borders, nulls stay apart from empty texts."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c), F.lit(""))) for c in cols]), 256)


def collapse(df: DataFrame, id_col: str, canon: dict = GENE_CANON) -> tuple[DataFrame, DataFrame]:
    """(classes, members).

    classes: class_id (smallest id), n_copies (all rows of the group), n_variants (distinct raw spellings) and the canonical texts.
    members: raw_key -> class_id, n_raw, n_copies (of the group) for each distinct raw row.
    Rows in which any canonical text is null or empty are never copies of anything and are in neither. Other columns are ignored,
    whatever their names; ids that occur in several rows count once per row."""
    cols = list(canon)
    src = df.select(F.col(id_col).alias("_id"), *cols)
    raw = src.groupBy(*cols).agg(F.min("_id").alias("rep"), F.count("*").alias("n_raw")).withColumn("raw_key", _key(cols))
    survivors = raw.select("rep", "n_raw", "raw_key", *[f(F.col(c)).alias(c) for c, f in canon.items()])
    for c in cols:
        survivors = survivors.where(F.col(c) != "")
    survivors = write_table(survivors.withColumn("canon_key", _key(cols)), "format-survivors")
    classes = survivors.groupBy(*cols, "canon_key").agg(F.min("rep").alias("class_id"), F.sum("n_raw").alias("n_copies"), F.count("*").alias("n_variants"))
    keys = write_table(classes.select("canon_key", "class_id", "n_copies", "n_variants"), "format-classes")
    members = join_unique(survivors.select("raw_key", "canon_key", "n_raw"), keys, "canon_key", "n_variants")
    return classes, members.select("raw_key", "class_id", "n_raw", "n_copies")


def copies(df: DataFrame, id_col: str, canon: dict = GENE_CANON) -> DataFrame:
    """One row (a, b) for each further copy: a the smallest id of the group, b the copy."""
    cols = list(canon)
    members = write_table(collapse(df, id_col, canon)[1].where("n_copies > 1").select("raw_key", "class_id", "n_raw"), "format-members")
    rows = df.select(F.col(id_col).alias("b"), _key(cols).alias("raw_key"))
    return join_unique(rows, members, "raw_key", "n_raw").where("b <> class_id").select(F.col("class_id").alias("a"), "b").distinct()
