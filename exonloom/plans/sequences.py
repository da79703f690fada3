"""Registered queries on sequences, windows and labelled sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import split, windows
from exonloom.sources import records
from exonloom.sources.tables import table
from exonloom.spec import ACCEPTOR, DONOR


def _seqs(spark, sf_dir):
    return windows.sequences(table(spark, sf_dir, "gene_records"), "record_id")


def clean_sequence(spark, sf_dir):
    return _seqs(spark, sf_dir).select("record_id", F.length("s").alias("n_symbols"), "s")


def window_all(spark, sf_dir):
    w = windows.all_windows(_seqs(spark, sf_dir), "record_id", DONOR.window)
    return w.groupBy("record_id").agg(F.count("*").alias("n_windows"), F.count_distinct("win").alias("n_distinct"), F.max("i").alias("last_i"))


def window_canonical_donor(spark, sf_dir):
    return windows.canonical_windows(_seqs(spark, sf_dir), "record_id", DONOR)


def window_canonical_acceptor(spark, sf_dir):
    return windows.canonical_windows(_seqs(spark, sf_dir), "record_id", ACCEPTOR)


def window_from_intervals(spark, sf_dir):
    s = _seqs(spark, sf_dir)
    parts = [windows.interval_windows(s, "record_id", x).withColumn("site", F.lit(x.name)) for x in (DONOR, ACCEPTOR)]
    return parts[0].unionByName(parts[1])


def window_validate(spark, sf_dir):
    w = table(spark, sf_dir, "windows")
    parts = [windows.validated(w.where(F.col("site") == x.name).select("record_id", "site", "i", "win"), x) for x in (DONOR, ACCEPTOR)]
    return parts[0].unionByName(parts[1])


def distinct_windows(spark, sf_dir):
    w = windows.validated(table(spark, sf_dir, "windows").where("site = 'donor'").select("record_id", "i", "win"), DONOR)
    return windows.first_seen(w, "win", ["record_id", "i"])


def hard_negatives(spark, sf_dir):
    s = _seqs(spark, sf_dir)
    return windows.hard_negatives(windows.canonical_windows(s, "record_id", DONOR), windows.interval_windows(s, "record_id", DONOR))


def sampled_negatives(spark, sf_dir):
    s = _seqs(spark, sf_dir)
    return split.sampled_negatives(windows.all_windows(s, "record_id", DONOR.window), windows.interval_windows(s, "record_id", DONOR), 200)


def naive_text_windows(spark, sf_dir):
    w = windows.naive_windows(table(spark, sf_dir, "documents"), "doc_id", DONOR)
    return w.groupBy("label").agg(F.count("*").alias("n_windows"), F.count_distinct("win").alias("n_distinct"))


def file_listing(spark, sf_dir):
    f = table(spark, sf_dir, "gene_records").where("file_name is not null").select(F.trim("file_name").alias("file_name"), "record_id")
    f = f.where(F.upper("file_name").endswith(".TXT"))
    first = F.min(F.struct(F.when(F.col("file_name").endswith(".TXT"), 0).otherwise(1).alias("ext"), "file_name", "record_id")).alias("x")
    return f.groupBy(F.upper("file_name").alias("name_key")).agg(first, F.count("*").alias("n_files")).select("name_key", "x.file_name", "x.record_id", "n_files")


def _texts(spark, sf_dir):
    """Gene records in the two file layouts: joined ranges for even ids, bracketed ones for odd ids."""
    r = F.array_join(F.transform(F.coalesce("ranges", F.array().cast(records.RANGES)), lambda x: F.concat_ws("..", x["range_start"].cast("string"), x["range_end"].cast("string"))), ",")
    head = F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("LOCUS X DNA\nCDSjoin("), r, F.lit(")\n"))).otherwise(F.concat(F.lit(">X\n>X("), r, F.lit(")\n")))
    return table(spark, sf_dir, "gene_records").select("record_id", "gene", F.concat(head, F.coalesce("seq", F.lit(""))).alias("value"), "seq")


def parse_annotation(spark, sf_dir):
    p = records.parse_records(_texts(spark, sf_dir).drop("seq"))
    return p.select("record_id", F.size("ranges").alias("n_ranges"), F.try_element_at("ranges", F.lit(1))["range_start"].alias("first_start"), F.try_element_at("ranges", F.lit(-1))["range_end"].alias("last_end"), "seq")


def fasta_records(spark, sf_dir):
    t = table(spark, sf_dir, "gene_records").select("record_id", F.concat(F.lit(">a\n"), F.coalesce("seq", F.lit("")), F.lit("\n>b\n\n>c\n"), F.coalesce("gene", F.lit(""))).alias("value"))
    return records.fasta_records(t, "record_id").select("record_id", "ord", "seq")


def strict_split_counts(spark, sf_dir):
    s = [split.strict_split(split.labelled_windows(table(spark, sf_dir, "dataset"), x)).groupBy("split", "label").agg(F.count("*").alias("n")).withColumn("site", F.lit(x.name)) for x in (DONOR, ACCEPTOR)]
    return s[0].unionByName(s[1])


def strict_windows(spark, sf_dir, spec=DONOR):
    return split.strict_split(split.labelled_windows(table(spark, sf_dir, "dataset"), spec))


def balanced_split(spark, sf_dir):
    return split.balanced(strict_windows(spark, sf_dir))


def kfold_assign(spark, sf_dir):
    return split.folds(strict_windows(spark, sf_dir).where("split = 'train'").select("label", "w"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_sequence, window_all, window_canonical_donor, window_canonical_acceptor, window_from_intervals, window_validate, distinct_windows, hard_negatives, sampled_negatives,
        naive_text_windows, file_listing, parse_annotation, fasta_records, strict_split_counts, balanced_split, kfold_assign,
    )
}

#: Whitespace of any kind off both ends, upper case.
STRIP = r"regexp_replace(upper(win), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')"
SEQS = "s AS (SELECT record_id, regexp_replace(upper(seq), '[^ACGT]', '', 'g') AS s, ranges FROM gene_records WHERE regexp_replace(upper(seq), '[^ACGT]', '', 'g') <> '')"


def _windows(length: int, motif: str | None = None, offset: int = 0) -> str:
    w = f"SELECT record_id, i::INTEGER AS i, substring(s, i::INTEGER + 1, {length}) AS win FROM (SELECT record_id, s, unnest(range(0, length(s) - {length - 1})) AS i FROM s WHERE length(s) >= {length})"
    return w + (f" WHERE substring(s, i::INTEGER + {offset + 1}, {len(motif)}) = '{motif}'" if motif else "")


def _intervals(x) -> str:
    pos = "r.range_end" if x.name == "donor" else "r.range_start - 3"
    return f"""SELECT record_id, pos, substring(s, b + 1, {x.window}) AS win FROM (SELECT record_id, s, pos, greatest(0, pos - {x.offset}) AS b FROM (SELECT record_id, s, {pos} AS pos FROM (SELECT record_id, s, unnest(ranges) AS r FROM s))
 WHERE pos >= 0 AND pos + 1 < length(s) AND substring(s, pos + 1, 2) = '{x.motif}') WHERE b + {x.window} <= length(s) AND substring(s, b + {x.offset + 1}, 2) = '{x.motif}'"""


def strict(spec=DONOR) -> str:
    """CTEs up to st(split, label, w), the strict split of one site."""
    n = spec.window
    return f"""v AS (SELECT DISTINCT split, label, substring({STRIP}, 1, {n}) AS w FROM dataset WHERE site = '{spec.name}' AND label IN (0, 1) AND split IN ('train', 'test') AND regexp_full_match(substring({STRIP}, 1, {n}), '[ACGT]{{{n}}}')),
tp AS (SELECT w FROM v WHERE split = 'train' AND label = 1), qp AS (SELECT w FROM v WHERE split = 'test' AND label = 1 AND w NOT IN (SELECT w FROM tp)),
tn AS (SELECT w FROM v WHERE split = 'train' AND label = 0 AND w NOT IN (SELECT w FROM tp)),
qn AS (SELECT w FROM v WHERE split = 'test' AND label = 0 AND w NOT IN (SELECT w FROM tp UNION SELECT w FROM qp UNION SELECT w FROM tn)),
st AS (SELECT 'train' AS split, 1 AS label, w FROM tp UNION ALL SELECT 'test', 1, w FROM qp UNION ALL SELECT 'train', 0, w FROM tn UNION ALL SELECT 'test', 0, w FROM qn)"""


_NAIVE = "s AS (SELECT doc_id AS record_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents)"
ORACLE = {
    "clean_sequence": f"WITH {SEQS} SELECT record_id, length(s)::INTEGER AS n_symbols, s FROM s",
    "window_all": f"WITH {SEQS}, w AS ({_windows(9)}) SELECT record_id, count(*) AS n_windows, count(DISTINCT win) AS n_distinct, max(i) AS last_i FROM w GROUP BY 1",
    "window_canonical_donor": f"WITH {SEQS} {_windows(9, 'GT', 3)}",
    "window_canonical_acceptor": f"WITH {SEQS} {_windows(23, 'AG', 20)}",
    "window_from_intervals": f"WITH {SEQS} SELECT *, 'donor' AS site FROM ({_intervals(DONOR)}) UNION ALL SELECT *, 'acceptor' FROM ({_intervals(ACCEPTOR)})",
    "window_validate": f"SELECT record_id, site, i, {STRIP} AS win FROM windows WHERE (site = 'donor' AND regexp_full_match({STRIP}, '[ACGT]{{9}}')) OR (site = 'acceptor' AND regexp_full_match({STRIP}, '[ACGT]{{23}}'))",
    "distinct_windows": f"""WITH v AS (SELECT record_id, i, {STRIP} AS win FROM windows WHERE site = 'donor' AND regexp_full_match({STRIP}, '[ACGT]{{9}}'))
SELECT win, record_id, i, n FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n, row_number() OVER (PARTITION BY win ORDER BY record_id, i) AS r FROM v) WHERE r = 1""",
    "hard_negatives": f"WITH {SEQS} SELECT DISTINCT win FROM ({_windows(9, 'GT', 3)}) WHERE win NOT IN (SELECT win FROM ({_intervals(DONOR)}))",
    "sampled_negatives": f"WITH {SEQS} SELECT win FROM (SELECT DISTINCT win FROM ({_windows(9)}) WHERE win NOT IN (SELECT win FROM ({_intervals(DONOR)}))) ORDER BY md5('42:' || win) LIMIT 200",
    "naive_text_windows": f"WITH {_NAIVE}, w AS ({_windows(9)}) SELECT CASE WHEN substring(win, 4, 2) = 'GT' THEN 1 ELSE 0 END AS label, count(*) AS n_windows, count(DISTINCT win) AS n_distinct FROM w GROUP BY 1",
    "file_listing": """SELECT name_key, file_name, record_id, n_files FROM (SELECT upper(f) AS name_key, f AS file_name, record_id, count(*) OVER (PARTITION BY upper(f)) AS n_files,
 row_number() OVER (PARTITION BY upper(f) ORDER BY CASE WHEN f LIKE '%.TXT' THEN 0 ELSE 1 END, f, record_id) AS r FROM (SELECT trim(file_name, ' ') AS f, record_id FROM gene_records WHERE file_name IS NOT NULL) WHERE upper(f) LIKE '%.TXT') WHERE r = 1""",
    "parse_annotation": r"""SELECT record_id, coalesce(len(rs), 0)::INTEGER AS n_ranges, rs[1].range_start AS first_start, rs[-1].range_end AS last_end,
 regexp_replace(upper(array_to_string([l FOR l IN regexp_split_to_array(coalesce(seq, ''), '\r?\n') IF regexp_full_match(l, '[acgtnACGTN\s]+')], '')), '[^ACGT]', '', 'g') AS seq
 FROM (SELECT record_id, seq, [r FOR r IN ranges IF r.range_start IS NOT NULL AND r.range_end IS NOT NULL] AS rs FROM gene_records)""",
    "fasta_records": r"""SELECT record_id, 1 AS ord, regexp_replace(seq, '[\r\n]', '', 'g') AS seq FROM gene_records WHERE regexp_replace(seq, '[\r\n]', '', 'g') <> ''
 UNION ALL SELECT record_id, 3, gene FROM gene_records WHERE gene <> ''""",
    "strict_split_counts": f"SELECT split, label, count(*) AS n, 'donor' AS site FROM (WITH {strict(DONOR)} SELECT * FROM st) GROUP BY ALL UNION ALL SELECT split, label, count(*) AS n, 'acceptor' FROM (WITH {strict(ACCEPTOR)} SELECT * FROM st) GROUP BY ALL",
    "balanced_split": f"""WITH {strict()}, r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5('42:' || w)) AS r FROM st),
m AS (SELECT split, min(n) AS m FROM (SELECT split, label, count(*) AS n FROM st GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2) SELECT split, label, w FROM r JOIN m USING (split) WHERE r <= m""",
    "kfold_assign": f"WITH {strict()} SELECT label, w, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || w)) - 1) % 5)::INTEGER AS fold FROM st WHERE split = 'train'",
}
