"""Registered queries of problem 1 (rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.operators import rowparse
from exonloom.sources.tables import table


def p1_found(spark, sf_dir):
    return rowparse.rejected(rowparse.parse_gene_lines(table(spark, sf_dir, "raw_records"))).select("line_id", "reason")


def p1_reason_counts(spark, sf_dir):
    return rowparse.reason_counts(rowparse.parse_gene_lines(table(spark, sf_dir, "raw_records")))


def p1_loaded_records(spark, sf_dir):
    got = rowparse.loaded_gene_records(rowparse.parse_gene_lines(table(spark, sf_dir, "raw_records")))
    return got.select("line_id", "gene", "file_rank", "division", "note", F.size("ranges").alias("n_ranges"), F.element_at("ranges", -1)["range_end"].alias("last_end"), "seq")


QUERIES = {"p1_found": p1_found, "p1_reason_counts": p1_reason_counts, "p1_loaded_records": p1_loaded_records}

_ANY = '("([^"]|"")*"|[^",]*)'
#: Judged per line: the fields are cut out by one expression, then counted and tested one by one.
_LINES = rf"""
WITH l AS (SELECT line_id, batch_id, regexp_replace(raw_line, '\r$', '') AS ln FROM raw_records),
q AS (SELECT line_id, batch_id, ln, regexp_full_match(ln, '(?s){_ANY}(,{_ANY})*') AS quoted,
      [CASE WHEN x LIKE '"%' THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END FOR x IN regexp_extract_all(',' || ln, ',{_ANY}', 1)] AS f FROM l WHERE ln IS NOT NULL),
r AS (SELECT *, len(regexp_replace(coalesce(f[6], ''), '\s', '', 'g')) AS n, string_split(coalesce(f[5], ''), ',') AS parts FROM q),
v AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 6 THEN 'column_count'
      WHEN len([x FOR x IN parts IF regexp_full_match(x, '[ \t]*[0-9]+\.\.[0-9]+[ \t]*') AND coalesce(try_cast(regexp_extract(x, '([0-9]+)\.\.', 1) AS BIGINT) >= 1
           AND try_cast(regexp_extract(x, '([0-9]+)\.\.', 1) AS BIGINT) <= try_cast(regexp_extract(x, '\.\.([0-9]+)', 1) AS BIGINT)
           AND try_cast(regexp_extract(x, '\.\.([0-9]+)', 1) AS BIGINT) <= n, false)]) < len(parts) THEN 'ranges'
      WHEN NOT regexp_full_match(f[6], '[ACGTNacgtn\s]+') OR n = 0 THEN 'seq' END AS reason FROM r)
"""
ORACLE = {
    "p1_found": _LINES + "SELECT line_id, reason FROM v WHERE reason IS NOT NULL",
    "p1_reason_counts": _LINES + """, w AS (SELECT batch_id, coalesce(reason, 'valid') AS reason FROM v UNION ALL SELECT batch_id, 'missing' FROM l WHERE ln IS NULL)
SELECT batch_id, reason, count(*) AS n_lines FROM w GROUP BY ALL""",
    "p1_loaded_records": _LINES + r"""SELECT line_id, nullif(trim(f[1]), '') AS gene, try_cast(trim(f[2]) AS INTEGER) AS file_rank, nullif(trim(f[3]), '') AS division, nullif(trim(f[4]), '') AS note,
 len(parts)::INTEGER AS n_ranges, regexp_extract(parts[-1], '\.\.([0-9]+)', 1)::INTEGER AS last_end, upper(regexp_replace(f[6], '\s', '', 'g')) AS seq FROM v WHERE reason IS NULL""",
}
