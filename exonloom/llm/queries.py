"""Registered queries of the problems tagged llm, with SQL where DuckDB can state them over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from exonloom.llm import crosssplit, formatdup, leaks, mixing, neardup, residue, spans, splits
from exonloom.runtime import write_table
from exonloom.sources.tables import table


def _pair(df, a: str, b: str, names: tuple[str, str]):
    return df.select(F.least(a, b).alias(names[0]), F.greatest(a, b).alias(names[1]))


def p2_found(spark, sf_dir):
    return formatdup.copies(table(spark, sf_dir, "gene_records"), "record_id").select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def p2_classes(spark, sf_dir):
    classes, _ = formatdup.collapse(table(spark, sf_dir, "gene_records"), "record_id")
    return classes.select("class_id", "n_copies", "n_variants")


def p3_found(spark, sf_dir):
    return spans.shared_spans(table(spark, sf_dir, "gene_records"))


def p3_shared_amount(spark, sf_dir):
    g = table(spark, sf_dir, "gene_records")
    return spans.shared_amount(g, spans.shared_spans(g))


def p4_found(spark, sf_dir):
    return _pair(crosssplit.overlaps(table(spark, sf_dir, "dataset")), "train_id", "test_id", ("sample_id_a", "sample_id_b"))


def p4_report(spark, sf_dir):
    return crosssplit.overlap_report(table(spark, sf_dir, "dataset"))


def p5_found(spark, sf_dir):
    return neardup.record_pairs(table(spark, sf_dir, "gene_records")).select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def p5_groups(spark, sf_dir):
    return neardup.near_groups(table(spark, sf_dir, "gene_records"))


def _positives(spark, sf_dir):
    return table(spark, sf_dir, "dataset").where("label = 1")


def p6_found(spark, sf_dir):
    return splits.related_groups(_positives(spark, sf_dir)).select("group_id", F.col("id").alias("sample_id"))


def p6_assignment(spark, sf_dir):
    return splits.assign(splits.related_groups(_positives(spark, sf_dir)), table(spark, sf_dir, "split_targets"))


def p6_split_report(spark, sf_dir):
    return splits.split_report(write_table(p6_assignment(spark, sf_dir), "assigned"), table(spark, sf_dir, "split_targets"))


def p6_integrity(spark, sf_dir):
    assigned = write_table(p6_assignment(spark, sf_dir), "assigned")
    return splits.integrity(assigned, table(spark, sf_dir, "split_targets"))


def p7_found(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_tolerant(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), tolerant_words=20)


def p7_leaked_items(spark, sf_dir):
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_item_counts(spark, sf_dir):
    return p7_leaked_items(spark, sf_dir).select("item_id", "suite", "eval_split", "n_docs", "n_sources")


def p8_mixed_documents(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark, sf_dir):
    return residue.verdicts(table(spark, sf_dir, "documents")).select("doc_id")


def p9_reasons(spark, sf_dir):
    return residue.verdicts(table(spark, sf_dir, "documents"))


def p9_open_slots(spark, sf_dir):
    return residue.open_slots(table(spark, sf_dir, "documents"))


def p9_clean_documents(spark, sf_dir):
    return residue.clean_documents(table(spark, sf_dir, "documents")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_symbols"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_classes, p3_found, p3_shared_amount, p4_found, p4_report, p5_found, p5_groups, p6_found, p6_assignment, p6_split_report, p6_integrity,
        p7_found, p7_tolerant, p7_leaked_items, p7_item_counts, p8_mixed_documents, p8_shares, p9_found, p9_reasons, p9_open_slots, p9_clean_documents,
    )
}

_GENE_CANON = r"""
WITH c AS (SELECT record_id, regexp_replace(lower(file_name), '[^\p{L}\p{N}]', '', 'g') AS f, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS s,
  array_to_string(list_sort([y FOR y IN [regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') FOR x IN regexp_split_to_array(annot, '[;|]')] IF y <> '']), ';') AS a,
  file_name, seq, annot FROM gene_records),
k AS (SELECT * FROM c WHERE f <> '' AND s <> '' AND a <> '')
"""
_SPLIT_PAIRS = r"""
WITH w AS (SELECT DISTINCT sample_id, split, upper(regexp_replace(win, '^\s+|\s+$', '', 'g')) AS t FROM dataset WHERE regexp_replace(win, '^\s+|\s+$', '', 'g') <> ''),
p AS (SELECT a.sample_id AS train_id, b.sample_id AS test_id, levenshtein(a.t, b.t) AS distance FROM w a JOIN w b ON a.split = 'train' AND b.split = 'test'
  AND length(a.t) BETWEEN length(b.t) - 4 AND length(b.t) + 4 WHERE levenshtein(a.t, b.t) <= 4)
"""
_SPANS = r"""
WITH c AS (SELECT record_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS s FROM gene_records),
r AS (SELECT record_id, i, substring(s, i, 50) AS w FROM (SELECT record_id, s, unnest(range(1, length(s) - 48)) AS i FROM c WHERE length(s) >= 50)),
k AS (SELECT w FROM r WHERE regexp_full_match(w, '[ACGT]+') GROUP BY w HAVING count(DISTINCT record_id) > 1),
h AS (SELECT record_id, i, coalesce(i - lag(i) OVER (PARTITION BY record_id ORDER BY i) > 50, true) AS brk FROM r SEMI JOIN k USING (w)),
g AS (SELECT record_id, i, sum(brk::INT) OVER (PARTITION BY record_id ORDER BY i) AS grp FROM h),
sp AS (SELECT record_id, min(i)::INTEGER AS span_start, (max(i) + 49)::INTEGER AS span_end FROM g GROUP BY record_id, grp)
"""
_NAME = r"nullif(nullif(nullif(nullif(nullif(trim(upper(regexp_replace({c}, '\s+', ' ', 'g'))), ''), 'UNKNOWN'), 'N/A'), '-'), 'ANONYMOUS')"
_RELATED = f"""
WITH RECURSIVE s AS (SELECT DISTINCT sample_id, {_NAME.format(c="gene")} AS g, {_NAME.format(c="submitter")} AS b FROM dataset WHERE label = 1),
e AS (SELECT sample_id, 'g:' || g AS k FROM s WHERE g IS NOT NULL UNION SELECT sample_id, 'b:' || b FROM s WHERE b IS NOT NULL),
r AS (SELECT sample_id AS root, k FROM e UNION SELECT r.root, f.k FROM r JOIN e d ON d.k = r.k JOIN e f ON f.sample_id = d.sample_id),
m AS (SELECT e.sample_id, min(r.root) AS group_id FROM r JOIN e USING (k) GROUP BY 1)
"""
_LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
tw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13))
"""
ORACLE = {
    "p2_found": _GENE_CANON + "SELECT m AS record_id_a, record_id AS record_id_b FROM (SELECT record_id, min(record_id) OVER (PARTITION BY f, s, a) AS m FROM k) WHERE m <> record_id",
    "p2_classes": _GENE_CANON + "SELECT min(record_id) AS class_id, count(*) AS n_copies, count(DISTINCT (file_name, seq, annot)) AS n_variants FROM k GROUP BY f, s, a",
    "p4_found": _SPLIT_PAIRS + "SELECT least(train_id, test_id) AS sample_id_a, greatest(train_id, test_id) AS sample_id_b FROM p",
    "p4_report": _SPLIT_PAIRS + """, e AS (SELECT train_id AS sample_id, distance FROM p UNION ALL SELECT test_id, distance FROM p),
n AS (SELECT sample_id, count(*) AS links, count(*) FILTER (distance = 0) AS exact FROM e GROUP BY 1),
d AS (SELECT sample_id, any_value(split) AS split, any_value(label) AS label, any_value(source) AS source FROM dataset GROUP BY 1)
SELECT split, label, source, count(*) AS n_samples, sum(links)::BIGINT AS n_pairs, sum(exact)::BIGINT AS n_exact FROM n JOIN d USING (sample_id) GROUP BY ALL""",
    "p3_found": _SPANS + "SELECT record_id, span_start, span_end FROM sp",
    "p3_shared_amount": _SPANS + """, n AS (SELECT DISTINCT record_id, length(s)::INTEGER AS n_symbols FROM c WHERE s <> ''), a AS (SELECT record_id, count(*) AS n_spans, sum(span_end - span_start + 1)::BIGINT AS n_shared FROM sp GROUP BY 1)
SELECT record_id, n_symbols, coalesce(n_spans, 0) AS n_spans, coalesce(n_shared, 0) AS n_shared, coalesce(n_shared, 0) / n_symbols::DOUBLE AS shared_part FROM n LEFT JOIN a USING (record_id)""",
    "p5_found": r"""
WITH c AS (SELECT record_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS s FROM gene_records),
g AS (SELECT DISTINCT record_id, substring(s, i, 12) AS g FROM (SELECT record_id, s, unnest(range(1, length(s) - 10)) AS i FROM c WHERE length(s) >= 12)), n AS (SELECT record_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT x.record_id AS a, y.record_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.record_id < y.record_id GROUP BY ALL)
SELECT a AS record_id_a, b AS record_id_b FROM o JOIN n na ON na.record_id = a JOIN n nb ON nb.record_id = b WHERE o >= 0.6e0 * (na.n + nb.n - o) - 1e-9""",
    "p5_groups": r"""
WITH RECURSIVE c AS (SELECT DISTINCT record_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') AS s FROM gene_records),
k AS (SELECT min(record_id) AS rep, s, count(*) AS n FROM c WHERE s <> '' GROUP BY s),
g AS (SELECT DISTINCT rep, substring(s, i, 12) AS g FROM (SELECT rep, s, unnest(range(1, length(s) - 10)) AS i FROM k WHERE length(s) >= 12)), m AS (SELECT rep, count(*) AS m FROM g GROUP BY 1),
o AS (SELECT x.rep AS a, y.rep AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN m ma ON ma.rep = a JOIN m mb ON mb.rep = b WHERE o >= 0.6e0 * (ma.m + mb.m - o) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS root, rep AS node FROM k UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node),
f AS (SELECT node AS rep, min(root) AS group_id FROM r GROUP BY 1), d AS (SELECT a AS rep, count(*) AS d FROM e GROUP BY 1)
SELECT c.record_id, k.rep AS class_id, f.group_id, k.n AS n_copies, coalesce(d.d, 0) AS n_links FROM c JOIN k USING (s) JOIN f ON f.rep = k.rep LEFT JOIN d ON d.rep = k.rep""",
    "p6_found": _RELATED + "SELECT coalesce(group_id, sample_id) AS group_id, sample_id FROM (SELECT DISTINCT sample_id FROM s) LEFT JOIN m USING (sample_id)",
    "p6_integrity": _RELATED + "SELECT count(*) AS n_samples, count(DISTINCT coalesce(group_id, sample_id)) AS n_groups, 0::BIGINT AS n_parted, 0::BIGINT AS n_off FROM (SELECT DISTINCT sample_id FROM s) LEFT JOIN m USING (sample_id)",
    "p7_item_counts": _LEAKS + """, p AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN tw USING (x)), n AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT source) AS n_sources FROM p JOIN documents USING (doc_id) GROUP BY 1)
SELECT item_id, suite, eval_split, coalesce(n_docs, 0) AS n_docs, coalesce(n_sources, 0) AS n_sources FROM eval_items LEFT JOIN n USING (item_id)""",
    "p7_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM dw JOIN tw USING (x)",
}
