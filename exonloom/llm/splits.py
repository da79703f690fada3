"""Splits that keep related records together (problem 6).

Method: entities (genes, submitters) are nodes and every sample that names two of them is an edge, collapsed to one edge per pair
of names. A Boruvka-style contraction (see forest) builds the persisted spanning forest; its roots are the groups. Groups are
stratified by size band (powers of two) and dealt systematically, the same way whatever their number: each band's groups lie in
CELLS cells by hash, and the cells, in order, go to the splits by running size. Bands are dealt from the top down, and what a split
lacks or has too much after a band is made good in those below, so that a large group only displaces others. The running sums
need one row per band and cell - a table of constant size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.llm.forest import spanning_forest
from exonloom.operators.ranking import hash_key
from exonloom.runtime import join_unique, write_table

#: Names that stand for an unknown one, after canon_name (fixed values).
STAND_INS = ("", "UNKNOWN", "N/A", "-", "ANONYMOUS")
#: Hexadecimal digits of a group's hash that name its cell; there are 16^3 cells a band, and 63 bands at most.
CELL_DIGITS = 3
CELLS = 16**CELL_DIGITS


def canon_name(c: Column) -> Column:
    """Upper case, trimmed, inner blanks reduced to one; null for stand-ins."""
    x = F.upper(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.when(~x.isin(*STAND_INS), x)


def related_groups(df: DataFrame, entities: tuple[str, ...] = ("gene", "submitter"), id_col: str = "sample_id", forest_path: str | None = None) -> DataFrame:
    """(group_id, id): one row per id; ids are related if they share a name in one of the entity columns, directly or through others.
    group_id is the smallest id of the group; ids without any known name are alone. Names of different columns never mix.
    An id that occurs in several rows relates all their names. The spanning forest over the names is written to forest_path (see
    spanning_forest), and the groups are read from its roots."""
    names = F.array_compact(F.array(*[F.when(canon_name(F.col(e)).isNotNull(), F.concat(F.lit(f"{i}:"), canon_name(F.col(e)))) for i, e in enumerate(entities)]))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), names.alias("names")).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))
    rows = write_table(rows, "split-samples")
    named = rows.where(F.size("names") > 0).select("id", F.col("names")[0].alias("node"), "names")
    # consecutive names of one sample are enough to connect them all
    steps = named.where(F.size("names") > 1).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda i: F.struct(F.get("names", i - 1).alias("u"), F.get("names", i).alias("v")))).alias("e"))
    edges = steps.groupBy("e.u", "e.v").agg(F.min("id").alias("w"))
    _, roots = spanning_forest(edges, forest_path)
    first = named.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    rooted = write_table(first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "split-roots")
    groups = rooted.groupBy("root").agg(F.min("first").alias("group_id"), F.count("*").alias("names"))
    per_name = write_table(join_unique(rooted, groups, "root", "names").select("node", "group_id", "n"), "split-names")
    known = join_unique(named.select("id", "node"), per_name, "node", "n").select("group_id", "id")
    alone = rows.where(F.size("names") == 0).select(F.col("id").alias("group_id"), "id")
    return known.unionByName(alone)


def deal_groups(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(group_id, n, split): a split for each group. groups: (group_id, n). targets: (split, target_share), a handful of rows; shares
    are taken relative to their sum, null or non-positive ones get nothing. Without targets the result is empty."""
    want = {r[0]: float(r[1]) for r in targets.where("split is not null and target_share > 0").select("split", "target_share").collect()}
    whole = sum(want.values())
    cell = F.conv(F.substring(hash_key(F.col("group_id").cast("string")), 1, CELL_DIGITS), 16, 10).cast("int")
    groups = groups.select("group_id", "n", F.floor(F.log2("n")).cast("int").alias("band"), cell.alias("cell"))
    if not want:
        return groups.select("group_id", "n", F.lit("").alias("split")).limit(0)
    groups = write_table(groups, "split-groups")
    bands: dict[int, list[tuple[int, int]]] = {}
    for r in groups.groupBy("band", "cell").agg(F.sum("n").alias("n")).collect():  # 63 x CELLS rows at most
        bands.setdefault(r.band, []).append((r.cell, r.n))
    have, seen, dealt = dict.fromkeys(want, 0.0), 0, []
    for band in sorted(bands, reverse=True):
        size = sum(n for _, n in bands[band])
        seen += size
        lack = {s: max(0.0, w / whole * seen - have[s]) for s, w in want.items()}
        order = sorted(want, key=lambda s: (-lack[s], s))
        scale, upto, k, edge = size / (sum(lack.values()) or 1.0), 0, 0, lack[order[0]]
        for c, n in sorted(bands[band]):
            while k < len(order) - 1 and upto + n / 2 > edge * scale:
                k += 1
                edge += lack[order[k]]
            have[order[k]] += n
            upto += n
            dealt.append((band, c, order[k]))
    plan = groups.sparkSession.createDataFrame(dealt, "band int, cell int, split string")
    return groups.join(F.broadcast(plan), ["band", "cell"]).select("group_id", "n", "split")


def assign(groups: DataFrame, targets: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, group_id, split) for the rows (group_id, id) of related_groups."""
    groups = write_table(groups, "split-members")
    per = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return join_unique(groups, write_table(deal_groups(per, targets), "split-dealt"), "group_id", "n").select(F.col("id").alias(id_col), "group_id", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: samples, groups, actual and wanted share. A wanted split without samples has zeros."""
    total = max(assigned.count(), 1)
    per = assigned.groupBy("split").agg(F.count("*").alias("n_samples"), F.count_distinct("group_id").alias("n_groups"))
    out = targets.select("split", "target_share").join(per, "split", "left")
    return out.select("split", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), (F.coalesce("n_samples", F.lit(0)) / F.lit(total)).alias("actual_share"), "target_share")


def integrity(assigned: DataFrame, targets: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row: samples, groups, groups in more than one split (none), and splits further than `tolerance` from their share (none, unless
    one group is larger than a split)."""
    per = assigned.groupBy("group_id").agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"))
    off = split_report(assigned, targets).where(F.abs(F.col("actual_share") - F.col("target_share")) > tolerance).agg(F.count("*").alias("n_off"))
    return per.agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_parted")).crossJoin(off)
