"""Grouped counts and the tables made from them. Windows are columns `w`, valid and of one length; the tables have at most
positions^2 x 16 rows whatever the data, and every count combines on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.spec import DEPENDENCY_THRESHOLD, MAX_PAIRS, PSEUDO

BASES = ["A", "C", "G", "T"]


def grid(spark: SparkSession, length: int, bases: int = 1, start: int = 0) -> DataFrame:
    """All (pos, base) or (pos, prev, curr) cells; a literal table."""
    base = F.array(*[F.lit(b) for b in BASES])
    g = spark.range(start, length).select(F.col("id").cast("int").alias("pos"))
    if bases == 1:
        return g.select("pos", F.explode(base).alias("base"))
    return g.select("pos", F.explode(base).alias("prev")).select("pos", "prev", F.explode(base).alias("curr"))


def symbols(ws: DataFrame, length: int) -> DataFrame:
    return ws.select("w", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos")).select("pos", F.col("w").substr(F.col("pos") + 1, F.lit(1)).alias("base"))


def background(ws: DataFrame, col: str = "w", pseudo: float = 0.0) -> DataFrame:
    """(base, freq): share of each base among all ACGT symbols. pseudo is added to each base's count. Without any symbol and without
    pseudo-counts, 0.25 each. One pass, one row of four counts."""
    n = {b: F.sum(F.length(col) - F.length(F.replace(F.upper(col), F.lit(b), F.lit("")))).cast("double") for b in BASES}
    c = ws.agg(*[F.coalesce(n[b], F.lit(0.0)).alias(b) for b in BASES])
    total = sum((F.col(b) for b in BASES), F.lit(0.0)) + 4 * pseudo
    one = c.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.when(total > 0, (F.col(b) + pseudo) / total).otherwise(0.25).alias("freq")) for b in BASES])).alias("x"))
    return one.select("x.base", "x.freq")


def position_freq(ws: DataFrame, length: int) -> DataFrame:
    """(pos, base, n, p) with p = (n + 0.5) / (N + 2), for every cell."""
    n = symbols(ws, length).groupBy("pos", "base").agg(F.count("*").alias("n"))
    g = grid(ws.sparkSession, length).join(F.broadcast(n), ["pos", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return g.withColumn("p", (F.col("n") + PSEUDO) / (F.sum("n").over(Window.partitionBy("pos")) + 4 * PSEUDO))


def conditional_freq(ws: DataFrame, length: int, parents: dict[int, int] | None = None) -> DataFrame:
    """(pos, prev, curr, n, p): symbol at pos given the symbol at its parent (by default the position before), with
    p = (n + 0.5) / (n_prev + 2), for every cell."""
    parents = parents or {i: i - 1 for i in range(1, length)}
    at = F.array(*[F.struct(F.lit(c).alias("pos"), F.col("w").substr(p + 1, 1).alias("prev"), F.col("w").substr(c + 1, 1).alias("curr")) for c, p in sorted(parents.items())])
    n = ws.select(F.explode(at).alias("x")).groupBy("x.pos", "x.prev", "x.curr").agg(F.count("*").alias("n"))
    g = grid(ws.sparkSession, length, 2).where(F.col("pos").isin(*parents)).join(F.broadcast(n), ["pos", "prev", "curr"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return g.withColumn("p", (F.col("n") + PSEUDO) / (F.sum("n").over(Window.partitionBy("pos", "prev")) + 4 * PSEUDO))


def pair_counts(ws: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    """(i, j, a, b, n) for all position pairs i < j with their observed symbol pairs."""
    by = by or []
    i = F.explode(F.sequence(F.lit(0), F.lit(length - 2))).alias("i")
    j = F.explode(F.sequence(F.col("i") + 1, F.lit(length - 1))).alias("j")
    x = ws.select("w", *by, i).select("w", *by, "i", j)
    return x.groupBy(*by, "i", "j", F.col("w").substr(F.col("i") + 1, F.lit(1)).alias("a"), F.col("w").substr(F.col("j") + 1, F.lit(1)).alias("b")).agg(F.count("*").alias("n"))


def chi2_pairs(counts: DataFrame) -> DataFrame:
    """(i, j, score): chi-square of each 4x4 table, by N * (sum n^2 / (row * column) - 1), which needs no empty cells."""
    w = lambda *c: F.sum("n").over(Window.partitionBy("i", "j", *c))  # noqa: E731  (at most positions^2 x 16 rows)
    x = counts.select("i", "j", "n", w("a").alias("r"), w("b").alias("c"))
    g = x.groupBy("i", "j").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n") / (F.col("r").cast("double") * F.col("c"))).alias("q"))
    return g.select("i", "j", F.greatest(F.lit(0.0), F.col("t") * (F.col("q") - 1)).alias("score"))


def dependency_pairs(chi2: DataFrame, threshold: float = DEPENDENCY_THRESHOLD, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(i, j, score, rank): the pairs at or above the threshold - all if there is none - by score descending, ties by (i, j); the first
    max_pairs."""
    best = F.max("score").over(Window.partitionBy())  # 253 rows at most
    x = chi2.withColumn("_b", best).where((F.col("score") >= threshold) | (F.col("_b") < threshold)).drop("_b")
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "i", "j"))).where(F.col("rank") <= max_pairs)


def joint_smoothed(counts: DataFrame) -> DataFrame:
    """(i, j, a, b, p): 0.5 is added to observed pairs only, total = N + 0.5 * number of observed pairs."""
    w = Window.partitionBy("i", "j")
    return counts.select("i", "j", "a", "b", ((F.col("n") + PSEUDO) / (F.sum("n").over(w) + PSEUDO * F.count("*").over(w))).alias("p"))


def mutual_information(joint: DataFrame, freq: DataFrame) -> DataFrame:
    """(i, j, mi) in nats over all 16 cells, unobserved ones with p = 1e-10, marginals from position_freq; not below 0."""
    f = freq.select("pos", "base", F.col("p").alias("q"))
    n = freq.agg(F.max("pos")).first()[0] + 1
    base = F.array(*[F.lit(b) for b in BASES])
    cells = freq.sparkSession.range(0, n - 1).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1))).alias("j"))
    cells = cells.select("i", "j", F.explode(base).alias("a")).select("i", "j", "a", F.explode(base).alias("b"))
    cells = cells.join(F.broadcast(f.select(F.col("pos").alias("i"), F.col("base").alias("a"), F.col("q").alias("pa"))), ["i", "a"])
    cells = cells.join(F.broadcast(f.select(F.col("pos").alias("j"), F.col("base").alias("b"), F.col("q").alias("pb"))), ["j", "b"])
    x = cells.join(joint, ["i", "j", "a", "b"], "left").withColumn("p", F.coalesce("p", F.lit(1e-10)))
    return x.groupBy("i", "j").agg(F.greatest(F.lit(0.0), F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb"))))).alias("mi"))


def dependency_strength(chi2: DataFrame) -> DataFrame:
    """(pos, strength): sum of the scores of all pairs of a position."""
    ends = chi2.select(F.col("i").alias("pos"), "score").unionByName(chi2.select(F.col("j").alias("pos"), "score"))
    return ends.groupBy("pos").agg(F.sum("score").alias("strength"))


def log_odds(fg: Column, bg: Column, floor: float = 1e-10) -> Column:
    return F.ln(F.greatest(fg, F.lit(floor)) / F.greatest(bg, F.lit(floor)))
