"""Mixing sources to target weights (problem 8).

Method: Efraimidis-Spirakis sampling. Each document draws an exponential key -ln(u) / quality; within its source the documents
are taken in the order of the keys until the prefix sum of their tokens reaches the source's budget. Complete epochs come before
the fractional selection: a budget of 2.3 times what the source holds takes every document twice and then selects 0.3.

The prefix sums are taken in steps, so that no source is sorted as a whole: token sums of BUCKETS key ranges per source tell which
range a budget ends in - one row a source, which is all that goes back to the documents -, and only within that range the documents
are ordered, cut once more into bins of equal count."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exonloom.operators.ranking import running_totals
from exonloom.runtime import BROADCAST_ROWS, write_table

BUCKETS = 4096
_encoders: dict = {}


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary of the environment."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> DataFrame:
    """docs (without the text) with `n_tokens` of the whole text; null counts 0. The text goes to Python once, nothing is shuffled."""
    path = tokenizer or default_tokenizer()
    rest = [c for c in docs.columns if c != text_col and c != "n_tokens"]

    def run(batches):
        enc = _encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    schema = docs.select(*rest, F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.select(text_col, *rest).mapInArrow(run, schema)


def quality(text: Column) -> Column:
    """Quality weight in 0.05..1 of a text: its share of letters and blanks, damped for texts of under 200 characters."""
    n = F.greatest(F.length(text), F.lit(1))
    plain = F.length(F.regexp_replace(text, r"[^\p{L} ]", "")) / n
    return F.greatest(F.lit(0.05), F.coalesce(plain * F.least(F.lit(1.0), F.sqrt(n / 200.0)), F.lit(0.05)))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    documents: doc_id, source, n_tokens, n_uses for every document that is used. shares: per source of either side the wanted and
    the actual share, tokens at hand and mixed, documents used and the passes its budget asks for.

    total_tokens: size of the mix; by default the largest at which every source that has tokens reaches its share without any
    document being used more than max_repeats times. Given a larger total, a source stops at its cap and falls short, which the
    shares show. Shares are relative to the sum over the sources that have tokens. Documents of unlisted or null sources and texts
    without tokens aren't used; a listed source without documents gets 0; null or negative shares and caps count as 0. Keys come
    from doc_id and seed: the same input gives the same mix; ties go by doc_id."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    base = docs.select("text", "doc_id", "source", quality(F.col("text")).alias("w"))
    base = token_counts(base, tokenizer).withColumn("key", -F.ln(u) / F.col("w"))
    base = base.withColumn("bucket", F.floor(F.lit(BUCKETS) * (1 - F.exp(-F.col("key") / 4))).cast("int"))
    base = write_table(base.select("doc_id", "source", "n_tokens", "key", "bucket"), "mix-tokens")
    ranges = write_table(base.where("source is not null and n_tokens > 0").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "mix-ranges")
    have = ranges.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("n_docs"))
    want = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest("max_repeats", F.lit(0))).alias("max_repeats"))
    plan = have.join(want, "source", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "n_docs", "target_share", "max_repeats")})
    plan = write_table(plan, "mix-plan")
    usable = plan.where("tokens > 0 and target_share > 0 and max_repeats > 0")
    whole = usable.agg(F.sum("target_share")).first()[0] or 1.0
    total = total_tokens or usable.agg(F.min((F.col("max_repeats") * F.col("tokens") * whole / F.col("target_share")).cast("long"))).first()[0] or 0
    budget = F.least(F.col("max_repeats") * F.col("tokens"), F.round(F.col("target_share") / whole * total)).cast("long")
    plan = plan.withColumn("budget", F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), budget).otherwise(0))
    plan = plan.withColumns({"epochs": F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")}).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens"))
    # whole key ranges first: taken while the budget covers them; the range it ends in is the edge
    cum = ranges.join(plan.where("budget > 0").select("source", "epochs", "left"), "source").withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("bucket")))
    cum = cum.withColumn("before", F.col("upto") - F.col("t"))
    at_edge = (F.col("upto") > F.col("left")) & (F.col("before") < F.col("left"))
    ends = cum.groupBy("source", "epochs", "left").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("bucket"))).alias("last"), F.max(F.when(at_edge, F.col("bucket"))).alias("edge"), F.max(F.when(at_edge, F.col("before"))).alias("before"))
    ends = write_table(ends, "mix-ends")
    docs_ = base.where("n_tokens > 0").join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, "source")
    on_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    inside = docs_.where(~on_edge).select("doc_id", "source", "n_tokens", (F.col("epochs") + F.coalesce(F.col("bucket") <= F.col("last"), F.lit(False)).cast("int")).alias("n_uses"))
    edge = running_totals(write_table(docs_.where(on_edge), "mix-edge"), "source", "key", ["n_tokens"], descending=False).withColumn("sum", F.col("before") + F.col("cum_n_tokens"))
    edge = edge.select("doc_id", "source", "n_tokens", (F.col("epochs") + (F.col("sum") - F.col("n_tokens") / 2 <= F.col("left")).cast("int")).alias("n_uses"))
    used = inside.unionByName(edge).where("n_uses > 0")
    per = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("mixed_tokens"), F.count("*").alias("n_used"), F.max("n_uses").alias("most_uses"))
    shares = plan.join(per, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mixed_tokens", "n_used", "most_uses")})
    all_tokens = F.greatest(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(1))  # one row a source
    shares = shares.select("source", "target_share", (F.col("mixed_tokens") / all_tokens).alias("actual_share"), F.col("tokens").alias("available_tokens"), "mixed_tokens", "n_docs", "n_used", "most_uses", "max_repeats")
    return used, shares
