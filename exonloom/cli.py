"""Command line: train, evaluate, predict, scan a table, demo. `spark-submit -m exonloom.cli ...` or `python -m exonloom.cli`."""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exonloom.operators import evaluate, plot, scorers
from exonloom.operators.scan import scan, scan_sequence
from exonloom.operators.split import balanced, labelled_windows, strict_split
from exonloom.operators.windows import canonical_windows, hard_negatives, interval_windows, sequences
from exonloom.runtime import local_session
from exonloom.sources import records, synthetic
from exonloom.sources.store import write_tsv
from exonloom.sources.tables import table
from exonloom.spec import site


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("exonloom")
    p.add_argument("command", choices=("train", "evaluate", "predict", "scan", "demo"))
    p.add_argument("--site", default="donor", choices=("donor", "acceptor"))
    p.add_argument("--tables", help="folder of the Parquet tables; synthetic windows without it")
    p.add_argument("--model", default="wmm", choices=scorers.KINDS)
    p.add_argument("--path", help="folder of a stored model (train writes, predict and scan read)")
    p.add_argument("--gene-files", nargs=2, metavar=("TRAIN", "TEST"), help="two different folders of gene files, in place of --tables")
    p.add_argument("--out", help="folder for all hits of scan as tab-separated values")
    p.add_argument("--cost", type=float, default=1.0)
    p.add_argument("--predict", metavar="SEQUENCE")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--dependency-threshold", type=float, default=6.0)
    p.add_argument("--max-dependency-pairs", type=int, default=16)
    p.add_argument("--max-parents", type=int, default=2)
    p.add_argument("--svg", help="file for the ROC curve")
    return p


def training_set(spark, spec, tables: str | None):
    """(split, label, w) of the tables, or a synthetic set of 800 training and 200 test windows of each class."""
    if tables:
        return balanced(strict_split(labelled_windows(table(spark, tables, "dataset"), spec)))
    both = [synthetic.windows(spark, spec, 1000, k, dependent=True).withColumn("id", F.monotonically_increasing_id()).withColumn("split", F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, "test").otherwise("train")) for k in (1, 0)]
    return both[0].unionByName(both[1]).select("split", "label", "w")


def gene_file_set(spark, spec, train: str, test: str):
    """(split, label, w) from two folders of gene files; ValueError if they are one and the same."""
    if os.path.realpath(train) == os.path.realpath(test):
        raise ValueError("training and test files must lie in different folders")
    parts = []
    for name, path in (("train", train), ("test", test)):
        seqs = sequences(records.parse_records(records.read_texts(spark, path)), "file_name")
        pos, every = interval_windows(seqs, "file_name", spec), canonical_windows(seqs, "file_name", spec)
        parts += [pos.select(F.lit(name).alias("split"), F.lit(1).alias("label"), F.col("win").alias("w")), hard_negatives(every, pos).select(F.lit(name).alias("split"), F.lit(0).alias("label"), F.col("win").alias("w"))]
    return balanced(strict_split(reduce(DataFrame.unionByName, parts).distinct()))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spec = site(a.site)
    spark = local_session()
    if a.path and a.command in ("predict", "scan"):
        model = scorers.load(spark, a.path)
        if model.params.get("site") != spec.name:
            raise ValueError(f"the model at {a.path} is of site {model.params.get('site')}")
    else:
        data = (gene_file_set(spark, spec, *a.gene_files) if a.gene_files else training_set(spark, spec, a.tables)).cache()
        model = scorers.fit(a.model, data.where("split = 'train'"), spec, a.dependency_threshold, a.max_dependency_pairs, a.max_parents, cost=a.cost)
        if a.command == "train":
            model.save(spark, a.path or "model")
            return 0
        if a.command in ("evaluate", "demo"):
            rows = evaluate.usable(data.where("split = 'test'").withColumn("model", F.lit(a.model)).withColumn("score", model.score(F.col("w"))), "model")
            evaluate.compare(rows, a.threshold).show(50, False)
            if a.svg:
                with open(a.svg, "w") as f:
                    f.write(plot.roc_svg(evaluate.roc_curve(rows), evaluate.roc_auc(rows)))
    if a.command == "scan":
        hits = scan(sequences(table(spark, a.tables, "gene_records"), "record_id"), "record_id", spec, model.score, a.threshold)
        write_tsv(hits, a.out or "hits")  # all of them, however many
    if a.predict:
        hits = scan_sequence(spark, a.predict, spec, model.score, a.threshold).collect()
        print("\n".join(f"{h.pos}\t{h.score:.4f}\t{h.win}" for h in hits) or "No sites above threshold.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
