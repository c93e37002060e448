"""Evaluation: accuracy, confusion, class report, summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(predicted: DataFrame, truth: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``truth, pred`` of all nodes, or of those that ``seeds`` leaves unlabelled."""
    d = predicted.select("node_id", F.col("label").alias("pred")).join(truth.select("node_id", F.col("label").alias("truth")), "node_id")
    if seeds is not None:
        d = d.join(seeds.where("label = -1").select("node_id"), "node_id", "left_semi")
    return d.select("truth", "pred")


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def class_report(pairs: DataFrame) -> DataFrame:
    """``name, precision, recall, f1, support``: each class, then accuracy, macro and weighted averages."""
    # from here on everything is as small as the confusion table
    cells = confusion(pairs)
    sums = lambda c, name: cells.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name))
    hit = cells.where("truth = pred").select(F.col("truth").alias("class"), F.col("n").alias("hit"))
    d = sums("truth", "support").join(sums("pred", "said"), "class", "full").join(hit, "class", "left").na.fill(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumns({"precision": share(F.col("hit"), F.col("said")), "recall": share(F.col("hit"), F.col("support"))})
    d = d.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    each = d.select(F.col("class").cast("string").alias("name"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    names = ["precision", "recall", "f1"]
    macro = d.agg(F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in names], total.alias("support"))
    weighted = d.agg(F.lit("weighted avg").alias("name"), *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names], total.alias("support"))
    right = F.sum("hit") / total
    acc = d.agg(F.lit("accuracy").alias("name"), right.alias("precision"), right.alias("recall"), right.alias("f1"), total.alias("support"))
    return each.union(acc).union(macro).union(weighted)


def run_summary(runs: DataFrame) -> DataFrame:
    """Mean and population standard deviation of ``seconds`` and ``accuracy`` for each ``mode``."""
    return runs.groupBy("mode").agg(
        F.count("*").alias("runs"), F.avg("seconds").alias("mean_seconds"), F.stddev_pop("seconds").alias("std_seconds"),
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"),
    )


def speedups(summary: DataFrame) -> DataFrame:
    """``slow, fast, ratio`` of mean seconds for each two modes (summaries are one row a mode)."""
    a = summary.select(F.col("mode").alias("slow"), F.col("mean_seconds").alias("s"))
    b = summary.select(F.col("mode").alias("fast"), F.col("mean_seconds").alias("f"))
    return a.join(b, F.col("slow") > F.col("fast")).select("slow", "fast", (F.col("s") / F.col("f")).alias("ratio"))
