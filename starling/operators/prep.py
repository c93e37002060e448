"""Data preparation: scaling, seed masks, class dictionary, label coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starling.functions.draws import hash_key
from starling.sources.tables import UNLABELLED


def standard_scale(points: DataFrame) -> DataFrame:
    """(x - mean) / population standard deviation for each feature; a constant feature is only centred.

    Two passes: sums by feature (combined before the shuffle, one row a feature), then a
    row-wise expression with the sums as broadcast arrays.
    """
    long = points.select(F.posexplode("features").alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("stats"))
    joined = points.join(F.broadcast(stats))  # one row, as wide as the features
    return joined.select("node_id", F.transform("features", lambda x, i: (x - F.get("stats", i)["m"]) / F.get("stats", i)["s"]).alias("features"))


def class_dictionary(labels: DataFrame) -> DataFrame:
    """``label, idx``: the distinct labels but -1, numbered from 0 in ascending order."""
    known = labels.where(F.col("label") != UNLABELLED).select("label").distinct()
    # classes are few: the window sees one row for each
    return known.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def encode_labels(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``node_id, cls``: class numbers, -1 for unlabelled nodes."""
    return labels.join(classes, "label", "left").select("node_id", F.coalesce("idx", F.lit(-1)).alias("cls"))


def decode_labels(coded: DataFrame, classes: DataFrame) -> DataFrame:
    """``node_id, label``: the original labels of class numbers."""
    back = classes.select(F.col("idx").alias("cls"), "label")
    return coded.join(back, "cls", "left").select("node_id", F.coalesce("label", F.lit(UNLABELLED)).alias("label"))


def _masked(rows: DataFrame, group: str, quota: DataFrame) -> DataFrame:
    """``rows`` (``node_id, label, h`` and the group); in each group the ``take`` rows of ``quota`` with the smallest keys ``h`` keep their labels, the rest become -1.

    Keys are hexadecimal and counted by their first four digits (65,536 counts a group at most); only the bucket
    with the cut is sorted, for the largest key that is kept.  So no task ever holds a group, and rows are compared with that key where they are.
    """
    bucketed = rows.withColumn("_b", F.substring("h", 1, 4))
    counts = bucketed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    cuts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).join(quota, group)
    cuts = cuts.where((F.col("_before") < F.col("take")) & (F.col("take") <= F.col("_before") + F.col("_n")))
    cut = bucketed.join(cuts.select(group, "_b", (F.col("take") - F.col("_before")).alias("_left")), [group, "_b"])
    cut = cut.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_b").orderBy("h"))).where("_k = _left").select(group, F.col("h").alias("_last"))
    kept = F.when(F.col("h") <= F.col("_last"), F.col("label")).otherwise(F.lit(UNLABELLED))
    return rows.join(cut, group, "left").select(*([group] if group == "run" else []), "node_id", kept.alias("label"))


def seed_mask_global(labels: DataFrame, fraction: float, seed: int) -> DataFrame:
    """floor(n * fraction) nodes, drawn by a hash of (seed, node), keep their labels; the rest become -1."""
    rows = labels.select("node_id", "label", F.lit(0).alias("g"), hash_key(F.lit(seed), F.col("node_id")).alias("h"))
    quota = labels.agg(F.floor(F.count("*") * F.lit(float(fraction))).alias("take")).select(F.lit(0).alias("g"), "take")
    return _masked(rows, "g", quota)


def seed_masks_global(labels: DataFrame, fraction: float, runs: int) -> DataFrame:
    """``run, node_id, label``: the global masks of the seeds 0 to ``runs`` - 1, in one plan."""
    each = labels.select("node_id", "label", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    quota = each.groupBy("run").agg(F.floor(F.count("*") * F.lit(float(fraction))).alias("take"))
    return _masked(each.withColumn("h", hash_key(F.col("run"), F.col("node_id"))), "run", quota)


def seed_mask_stratified(labels: DataFrame, fraction: float, seed: int) -> DataFrame:
    """round-half-even(fraction * size) nodes of each class keep their labels; the rest become -1."""
    rows = labels.select("node_id", "label", F.col("label").alias("g"), hash_key(F.lit(seed), F.col("node_id")).alias("h"))
    quota = labels.groupBy(F.col("label").alias("g")).agg(F.bround(F.count("*") * F.lit(float(fraction))).cast("long").alias("take"))
    return _masked(rows, "g", quota)
