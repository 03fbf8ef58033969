"""Evaluation: areas under the curve, confusion, correlation with its probability; no row is collected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rows with the mean rank of their value among all. Ranks are running sums over the distinct values.

    The distinct values are counted first, so what one task sees to rank them is a row per value, range by range.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("__n")).repartitionByRange(F.col(value)).withColumn("__part", F.spark_partition_id())
    totals = counts.groupBy("__part").agg(F.sum("__n").alias("__all"))
    before = totals.select("__part", (F.sum("__all").over(Window.orderBy("__part")) - F.col("__all")).alias("__before"))
    inside = F.sum("__n").over(Window.partitionBy("__part").orderBy(value))
    ranked = counts.withColumn("__upto", inside).join(F.broadcast(before), "__part")
    rank = F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)
    return df.join(ranked.select(value, rank.alias(name)), value)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: n_pos, n_neg, auc by ranks, with ties halved. Null with one class alone."""
    held = with_average_rank(df.select(score, label), score, "__rank")
    sums = held.agg(F.sum(F.when(F.col(label) == 1, F.col("__rank"))).alias("r"), F.sum((F.col(label) == 1).cast("long")).alias("n_pos"), F.sum((F.col(label) != 1).cast("long")).alias("n_neg"))
    area = (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0)) / (F.col("n_pos") * F.col("n_neg"))
    return sums.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), area).alias("auc"))


def confusion(df: DataFrame, predicted: Column, label: Column) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, precision, recall, f1; a share of nothing is 0."""
    p, y = predicted.cast("int"), label.cast("int")
    cell = lambda a, b: F.coalesce(F.sum(((y == a) & (p == b)).cast("long")), F.lit(0))
    c = df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    c = c.select("*", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the correlation of average ranks."""
    held = with_average_rank(with_average_rank(df.select(a, b), a, "__ra"), b, "__rb")
    return held.agg(F.count("*").alias("n"), F.corr("__ra", "__rb").alias("rho"))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided probability of a correlation at least as strong, from Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for k, term in ((0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))), (1, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))):
            d = 1 / ((1 + term * d) or 1e-300)
            c = (1 + term / c) or 1e-300
            h *= d * c
            if k and abs(d * c - 1) < 1e-15:
                return front * h
    return front * h
