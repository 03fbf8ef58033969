"""The k-th value of each key, exactly, without a list of its values and without one task for one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE = 64  # bins for each factor of e
FINE = 4096  # bins between the least and the greatest value of a coarse one


def kth_value(df: DataFrame, keys: Sequence[str], value: str, place: Column, name: str) -> DataFrame:
    """A row per key with its ``place``-th smallest value, from 0; ``place`` is a Column of ``n``, how many values the key has.

    Equal values are counted first. The values fall into coarse bins by sign and logarithm; running sums over a key's bins tell in which one
    the place lies. That bin alone is parted into even bins between its least and greatest value, and running sums tell again; of the last bin
    the distinct values are gone through. Bins only have to keep the order of the values, which rounding doesn't change, so the result is
    exact. A key with all rows is counted by many tasks, and no task goes through more than its bins or one bin's distinct values.

    Nulls are no values and NaN is greater than all others; a key without values, or a place that none has, gives no row; keys may be
    null; an empty table gives no rows.
    """
    x = F.col("__x")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    size = F.least(F.log(F.abs(x)), F.lit(1e6))  # infinite ones too
    far = F.floor((F.greatest(size, F.lit(-800.0)) + 801) * COARSE).cast("long")
    coarse = F.when(F.isnan(x), F.lit(2**62)).when(x == 0, 0).when(x < 0, -far).otherwise(far)
    rows = counted.withColumn("__x", F.col("__v").cast("double")).withColumn("__b", coarse)
    first = _chosen(rows, keys, None, place)
    near = _met(rows, first, keys)
    width = F.col("__hi") - F.col("__lo")
    fine = F.when(width > 0, F.floor((x - F.col("__lo")) / width * FINE)).otherwise(F.lit(0)).cast("long")
    # where the values are too far apart, or aren't finite, the bin stays whole
    fine = F.when(F.isnan(width) | (width == float("inf")), F.lit(0)).otherwise(fine)
    rows = near.withColumns({"__b": fine, "__left": F.col("__place")}).drop("__lo", "__hi", "__place")
    last = _chosen(rows, keys, "__left", place)
    held = _met(rows.drop("__left"), last, keys)
    order = Window.partitionBy(*keys).orderBy("__v")
    upto = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = held.withColumn("__upto", upto).where((F.col("__place") < F.col("__upto")) & (F.col("__place") >= F.col("__upto") - F.col("__n")))
    return found.select(*keys, F.col("__v").alias(name))


def _chosen(rows: DataFrame, keys: Sequence[str], left: str | None, place: Column) -> DataFrame:
    """Of each key the bin in which the place lies, its least and greatest value, and the place within it. The place
    is in the column ``left``, or follows from how many values there are."""
    more = [F.max(left).alias("__goal")] if left else []
    bins = rows.groupBy(*keys, "__b").agg(F.sum("__n").alias("__m"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), *more)
    whole = Window.partitionBy(*keys)
    upto = F.sum("__m").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumns({"__upto": upto, "n": F.sum("__m").over(whole)})
    goal = F.col("__goal") if left else place
    inside = (goal < F.col("__upto")) & (goal >= F.col("__upto") - F.col("__m"))
    return bins.where(inside).select(*keys, "__b", "__lo", "__hi", (goal - (F.col("__upto") - F.col("__m"))).alias("__place"))


def _met(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the chosen bins; null keys are keys."""
    names = {c: f"__k{i}" for i, c in enumerate([*keys, "__b"])}
    side = chosen.withColumnsRenamed(names)
    on = None
    for c, k in names.items():
        same = rows[c].eqNullSafe(side[k])
        on = same if on is None else on & same
    return rows.join(side, on).drop(*names.values())


def upper_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "upper_median") -> DataFrame:
    """The upper one of the middle values of each key."""
    return kth_value(df, keys, value, F.floor(F.col("n") / 2), name)
