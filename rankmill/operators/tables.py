"""Operators on whole tables: attaching, lookups, ranking, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SPREAD = 32  # parts that rows without a key are dealt to where they meet others without


def attach(left: DataFrame, right: DataFrame, key: str | Sequence[str], defaults: dict | None = None, unique: bool = False, both: bool = False) -> DataFrame:
    """A left join on the key in which null meets null, with defaults for what isn't found.

    Rows with a whole key meet in an equi-join, and the optimizer picks which. Those of ``left`` with a null in the key never enter it, so
    they burden no task: where ``right`` is ``unique`` (one row per key at most) a single one can answer them, which is handed to
    each; else they are dealt to parts, and the few rows of ``right`` without a key are there in each part. Equal rows on either side
    are rows of their own; an empty side gives nulls or nothing; columns keep the order left, right.

    If ``both`` sides have one row per key at most, one row of each can be without it: then ``left`` is read once, its one row stays in the
    join, and a chain of such attaches is no larger than its links. If ``right`` has more of them after all, the least is the answer.
    """
    keys = [key] if isinstance(key, str) else list(key)
    whole, broken = _whole(keys), ~_whole(keys)
    others = [c for c in right.columns if c not in keys]
    if both and len(keys) == 1 and others:
        (k,) = keys
        held = right.select(F.col(k).alias("__key"), F.struct(*others).alias("__own"))
        # one row, whatever is there: of several without a key the least counts
        least = F.first if any("map<" in t or "variant" in t for _, t in right.dtypes) else F.min
        one = F.broadcast(held.where("__key IS NULL").agg(least("__own").alias("__one")))
        out = left.join(held.where("__key IS NOT NULL"), F.col(k) == F.col("__key"), "left").join(one, F.col(k).isNull(), "left")
        answer = F.when(F.col(k).isNull(), F.col("__one")).otherwise(F.col("__own"))
        out = out.withColumn("__answer", answer).select("*", "__answer.*").drop("__key", "__own", "__one", "__answer")
        return out.fillna(defaults) if defaults else out
    met = left.where(whole).join(right.where(whole), keys, "left").select(*left.columns, *others)
    without, answers = left.where(broken), right.where(broken)
    if unique and len(keys) == 1:
        # a proven bound: of one key there is one row
        alone = without.join(F.broadcast(answers.select(others)), F.lit(True), "left")
    else:
        names = {k: f"__key{i}" for i, k in enumerate(keys)}
        dealt = without.withColumn("__part", F.monotonically_increasing_id() % SPREAD)
        each = answers.select(F.explode(F.expr(f"sequence(0L, {SPREAD - 1}L)")).alias("__in"), *[F.col(k).alias(n) for k, n in names.items()], *others)
        on = F.col("__part") == F.col("__in")
        # a single null key meets a null key; of several keys the others decide
        for k, n in names.items() if len(keys) > 1 else ():
            on = on & dealt[k].eqNullSafe(F.col(n))
        alone = dealt.join(each, on, "left")
    out = met.unionByName(alone.select(*left.columns, *others))
    return out.fillna(defaults) if defaults else out


def lookup(left: DataFrame, right: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """A left join on the key in which a null key finds nothing; rows without one don't enter the join at all."""
    out = left.where(F.col(key).isNotNull()).join(right.where(F.col(key).isNotNull()), key, "left").select(*left.columns, *[c for c in right.columns if c != key])
    out = out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
    return out.fillna(defaults) if defaults else out


def _whole(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def resolve_key(df: DataFrame, names: Sequence[str] = ("Gene", "gene", "Gene_Symbol", "gene_symbol")) -> str:
    """The first of the names that the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(names)} is a column")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark limits the groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__rank").drop("__rank")


def ordered_join(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, mark: str, name: str) -> DataFrame:
    """One row per key: the texts of its rows, in order, as one string. For keys with few rows, as after ``top_k``."""
    held = df.select(*keys, F.struct(*order, text.alias("__text")).alias("__row"))
    return held.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__row")), lambda r: r["__text"]), mark).alias(name))


def value_counts(df: DataFrame, column: str, name: str = "n", by_value: bool = False, down: bool = False) -> DataFrame:
    """How many rows have each value, the most frequent first, or in the order of the values, or ``down`` that order."""
    order = (F.desc_nulls_last(column) if down else F.col(column),) if by_value or down else (F.desc(name), F.col(column))
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(*order)


def multilabel_counts(df: DataFrame, labels: Column, label: str = "label", name: str = "n") -> DataFrame:
    """How many rows have each of the labels in a list; counted before any shuffle."""
    return df.select(F.explode(F.array_distinct(labels)).alias(label)).groupBy(label).agg(F.count("*").alias(name))


def null_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each column how many rows have a value, and their share; one pass."""
    counted = df.agg(F.count("*").alias("__all"), *[F.count(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_present")) for c in columns])).alias("p")
    share = F.when(F.col("__all") > 0, F.round(100.0 * F.col("p.n_present") / F.col("__all"), 2))
    return counted.select(pairs, "__all").select("p.column_name", "p.n_present", share.alias("pct_present"))


def priority_lookup(df: DataFrame, key: str, sources: Sequence[DataFrame], value: str) -> DataFrame:
    """The value of the first source that has the key. Each source has (key, value), a row per key."""
    out, found = df, []
    for i, source in enumerate(sources):
        name = f"__{value}{i}"
        out = out.join(source.select(key, F.col(value).alias(name)), key, "left")
        found.append(F.col(name))
    return out.withColumn(value, F.coalesce(*found)).drop(*[f"__{value}{i}" for i in range(len(sources))])
