"""Column expressions that the plans are made of; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ladder(*rules: tuple[Column, object], default: object = None) -> Column:
    """The value of the first rule whose condition is true. A condition that is null doesn't hold."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def bands(x: Column | str, *steps: tuple[float, object], default: object = None, below: bool = False) -> Column:
    """A ladder over one number: the first step that it reaches (or, with ``below``, is under)."""
    x = col(x)
    return ladder(*[((x < t) if below else (x >= t), v) for t, v in steps], default=default)


def has_any(x: Column | str, words: Iterable[str]) -> Column:
    """Whether a text, in lower case, holds any of the strings; never null."""
    low = F.lower(col(x))
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(False))


def starts_with_any(x: Column | str, prefixes: Iterable[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [col(x).startswith(p) for p in prefixes]), F.lit(False))


def hits(x: Column | str, words: Iterable[str]) -> Column:
    """How many of the strings a text, in lower case, holds."""
    low = F.lower(col(x))
    return F.coalesce(reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]), F.lit(0))


def capped_join(items: Column | str, n: int, mark: str = "|") -> Column:
    """The first n entries of a list as one string."""
    return F.concat_ws(mark, F.slice(col(items), 1, n))


def truncated(x: Column | str, n: int) -> Column:
    x = col(x)
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def upper_median(values: Column | str) -> Column:
    """The upper one of the middle values of a list; null for an empty list."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def present_mean(parts: Sequence[Column]) -> Column:
    """The mean of those parts that are there; null if none is."""
    there = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def safe_ratio(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    return F.when(col(b) > 0, F.round(col(a) / col(b), digits)).otherwise(F.lit(0.0))


def weighted(parts: Sequence[tuple[Column | str, float]], top: float = 10.0) -> Column:
    """A weighted sum of scores as a share of the greatest one possible, times 100."""
    total = reduce(lambda a, b: a + b, [col(c) * F.lit(float(w)) for c, w in parts])
    return total / F.lit(top * sum(w for _, w in parts)) * F.lit(100.0)


def letters_sum(x: Column | str, weights: dict[str, float]) -> Column:
    """The sum of the weights of a text's characters, from how much shorter it gets without each."""
    x = col(x)
    size = F.char_length(x)
    return reduce(lambda a, b: a + b, [(size - F.char_length(F.replace(x, F.lit(c), F.lit("")))) * F.lit(w) for c, w in weights.items()])


def optional(df: DataFrame, name: str, default: object, kind: str) -> Column:
    """A column if the table has it, cast, with a default for nulls; else the default."""
    value = F.lit(default).cast(kind)
    return F.coalesce(F.col(name).try_cast(kind), value) if name in df.columns else value


def sentinel_null(x: Column | str, marks: Iterable[str] = ("", "N/A", "NA", "NaN", "nan", "null", "None", "Not Found", "Error", "Unknown")) -> Column:
    """Null in place of strings that stand for nothing."""
    x = col(x)
    return F.when(~x.isin(list(marks)), x)


def lines(*parts: Column) -> Column:
    """An array of those texts that are there."""
    return F.array_compact(F.array(*parts))
