"""Fields that are a text, a list, or an object by turns: each is parsed once, to a variant, and read from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARSED = "__parsed_"


def parsed(df: DataFrame, *names: str) -> DataFrame:
    """The table with a variant beside each of the fields; what isn't JSON has none. ``drop_parsed`` takes them away."""
    return df.withColumns({_PARSED + n: F.try_parse_json(n) for n in names})


def drop_parsed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_PARSED)])


def value(name: str, path: str = "$", kind: str = "string", first: bool = False) -> Column:
    """What a field has at a path; with ``first`` that of the first object, where the field is a list of them."""
    v = F.col(_PARSED + name)
    if first:
        v = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    return F.try_variant_get(v, path, kind)


def listed(name: str) -> Column:
    """A field that is a list of texts, or one text, as array<string>; null without either."""
    raw, said = F.col(name), F.trim(name)
    alone = F.when(said.startswith('"'), value(name)).otherwise(raw)
    return F.when(said.startswith("["), value(name, kind="array<string>")).when(raw.isNotNull(), F.array(alone))


def listed_in(name: str, path: str, first: bool = False) -> Column:
    """The same for what a field has at a path."""
    alone = value(name, path, first=first)
    return F.coalesce(value(name, path, "array<string>", first), F.when(alone.isNotNull(), F.array(alone)))


def members(name: str, member: str) -> Column:
    """One member of the objects of a list, or of one object."""
    shape = f"struct<{member}:string>"
    many = F.when(F.trim(name).startswith("["), value(name, kind=f"array<{shape}>")).otherwise(F.array(value(name, kind=shape)))
    return F.transform(many, lambda e: e[member])
