"""Rules as rows: which rules of a table hold for which texts and ids, by an inverted index of the rules.

A keyword rule can only hold where all its trigrams are. Each one is filed under a single trigram, the one that the fewest texts have; texts
meet the rules by equality of trigrams, and what meets is verified. A rule with a trigram that no text has is left out. Rules of ids
meet the rows' ids. So a row is compared with the rules that it may satisfy, not with each, and thousands of rules cost no longer plan.

The trigrams of texts are never shuffled: up to ``HANDED`` rules are handed to each task, and a text meets them where it was read. Only hits move, by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
HANDED = 100_000  # rules; beyond, rows and rules meet in a shuffle, in parts
PARTS = 32
KEYWORD = "Keyword"
RULES = "family_no int, rule_no int, family string, kind string, value string"
HIT = ["family_no", "rule_no", "family", "evidence"]


def rule_table(spark: SparkSession, families: dict[str, dict]) -> DataFrame:
    """``{name: {"keywords": [...], "ids": [...]}}`` as rows, in order."""
    kind = lambda i: "Pfam" if i.startswith("PF") else "InterPro"
    rows = []
    for no, (name, rule) in enumerate(families.items()):
        told = [(KEYWORD, k) for k in rule.get("keywords", [])] + [(kind(i), i) for i in rule.get("ids", [])]
        rows += [(no, i, name, *x) for i, x in enumerate(told)]
    return spark.createDataFrame(rows, RULES)


def _grams(text: str, size: int) -> Column:
    """All strings of that many characters in a text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1) if size else F.array(F.lit(""))


def _met(rows: DataFrame, rules: DataFrame, on: str, handed: bool) -> DataFrame:
    """Rows, with a column key, and the rules filed under the same value. A value that most rows have is no task's alone: the rules go to the rows, or both
    are dealt to parts by key, with each rule in every part."""
    if handed:
        return rows.join(F.broadcast(rules), on)
    dealt = rows.withColumn("__part", F.pmod(F.hash("key"), F.lit(PARTS)))
    # merged: from a small file's size Spark would take the rows, one for each trigram of a text, for a table to hand out
    return dealt.hint("merge").join(rules.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [on, "__part"]).drop("__part")


def keyword_hits(texts: DataFrame, rules: DataFrame, sizes: list[int], strict: bool, handed: bool) -> DataFrame:
    """(key, low) and rules -> key and ``HIT`` of the keywords, in lower case, that a text has; as whole words if ``strict``. ``sizes``: of the grams that they are filed under."""
    words = rules.where(F.col("kind") == KEYWORD).select(*HIT, F.lower("value").alias("word"))
    size_of = F.least(F.lit(GRAM), F.char_length("word"))
    own = F.coalesce(*[F.when(size_of == n, _grams("word", n)) for n in sizes])
    filed = words.select("family_no", "rule_no", F.explode(F.array_distinct(own)).alias("gram"))
    every = F.array_distinct(F.concat(*[_grams("low", n) for n in sizes]))
    seen = texts.where("low IS NOT NULL").select("key", "low", F.explode(every).alias("gram"))
    # counted before any shuffle
    told = seen.join(F.broadcast(filed.select("gram").distinct()), "gram", "left_semi") if handed else seen
    often = told.groupBy("gram").agg(F.count("*").alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
    rarest = filed.join(often, "gram", "left").groupBy("family_no", "rule_no").agg(F.min(rank).alias("r")).where("r.n > 0")
    by_gram = rarest.join(words, ["family_no", "rule_no"]).select(F.col("r.gram").alias("gram"), *HIT, "word")
    there = F.expr(r"low RLIKE concat('\\b\\Q', word, '\\E\\b')") if strict else F.col("low").contains(F.col("word"))
    # what is shuffled doesn't carry a text for each of its trigrams
    maybe = _met(seen, by_gram, "gram", True) if handed else _met(seen.drop("low"), by_gram, "gram", False).hint("merge").join(texts, "key")
    return maybe.where(there).select("key", *HIT)


def id_hits(held: DataFrame, rules: DataFrame, handed: bool) -> DataFrame:
    """(key, ids) and rules -> key and ``HIT`` of the ids that a row has."""
    each = held.select("key", F.explode(F.array_distinct("ids")).alias("value"))
    return _met(each, rules.where(F.col("kind") != KEYWORD).select("value", *HIT), "value", handed).select("key", *HIT)


def matched(rows: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """(key, low, ids) and rules -> key and its hits, (family_no, rule_no, family, evidence) in order; only rows with some. A key is one row."""
    size = F.when(F.col("kind") == KEYWORD, F.least(F.lit(GRAM), F.char_length(F.lower("value"))))
    counts = dict(rules.groupBy(size.alias("size")).agg(F.count("*")).collect())  # five rows at most
    handed = sum(counts.values()) <= HANDED
    rules = rules.withColumn("evidence", F.concat_ws(": ", "family", "kind", "value"))
    hits = id_hits(rows.select("key", "ids"), rules, handed)
    if sizes := sorted(n for n in counts if n is not None):
        hits = hits.unionByName(keyword_hits(rows.select("key", "low"), rules, sizes, strict, handed))
    return hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*HIT))).alias("hits"))
