"""Secret scans over a trigram index, in Spark's own functions alone.

Each rule is a regular expression. From its parse tree a Boolean query of trigrams follows: in a sequence all parts are
needed, in an alternation one of its branches, and what may be absent needs nothing. The documents' trigrams that any
query asks for are the postings (trigram, document). Postings are met with the clauses of the queries; a document with
all trigrams of a clause is a candidate for its rule, and only candidates are verified by the expression. Rules without
a needed trigram scan every text.

Defined cases: a null text is an empty one, without secrets; a null doc_id is kept; repeated rows each give a row with
equal results; an empty table gives none; further columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import common

MOST_CLAUSES = 16  # alternatives of a query; with more, the part needs nothing


@dataclass(frozen=True)
class SecretRule:
    """Matches are leftmost and do not overlap; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}"),  # matches are whole runs, so that of all runs the short ones are left out from the start
)
MORE_RULES = (
    SecretRule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    SecretRule("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    SecretRule("gitlab", r"glpat-[A-Za-z0-9_-]{20}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})"),
    SecretRule("url", r"(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%-]+:[^\s:/@]{3,}@"),
    SecretRule("npm", r"npm_[A-Za-z0-9]{36}"),
    SecretRule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
)
RULES = BASE_RULES + MORE_RULES


def clauses(pattern: str) -> list[frozenset[str]]:
    """The alternatives of a pattern's query, each a set of trigrams in lower case that must all occur; [{}] needs nothing."""

    def sequence(items) -> list[frozenset[str]]:
        needed, run = [frozenset()], [""]  # clauses so far; the literal strings that may have just been read

        def end():
            nonlocal needed, run
            needed, run = both(needed, [grams(s) for s in run]), [""]

        for op, value in items:
            strings = literal(op, value)
            if strings and len(strings) * len(run) <= MOST_CLAUSES:
                run = [a + b for a in run for b in strings]
                continue
            end()
            needed = both(needed, query(op, value))
        end()
        return needed

    def grams(s: str) -> frozenset[str]:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def both(a, b):
        out = {x | y for x in a for y in b}
        kept = [x for x in out if not any(y < x for y in out)]
        return kept if len(kept) <= MOST_CLAUSES else a

    def literal(op, value) -> list[str] | None:
        """Strings of which one is read here, if these are few."""
        if op is _c.LITERAL:
            return [chr(value).lower()]
        if op is _c.IN and len(value) <= 8 and all(k is _c.LITERAL for k, _ in value):
            return sorted({chr(v).lower() for _, v in value})
        if op is _c.SUBPATTERN:
            return joined(value[3])
        if op is _c.BRANCH:
            found = [joined(branch) for branch in value[1]]
            return sorted(set(itertools.chain.from_iterable(found))) if all(found) else None
        return None

    def joined(items) -> list[str] | None:
        out = [""]
        for op, value in items:
            strings = literal(op, value)
            if not strings or len(out) * len(strings) > MOST_CLAUSES:
                return None
            out = [a + b for a in out for b in strings]
        return out

    def query(op, value) -> list[frozenset[str]]:
        if op is _c.SUBPATTERN:
            return sequence(value[3])
        if op is _c.BRANCH:
            found = [c for branch in value[1] for c in sequence(branch)]
            return [frozenset()] if frozenset() in found or len(set(found)) > MOST_CLAUSES else sorted(set(found), key=sorted)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and value[0] > 0:
            return sequence(value[2])
        return [frozenset()]

    found = sequence(_parser.parse(pattern))
    return [frozenset()] if frozenset() in found else found


def verify(text: Column, rule: SecretRule) -> Column:
    """The spans of a rule's matches, in code points: array<struct<start, end>>.

    Each match is read with what lies between it and the one before, so lengths add up to places.
    """
    inner = rule.pattern
    whole = rf"(?s)\G(.*?)({inner})"
    groups = [F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in ((1, 2, 2 + rule.group) if rule.group else (1, 2))]
    parts = F.arrays_zip(*[F.transform(g, F.char_length).alias(n) for g, n in zip(groups, ("gap", "size", "own"), strict=False)])
    own = "own" if rule.group else "size"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("spans"))
    return F.aggregate(
        parts,
        start,
        lambda s, p: F.struct(
            (s["at"] + p["gap"] + p["size"]).alias("at"),
            F.concat(s["spans"], F.array(F.struct((s["at"] + p["gap"]).alias("start"), (s["at"] + p["gap"] + p["size"]).alias("end"), (p[own] >= rule.least).alias("ok")))).alias("spans"),
        ),
        lambda s: F.transform(F.filter(s["spans"], lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))),
    )


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_key, trigram) for those trigrams that a document has, without regard to case."""
    low = docs.select("doc_key", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_key", F.explode(has).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_key, kinds): the rules for which a document has all trigrams of a clause."""
    spark = docs.sparkSession
    asked = [(r.kind, i, sorted(c)) for r in rules for i, c in enumerate(clauses(r.pattern)) if c]
    index = postings(docs, sorted({t for _, _, c in asked for t in c}))
    wanted = spark.createDataFrame([(kind, i, len(c), t) for kind, i, c in asked for t in c], "kind string, clause int, needed int, trigram string")
    met = index.join(F.broadcast(wanted), "trigram")  # one row per trigram of a rule
    full = met.groupBy("doc_key", "kind", "clause").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return full.groupBy("doc_key").agg(F.collect_set("kind").alias("kinds"))


def scan_secrets(docs: DataFrame, *, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans of each row: array<struct<start, rank, kind, end>> by start, then by the rules' order."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return _found(rows.select("*", _key()), rules).select("doc_id", "spans")


def _key() -> Column:
    return F.xxhash64("doc_id", "text").alias("doc_key")


def _found(rows: DataFrame, rules) -> DataFrame:
    """Rows with doc_key and text, and their spans."""
    open_ = {r.kind for r in rules if frozenset() in clauses(r.pattern)}
    held = rows.join(candidates(rows, rules), "doc_key", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    each = []
    for rank, r in enumerate(rules):
        asked = F.col("text").rlike(r.pattern)
        if r.kind not in open_:
            asked = F.array_contains("kinds", r.kind) & asked
        spans = F.when(asked, verify(F.col("text"), r)).otherwise(none)
        each.append(F.transform(spans, _marked(rank, r.kind)))
    return held.withColumn("spans", F.array_sort(F.concat(*each))).drop("kinds", "doc_key")


def _marked(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(said(F.filter("spans", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"), said("spans").alias("spans"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of a secret replaced by its kind in brackets; overlapping spans by the first one's."""
    del sf_dir
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _found(rows.select("*", _key()), RULES)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    redacted = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["parts"]).otherwise(F.concat(s["parts"], F.array(F.substring("text", s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), x["kind"], F.lit("]"))))).alias("parts"),
        ),
        lambda s: F.array_join(F.concat(s["parts"], F.array(F.substring("text", s["at"] + 1, F.char_length("text")))), ""),
    )
    clean = F.when(F.size("spans") > 0, redacted).otherwise(F.col("row")["text"])
    return found.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
