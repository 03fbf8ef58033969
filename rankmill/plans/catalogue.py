"""Each operator on the analytic tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.functions.columns import bands, capped_join, has_any, hits, ladder, letters_sum, present_mean, safe_ratio, starts_with_any, truncated
from rankmill.functions import rules
from rankmill.functions.polymorphic import listed, members, parsed, value
from rankmill.operators import metrics
from rankmill.operators.selection import kth_value, upper_medians
from rankmill.operators.tables import attach, keep_first, lookup, multilabel_counts, null_coverage, ordered_join, priority_lookup, top_k, value_counts
from rankmill.plans import validation
from rankmill.plans.features import classify_families, id_and_name
from rankmill.plans.reports import validation_report
from rankmill.sources.snapshots import still_missing
from rankmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def n(name: str = "n"):
    return F.count("*").alias(name)


# -- scans and nested text ------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) AS n FROM events GROUP BY event_type")
def q_scan_json(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), n())


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def q_json_extract(spark, sf):
    parsed = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", parsed.alias("k")).where("k >= 50")


# a field that is an object, a list of objects, a list, a text in quotes or a bare text
@query("""SELECT event_id, CASE event_id % 5 WHEN 2 THEN event_type || '|x' WHEN 3 THEN event_type WHEN 4 THEN event_type END AS items, CASE WHEN event_id % 5 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
CASE WHEN event_id % 5 < 2 THEN json_extract_string(props, '$.k') || CASE event_id % 5 WHEN 1 THEN '|7' ELSE '' END END AS all_k FROM events""")
def q_polymorphic_fields(spark, sf):
    kind, word = F.col("event_id") % 5, F.col("event_type")
    quoted = F.concat(F.lit('"'), word, F.lit('"'))
    field = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("["), "props", F.lit(', {"k": 7}]'))).when(kind == 2, F.concat(F.lit("["), quoted, F.lit(', "x"]'))).when(kind == 3, quoted).otherwise(word)
    read = parsed(table(spark, sf, "events").select("event_id", field.alias("field")), "field")
    joined = lambda c: F.nullif(F.array_join(c, "|"), F.lit(""))
    told = F.col("event_id") % 5
    return read.select("event_id", F.when(told > 1, joined(listed("field"))).alias("items"), value("field", "$.k", "bigint", first=True).alias("k"), joined(members("field", "k")).alias("all_k"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?]*)', 1) AS first_part, regexp_extract(url, '[?&]([^=]+)=', 1) AS first_key FROM pages")
def q_url_parts(spark, sf):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", part("^[a-z]+://([^/]+)").alias("host"), part("^[a-z]+://[^/]+/([^/?]*)").alias("first_part"), part("[?&]([^=]+)=").alias("first_key"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_sections FROM pages")
def q_regex_sections(spark, sf):
    count = F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), 0)).cast("bigint")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count.alias("n_sections"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS head, CAST(round(n_chars / 1000, 1) AS VARCHAR) AS thousands FROM documents")
def q_text_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncated("text", 50).alias("head"), F.round(F.col("n_chars") / 1000, 1).cast("string").alias("thousands"))


@query("SELECT o_custkey AS custkey, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderdate, o_orderkey) AS first_orders FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 5 GROUP BY o_custkey")
def q_capped_join(spark, sf):
    first = top_k(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 5)
    rows = first.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"))
    return rows.select(F.col("o_custkey").alias("custkey"), capped_join(F.transform("o", lambda x: x["o_orderkey"].cast("string")), 5).alias("first_orders"))


# -- flags, bands, filters -----------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS custkey, coalesce(f, 0) > 0 AS has_final, coalesce(o, 0) > 0 AS has_open, coalesce(p, 0) > 0 AS has_partial,
CASE WHEN coalesce(f, 0) > 0 THEN 'HIGH' WHEN coalesce(o, 0) > 0 THEN 'MEDIUM' WHEN coalesce(p, 0) > 0 THEN 'LOW' ELSE 'NONE' END AS evidence
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def q_evidence_flags(spark, sf):
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])
    out = attach(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), by, "custkey", dict.fromkeys("FOP", 0))
    label = ladder((F.col("F") > 0, "HIGH"), (F.col("O") > 0, "MEDIUM"), (F.col("P") > 0, "LOW"), default="NONE")
    return out.select("custkey", (F.col("F") > 0).alias("has_final"), (F.col("O") > 0).alias("has_open"), (F.col("P") > 0).alias("has_partial"), label.alias("evidence"))


@query("SELECT p_partkey, starts_with(p_name, 'red') OR starts_with(p_name, 'blue') OR starts_with(p_name, 'small') AS flagged FROM part")
def q_prefix_flag(spark, sf):
    return table(spark, sf, "part").select("p_partkey", starts_with_any("p_name", ("red", "blue", "small")).alias("flagged"))


@query("SELECT CASE WHEN l_quantity >= 45 THEN 'very high' WHEN l_quantity >= 25 THEN 'high' WHEN l_quantity >= 10 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(l_extendedprice), 2) AS mean_price FROM lineitem GROUP BY 1")
def q_banded_counts(spark, sf):
    band = bands("l_quantity", (45, "very high"), (25, "high"), (10, "medium"), default="low")
    return table(spark, sf, "lineitem").groupBy(band.alias("band")).agg(n(), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"))


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def q_reference_semi(spark, sf):
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority").startswith("1"))
    c = table(spark, sf, "customer")
    return c.join(urgent, c["c_custkey"] == urgent["o_custkey"], "left_semi").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))


@query("SELECT c_custkey AS custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus <> 'F') AS g FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE f IS NULL AND g IS NULL")
def q_all_null_keys(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("c_custkey").alias("custkey"))


# -- joins and lookups ---------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS custkey, coalesce(n, 0) AS n_orders, round(coalesce(t, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q_left_attach(spark, sf):
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(n("n_orders"), F.sum("o_totalprice").alias("total"))
    out = attach(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), by, "custkey", {"n_orders": 0, "total": 0.0})
    return out.withColumn("total", F.round("total", 2))


@query("SELECT r_name AS region, n_name AS nation, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q_chained_lookup(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(n("n"), F.sum("l_quantity").alias("q"))
    s, na, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    out = lines.join(s, lines["l_suppkey"] == s["s_suppkey"]).join(na, F.col("s_nationkey") == na["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return out.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("n").alias("n_lines"), F.round(F.sum("q"), 2).alias("quantity"))


# a third of the orders and a fifth of the customers have no key; those of the customers are one row
@query("""SELECT o_orderkey AS orderkey, k AS custkey, coalesce(n, 0) AS n, coalesce(balance, 0.0) AS balance FROM
(SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k FROM orders) LEFT JOIN
(SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS c, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1) ON k IS NOT DISTINCT FROM c""")
def q_null_attach(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("custkey"))
    by = table(spark, sf, "customer").groupBy(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("custkey")).agg(n(), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return attach(orders, by, "custkey", {"n": 0, "balance": 0.0}, unique=True)


# several rows without a key on the right: each meets each of the left
@query("""SELECT e AS event_id, u AS user_id, name, region FROM (SELECT event_id AS e, CASE WHEN user_id % 3 <> 0 THEN user_id END AS u FROM events) LEFT JOIN
(SELECT CASE WHEN n_nationkey < 22 THEN n_nationkey END AS k, n_name AS name, n_regionkey AS region FROM nation) ON u IS NOT DISTINCT FROM k""")
def q_null_attach_many(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id"))
    nations = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") < 22, F.col("n_nationkey")).cast("long").alias("user_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return attach(events, nations, "user_id")


@query("""SELECT o_orderkey AS orderkey, k AS custkey, c_name AS name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k FROM orders) LEFT JOIN customer ON k = c_custkey""")
def q_lookup(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("custkey"))
    return lookup(orders, table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name")), "custkey")


_CHEAPEST = "SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice / l_quantity, l_suppkey) AS r FROM lineitem"


@query(f"WITH a AS ({_CHEAPEST} WHERE l_returnflag = 'R'), b AS ({_CHEAPEST}) SELECT p_partkey AS partkey, coalesce(a.l_suppkey, b.l_suppkey) AS suppkey FROM part LEFT JOIN a ON a.l_partkey = p_partkey AND a.r = 1 LEFT JOIN b ON b.l_partkey = p_partkey AND b.r = 1")
def q_priority_lookup(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), "l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    cheapest = lambda rows: keep_first(rows, ["partkey"], [F.col("unit"), F.col("suppkey")])
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"))
    return priority_lookup(parts, "partkey", [cheapest(lines.where("l_returnflag = 'R'")), cheapest(lines)], "suppkey")


@query("SELECT d.doc_id, CAST(CASE WHEN quality IS NOT NULL THEN quality WHEN n_chars >= 2000 THEN 1 ELSE 0 END AS BIGINT) AS quality, CASE WHEN quality IS NOT NULL THEN 'label' WHEN n_chars >= 2000 THEN 'length' ELSE 'default' END AS method FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_fallback_chain(spark, sf):
    given = F.when(F.col("quality").isNotNull(), F.struct(F.col("quality").cast("bigint").alias("v"), F.lit("label").alias("m")))
    long = F.when(F.col("n_chars") >= 2000, F.struct(F.lit(1).cast("bigint").alias("v"), F.lit("length").alias("m")))
    none = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit("default").alias("m"))
    joined = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.withColumn("f", F.coalesce(given, long, none)).select("doc_id", F.col("f.v").alias("quality"), F.col("f.m").alias("method"))


FAMILIES = {"articles": ("the ", "der ", "las "), "verbs": ("was", "ist", "est"), "joins": ("and ", "und ", " et "), "places": ("in ", "dans", "from")}


def _families_sql() -> str:
    count = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)
    total = " + ".join(count(w) for w in FAMILIES.values())
    found = ", ".join(f"CASE WHEN {count(w)} > 0 THEN '{k}' END" for k, w in FAMILIES.items())
    return f"SELECT doc_id, CAST({total} AS BIGINT) AS n_hits, concat_ws('|', {found}) AS families, CASE WHEN {total} >= 6 THEN 'HIGH' WHEN {total} >= 3 THEN 'MEDIUM' WHEN {total} >= 1 THEN 'LOW' ELSE 'NONE' END AS confidence FROM documents"


@query(_families_sql())
def q_keyword_theta_join(spark, sf):
    low = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    each = low.select("doc_id", *[hits("low", words).alias(k) for k, words in FAMILIES.items()])
    total = sum((F.col(k) for k in FAMILIES), F.lit(0))
    found = F.concat_ws("|", *[F.when(F.col(k) > 0, F.lit(k)) for k in FAMILIES])
    return each.select("doc_id", total.cast("bigint").alias("n_hits"), found.alias("families"), bands(total, (6, "HIGH"), (3, "MEDIUM"), (1, "LOW"), default="NONE").alias("confidence"))


#: The 35 families as rows, and the words and ids that the parts of the query below are told to have.
_RULES = [(no, i, name, *x) for no, (name, rule) in enumerate(rules.FAMILIES.items()) for i, x in enumerate([("Keyword", k) for k in rule["keywords"]] + [("Pfam" if d.startswith("PF") else "InterPro", d) for d in rule["ids"]])]
_WORDS, _IDS = [r[4] for r in _RULES if r[3] == "Keyword"], [r[4] for r in _RULES if r[3] != "Keyword"]
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_listed = lambda xs: "[" + ", ".join(map(_quoted, xs)) + "]"


@query(f"""WITH rules(family_no, rule_no, family, kind, value) AS (VALUES {", ".join(f"({a}, {b}, {_quoted(f)}, {_quoted(k)}, {_quoted(v)})" for a, b, f, k, v in _RULES)}), told AS (
SELECT p_partkey AS partkey, lower('Probable ' || upper({_listed(_WORDS)}[1 + p_partkey * 7 % {len(_WORDS)}]) || '-like ' || p_name || ' and ' || {_listed(_WORDS)}[1 + p_partkey * p_size % {len(_WORDS)}]) AS low,
CASE WHEN p_partkey % 3 = 0 THEN [{_listed(_IDS)}[1 + p_partkey * 5 % {len(_IDS)}], {_listed(_IDS)}[1 + p_partkey * p_size % {len(_IDS)}]] ELSE [] END AS ids FROM part), hits AS (
SELECT partkey, family_no, rule_no, family, family || ': ' || kind || ': ' || value AS evidence FROM told, rules WHERE CASE kind WHEN 'Keyword' THEN contains(low, value) ELSE list_contains(ids, value) END), names AS (
SELECT partkey, string_agg(family, '|' ORDER BY family_no) AS families FROM (SELECT DISTINCT partkey, family_no, family FROM hits) GROUP BY partkey), told_all AS (
SELECT partkey, count(*) AS n, list(evidence ORDER BY family_no, rule_no) AS e FROM hits GROUP BY partkey)
SELECT partkey, n IS NOT NULL AS found, coalesce(families, '') AS families, CASE WHEN n >= 3 THEN 'HIGH' WHEN n = 2 THEN 'MEDIUM' WHEN n = 1 THEN 'LOW' ELSE 'NONE' END AS confidence, coalesce(array_to_string(e[:10], '|'), '') AS evidence
FROM told LEFT JOIN names USING (partkey) LEFT JOIN told_all USING (partkey)""")
def q_family_rules(spark, sf):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("Probable "), F.upper(pick(_WORDS, key * 7)), F.lit("-like "), "p_name", F.lit(" and "), pick(_WORDS, key * size))
    ids = F.when(key % 3 == 0, F.array(pick(_IDS, key * 5), pick(_IDS, key * size))).otherwise(F.array().cast("array<string>"))
    told = table(spark, sf, "part").select(key.alias("partkey"), text.alias("text"), ids.alias("ids"))
    found = classify_families(told, F.col("text"), F.col("ids"), key="partkey")
    return found.select("partkey", F.col("is_druggable_family").alias("found"), F.col("druggable_family_type").alias("families"), F.col("druggable_family_confidence").alias("confidence"), F.col("druggable_family_evidence").alias("evidence"))


@query("""SELECT p_partkey AS partkey, coalesce(d, 0) AS degree, coalesce(t, 0) AS target_degree, coalesce(d, 0) >= 15 AS hub FROM part LEFT JOIN
(SELECT l_partkey, count(DISTINCT l_suppkey) AS d, count(DISTINCT CASE WHEN s_acctbal > 7000 THEN l_suppkey END) AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) ON l_partkey = p_partkey""")
def q_network_targets(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_suppkey").distinct()
    s = table(spark, sf, "supplier")
    by = edges.join(s, edges["l_suppkey"] == s["s_suppkey"]).groupBy("partkey").agg(n("degree"), F.count_if(F.col("s_acctbal") > 7000).alias("target_degree"))
    out = attach(table(spark, sf, "part").select(F.col("p_partkey").alias("partkey")), by, "partkey", {"degree": 0, "target_degree": 0})
    return out.withColumn("hub", F.col("degree") >= 15)


# -- aggregates ----------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS partkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS n_r, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS n_a, count(DISTINCT CASE WHEN l_returnflag NOT IN ('R', 'A') THEN l_orderkey END) AS n_other FROM lineitem GROUP BY 1")
def q_phase_counts(spark, sf):
    # distinct (part, order) pairs once, instead of three distinct counts that would each expand the rows
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    r, a = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    pairs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("partkey"), "l_orderkey").agg(flag(r).alias("r"), flag(a).alias("a"), flag(~r & ~a).alias("o"))
    return pairs.groupBy("partkey").agg(*[F.sum(F.col(c).cast("bigint")).alias(name) for c, name in (("r", "n_r"), ("a", "n_a"), ("o", "n_other"))])


@query("SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, count(*) AS n FROM orders GROUP BY 1")
def q_phase_pivot(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"], n())


@query("SELECT user_id, list_sort(list(value))[CAST(count(*) // 2 + 1 AS INT)] AS upper_median FROM events WHERE value > 0 GROUP BY user_id")
def q_upper_median(spark, sf):
    return upper_medians(table(spark, sf, "events").where("value > 0"), ["user_id"], "value")


# one key has all rows
@query("SELECT list_sort(list(l_extendedprice))[CAST(count(*) // 2 + 1 AS INT)] AS median_price, list_sort(list(l_extendedprice))[CAST(count(*) * 9 // 10 + 1 AS INT)] AS ninth_price FROM lineitem")
def q_kth_values(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.lit(1).alias("all_rows"), "l_extendedprice")
    half = upper_medians(lines, ["all_rows"], "l_extendedprice", "median_price")
    ninth = kth_value(lines, ["all_rows"], "l_extendedprice", F.floor(F.col("n") * 9 / 10), "ninth_price")
    return half.join(ninth, "all_rows").drop("all_rows")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 0) AS n_expressed, count(*) FILTER (WHERE value >= 100) AS n_high, count(*) FILTER (WHERE value >= 10) AS n_medium, count(*) FILTER (WHERE value >= 1) AS n_low,
max(value) AS max_value, round(avg(value) FILTER (WHERE value > 0), 4) AS mean_value,
CASE WHEN count(*) FILTER (WHERE value > 0.1) <= 5 THEN 'Highly specific' WHEN count(*) FILTER (WHERE value > 0.1) <= 15 THEN 'Moderately specific' WHEN count(*) FILTER (WHERE value > 0.1) <= 30 THEN 'Broad' ELSE 'Ubiquitous' END AS specificity FROM events GROUP BY user_id""")
def q_expression_profile(spark, sf):
    v = F.col("value")
    at = lambda t: F.count_if(v >= t)
    out = table(spark, sf, "events").groupBy("user_id").agg(
        n(), F.count_if(v > 0).alias("n_expressed"), at(100).alias("n_high"), at(10).alias("n_medium"), at(1).alias("n_low"), F.max(v).alias("max_value"), F.round(F.avg(F.when(v > 0, v)), 4).alias("mean_value"), F.count_if(v > 0.1).alias("seen")
    )
    some = F.col("seen")
    return out.withColumn("specificity", ladder((some <= 5, "Highly specific"), (some <= 15, "Moderately specific"), (some <= 30, "Broad"), default="Ubiquitous")).drop("seen")


@query("SELECT user_id, CASE WHEN contains(event_type, 'click') OR contains(event_type, 'view') THEN 'browse' WHEN contains(event_type, 'purchase') THEN 'buy' WHEN contains(event_type, 'sign') THEN 'join' ELSE 'other' END AS category, max(value) AS max_value FROM events GROUP BY 1, 2")
def q_category_max(spark, sf):
    kind = ladder((has_any("event_type", ("click", "view")), "browse"), (has_any("event_type", ("purchase",)), "buy"), (has_any("event_type", ("sign",)), "join"), default="other")
    return table(spark, sf, "events").groupBy("user_id", kind.alias("category")).agg(F.max("value").alias("max_value"))


@query("SELECT p_type, round(avg(p_retailprice), 4) AS mean_price, round(median(p_retailprice), 4) AS median_price, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM part GROUP BY p_type")
def q_score_stats(spark, sf):
    p = "p_retailprice"
    return table(spark, sf, "part").groupBy("p_type").agg(F.round(F.avg(p), 4).alias("mean_price"), F.round(F.median(p), 4).alias("median_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def q_value_counts(spark, sf):
    return value_counts(table(spark, sf, "part"), "p_type")


@query("SELECT label, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part) GROUP BY 1")
def q_multilabel_counts(spark, sf):
    return multilabel_counts(table(spark, sf, "part"), F.split("p_name", " "))


@query("SELECT CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'classic' WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'sized' ELSE 'other' END AS supercategory, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_size FROM part GROUP BY 1")
def q_supercategory(spark, sf):
    kind = ladder((F.col("p_type").isin("ECONOMY", "STANDARD"), "classic"), (F.col("p_type").isin("LARGE", "MEDIUM", "SMALL"), "sized"), default="other")
    return table(spark, sf, "part").groupBy(kind.alias("supercategory")).agg(n(), F.sum("p_size").alias("total_size"))


_COVER = "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(f"WITH j AS ({_COVER}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_present, round(100.0 * count({c}) / count(*), 2) AS pct_present FROM j" for c in ("lang", "quality", "toxic")))
def q_null_coverage(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return null_coverage(joined, ["lang", "quality", "toxic"])


@query("""SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT), 0), 6) AS score FROM
(SELECT *, CASE WHEN l_discount <> 0 THEN CASE WHEN l_discount >= 0.08 THEN 1.0 WHEN l_discount >= 0.04 THEN 0.7 ELSE 0.3 END END AS a, CASE WHEN l_tax <> 0 THEN CASE WHEN l_tax >= 0.06 THEN 1.0 WHEN l_tax >= 0.03 THEN 0.6 ELSE 0.3 END END AS b, CASE WHEN l_quantity > 40 THEN 0.8 WHEN l_quantity > 20 THEN 0.5 END AS c FROM lineitem)""")
def q_component_mean(spark, sf):
    a = F.when(F.col("l_discount") != 0, bands("l_discount", (0.08, 1.0), (0.04, 0.7), default=0.3))
    b = F.when(F.col("l_tax") != 0, bands("l_tax", (0.06, 1.0), (0.03, 0.6), default=0.3))
    c = ladder((F.col("l_quantity") > 40, 0.8), (F.col("l_quantity") > 20, 0.5)).cast("double")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.round(present_mean([a, b, c]), 6).alias("score"))


@query("SELECT c_custkey AS custkey, CASE WHEN coalesce(n, 0) > 0 THEN round(l / n, 2) ELSE 0.0 END AS lines_per_order FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(l_linenumber) AS l FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) ON c_custkey = o_custkey")
def q_safe_ratio(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n("l"))
    by = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey")).join(lines, "o_orderkey", "left").groupBy("custkey").agg(n("n"), F.sum(F.coalesce("l", F.lit(0))).alias("l"))
    out = attach(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), by, "custkey", {"n": 0, "l": 0})
    return out.select("custkey", safe_ratio("l", "n").alias("lines_per_order"))


# -- ranking -------------------------------------------------------------------------------------------------------

_TOP = "SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem"


def _top_lines(spark, sf, k):
    return top_k(table(spark, sf, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], k)


@query(f"SELECT l_partkey AS partkey, l_orderkey AS orderkey, l_linenumber AS linenumber, l_extendedprice AS price, CAST(r AS BIGINT) AS rank FROM ({_TOP}) WHERE r <= 5")
def q_topk_per_group(spark, sf):
    return _top_lines(spark, sf, 5).select(F.col("l_partkey").alias("partkey"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_extendedprice").alias("price"), F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT l_partkey AS partkey, string_agg(CAST(l_orderkey AS VARCHAR) || ':' || CAST(CAST(l_quantity AS INT) AS VARCHAR), '; ' ORDER BY r) AS top_lines FROM ({_TOP}) WHERE r <= 5 GROUP BY 1")
def q_topk_formatted(spark, sf):
    text = F.concat_ws(":", "l_orderkey", F.col("l_quantity").cast("int"))
    return ordered_join(_top_lines(spark, sf, 5).withColumnRenamed("l_partkey", "partkey"), ["partkey"], ["rank"], text, "; ", "top_lines")


@query("SELECT p_partkey AS partkey, coalesce(s, -1) AS best_supplier FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_suppkey, l_extendedprice * 1000000 - l_suppkey) AS s FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def q_argmax_default(spark, sf):
    best = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(F.max_by("l_suppkey", F.col("l_extendedprice") * 1000000 - F.col("l_suppkey")).alias("best_supplier"))
    return attach(table(spark, sf, "part").select(F.col("p_partkey").alias("partkey")), best, "partkey", {"best_supplier": -1})


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, event_id) AS r FROM events) WHERE r = 1")
def q_argmax_ties(spark, sf):
    return keep_first(table(spark, sf, "events"), ["user_id"], [F.desc(F.coalesce("value", F.lit(0.0))), F.col("event_id")]).select("user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_topn(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def q_dedup_keep_first(spark, sf):
    return keep_first(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def q_distinct_keys(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])


@query("""WITH w AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS e FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_intersect(e, ['click', 'purchase', 'view'])), '|') AS shared, CAST(len(e) AS BIGINT) AS n_types, len(list_intersect(e, ['error', 'signup'])) > 0 AS overlaps FROM w""")
def q_array_overlap(spark, sf):
    kinds = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("e"))
    these = lambda *x: F.array(*map(F.lit, x))
    return kinds.select("user_id", F.array_join(F.array_sort(F.array_intersect("e", these("click", "purchase", "view"))), "|").alias("shared"), F.size("e").cast("bigint").alias("n_types"), F.arrays_overlap("e", these("error", "signup")).alias("overlaps"))


# -- ladders -------------------------------------------------------------------------------------------------------

_PLACES = (("outside", ("http", "www.")), ("boundary", ("password", "token")), ("wall", ("license", "copyright")), ("inside", ("und ", "der ")), ("core", (" les ", " des ")), ("organ", (" los ", " las ")))


def _places_sql(value: Callable[[int, str], str], default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN {value(i, k)}" for i, (k, words) in enumerate(_PLACES)) + f" ELSE {default} END"


@query(f"SELECT doc_id, {_places_sql(lambda i, k: repr(k), repr('unknown'))} AS category, {_places_sql(lambda i, k: str(6 - i), '0')} AS score FROM documents")
def q_accessibility_ladder(spark, sf):
    low = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", ladder(*[(has_any("low", w), k) for k, w in _PLACES], default="unknown").alias("category"), ladder(*[(has_any("low", w), 6 - i) for i, (_, w) in enumerate(_PLACES)], default=0).alias("score"))


_WEIGHTS = {"a": 0.25, "e": 0.5, "r": 0.125, "s": 0.375, "p": 1.0, "q": 0.75, "k": 0.5, "w": -0.5, "c": -0.25, "f": -0.375, "i": -0.5, "y": -0.25}
_SUM = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) * {w}" for c, w in _WEIGHTS.items())


@query(f"SELECT doc_id, CAST(CASE WHEN s > 0.08 THEN least(70 + (s - 0.08) * 100, 90) WHEN s > 0 THEN 30 + s * 133 ELSE greatest(5, 30 + s * 60) END AS BIGINT) AS percent FROM (SELECT doc_id, round(({_SUM}) / greatest(length(text), 1), 3) AS s FROM documents)".replace("CAST(CASE", "CAST(floor(CASE").replace("END AS BIGINT", "END) AS BIGINT"))
def q_composition_score(spark, sf):
    s = F.col("s")
    scored = table(spark, sf, "documents").select("doc_id", F.round(letters_sum("text", _WEIGHTS) / F.greatest(F.char_length("text"), F.lit(1)), 3).alias("s"))
    percent = ladder((s > 0.08, F.least(70 + (s - 0.08) * 100, F.lit(90.0))), (s > 0, 30 + s * 133), default=F.greatest(F.lit(5.0), 30 + s * 60))
    return scored.select("doc_id", F.floor(percent).alias("percent"))


# -- labels and metrics ---------------------------------------------------------------------------------------------

_TRUTH = """SELECT c_custkey AS custkey, CASE WHEN coalesce(f, 0) >= 8 THEN 100 WHEN coalesce(f, 0) >= 5 THEN 90 WHEN coalesce(f, 0) >= 3 THEN 80 WHEN coalesce(f, 0) >= 1 AND coalesce(o, 0) >= 1 THEN 70 WHEN coalesce(f, 0) >= 1 THEN 60 WHEN coalesce(o, 0) >= 3 THEN 50 WHEN coalesce(o, 0) >= 1 THEN 40 WHEN coalesce(p, 0) >= 1 THEN 30 ELSE 20 END AS truth
FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey"""


@query(f"SELECT custkey, truth, CAST(truth >= 70 AS INT) AS positive FROM ({_TRUTH})")
def q_ground_truth_labels(spark, sf):
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])
    out = attach(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), by, "custkey", dict.fromkeys("FOP", 0))
    f, o, p = (F.col(s) for s in "FOP")
    truth = ladder((f >= 8, 100), (f >= 5, 90), (f >= 3, 80), ((f >= 1) & (o >= 1), 70), (f >= 1, 60), (o >= 3, 50), (o >= 1, 40), (p >= 1, 30), default=20)
    return out.select("custkey", truth.alias("truth")).withColumn("positive", (F.col("truth") >= 70).cast("int"))


_JUDGED = "SELECT l.quality AS y, d.n_chars, CASE WHEN d.n_chars >= 1000 OR d.lang = 'en' THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _judged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    joined = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id")
    return joined.select("y", "n_chars", ((F.col("n_chars") >= 1000) | (F.col("lang") == "en")).cast("int").alias("p"))


@query(f"""WITH j AS ({_JUDGED}), c AS (SELECT count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp FROM j)
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def q_confusion_prf(spark, sf):
    out = metrics.confusion(_judged(spark, sf), F.col("p"), F.col("y"))
    return out.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH j AS ({_JUDGED}), r AS (SELECT y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM j), s AS (SELECT sum(r) FILTER (WHERE y = 1) AS r, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM r) SELECT n_pos, n_neg, round((r - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc FROM s")
def q_auc(spark, sf):
    return metrics.auc(_judged(spark, sf), "n_chars", "y").withColumn("auc", F.round("auc", 6))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def q_pearson(spark, sf):
    return table(spark, sf, "lineitem").agg(n(), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def q_spearman(spark, sf):
    return metrics.spearman(table(spark, sf, "part"), "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6))


_POINTS = """SELECT user_id, CASE WHEN p >= 10 THEN 3 WHEN p >= 5 THEN 2 WHEN p >= 1 THEN 1 ELSE 0 END + CASE WHEN s > 0 THEN 3 ELSE 0 END + CASE WHEN c >= 3 THEN 2 WHEN c >= 1 THEN 1 ELSE 0 END + CASE WHEN e > 0 THEN 2 ELSE 0 END AS points, p, s FROM
(SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)"""


def _points(spark, sf):
    kinds = {"p": "purchase", "s": "signup", "c": "click", "e": "error"}
    by = table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])
    points = bands("p", (10, 3), (5, 2), (1, 1), default=0) + bands("s", (1, 3), default=0) + bands("c", (3, 2), (1, 1), default=0) + bands("e", (1, 2), default=0)
    return by.withColumn("points", points)


@query(f"SELECT user_id, points, CASE WHEN points >= 8 THEN 'Very High' WHEN points >= 6 THEN 'High' WHEN points >= 4 THEN 'Medium' WHEN points >= 2 THEN 'Low' ELSE 'Very Low' END AS level FROM ({_POINTS})")
def q_validation_score(spark, sf):
    return _points(spark, sf).select("user_id", "points", bands("points", (8, "Very High"), (6, "High"), (4, "Medium"), (2, "Low"), default="Very Low").alias("level"))


@query(f"SELECT user_id, CASE WHEN points >= 7 AND p >= 5 THEN 'Strong agreement' WHEN points >= 7 THEN 'Score only' WHEN p >= 5 THEN 'Evidence only' WHEN points >= 3 OR s > 0 THEN 'Moderate' ELSE 'Weak' END AS final FROM ({_POINTS})")
def q_final_prediction(spark, sf):
    p, s, points = F.col("p"), F.col("s"), F.col("points")
    final = ladder(((points >= 7) & (p >= 5), "Strong agreement"), (points >= 7, "Score only"), (p >= 5, "Evidence only"), ((points >= 3) | (s > 0), "Moderate"), default="Weak")
    return _points(spark, sf).select("user_id", final.alias("final"))


_CANDIDATES = """SELECT p_partkey, CAST(p_size AS DOUBLE) * 2 AS score, p_partkey % 13 AS papers, p_partkey % 4 AS trials, p_partkey % 3 = 0 AS tools,
    p_partkey % 5 = 0 AS pocket, CASE p_partkey % 7 WHEN 0 THEN 'Tclin' WHEN 1 THEN 'Tchem' ELSE 'Tbio' END AS tdl FROM part"""


@query(f"""SELECT p_partkey, score,
    CASE WHEN score >= 80 THEN 'Highly Druggable' WHEN score >= 50 THEN 'Moderately Druggable' ELSE 'Challenging Target' END AS own,
    CASE WHEN papers >= 10 AND trials > 0 THEN 'Strong Clinical Evidence' WHEN papers >= 5 OR trials > 0 THEN 'Moderate Clinical Evidence'
        WHEN papers > 0 THEN 'Preliminary Evidence' ELSE 'No Direct Evidence' END AS known,
    CASE WHEN score >= 80 AND (papers >= 5 OR trials > 0) THEN 'Very High' WHEN score >= 80 THEN 'High' WHEN score >= 50 AND papers >= 10 THEN 'Medium-High'
        WHEN score >= 50 THEN 'Medium' ELSE 'Low' END AS sure,
    CASE WHEN score >= 80 AND (papers >= 5 OR trials > 0) THEN 'PROCEED: Initiate drug discovery program'
        WHEN score >= 80 THEN 'VALIDATE: Confirm disease association before proceeding' WHEN score >= 50 AND papers >= 10 THEN 'CONSIDER: Address druggability challenges'
        WHEN score >= 50 THEN 'EXPLORE: Fragment-based or alternative approaches' ELSE 'CAUTION: Consider biologics or indirect targeting' END AS advice,
    coalesce(nullif(concat_ws('; ', CASE WHEN pocket THEN 'Druggable binding pocket' END,
        CASE tdl WHEN 'Tclin' THEN 'Clinical target (Tclin)' WHEN 'Tchem' THEN 'Chemical target (Tchem)' END), ''), 'Limited evidence') AS why,
    coalesce(nullif(concat_ws('; ', CASE WHEN papers > 0 THEN papers || ' publications' END, CASE WHEN trials > 0 THEN trials || ' clinical trial(s)' END,
        CASE WHEN tools THEN 'Chemical tools available' END), ''), 'No literature evidence found') AS found FROM ({_CANDIDATES})""")
def q_target_recommendation(spark, sf):
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        key.alias("gene_symbol"),
        (F.col("p_size").cast("double") * 2).alias("Step11_Composite_Score"),
        (key % 13).alias("Step12_Literature_Publications"),
        (key % 4).alias("Step12_Total_Clinical_Trials"),
        (key % 3 == 0).alias("Step12_Has_Tool_Compounds"),
        (key % 5 == 0).alias("has_druggable_pocket"),
        ladder((key % 7 == 0, "Tclin"), (key % 7 == 1, "Tchem"), default="Tbio").alias("Step9_Target_Development_Level"),
    )
    names = {"Gene": "p_partkey", "Pipeline_Druggability_Score": "score", "Pipeline_Prediction": "own", "Literature_Prediction": "known", "Final_Confidence": "sure", "Recommendation": "advice", "Pipeline_Reasoning": "why", "Literature_Reasoning": "found"}
    return validation.predictions(rows).select(*[F.col(c).alias(name) for c, name in names.items()])


@query("""WITH s AS (SELECT user_id, upper(event_type) AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, count(*) AS trials, CAST(count(*) FILTER (k <= 5 AND (status LIKE '%CLICK%' OR status LIKE '%SIGNUP%')) AS BIGINT) AS active,
    CAST(count(*) FILTER (k <= 5 AND status LIKE '%SIGNUP%') AS BIGINT) AS recruiting FROM s GROUP BY user_id""")
def q_trial_evidence(spark, sf):
    # a user's events stand for trials: clicks for active ones, signups for recruiting ones, which are active too
    status = ladder((F.col("event_type") == "click", "ACTIVE_NOT_STARTED"), (F.col("event_type") == "signup", "Recruiting, active"), default="COMPLETED")
    events = table(spark, sf, "events").select(F.col("user_id").alias("gene"), "ts", "event_id", status.alias("overallStatus"))
    # only the first five of a user are gathered
    first = top_k(events, ["gene"], [F.col("ts"), F.col("event_id")], 5).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("rank", "overallStatus"))).alias("e"))
    studies = first.select("gene", F.transform("e", lambda e: F.struct(e["overallStatus"].alias("overallStatus"))).alias("studies"))
    trials = studies.join(events.groupBy("gene").agg(F.count("*").cast("int").alias("total")), "gene")
    papers = spark.createDataFrame([], "gene bigint, count int, papers array<struct<pmid:string,title:string,pubdate:string>>")
    found = validation.evidence(papers, trials)
    counts = {"Total_Clinical": "trials", "Active": "active", "Recruiting": "recruiting"}
    return found.select(F.col("gene_symbol").alias("user_id"), *[F.col(f"Step12_{c}_Trials").cast("bigint").alias(name) for c, name in counts.items()])


@query(f"""SELECT user_id, CAST(i AS BIGINT) AS line, text FROM (SELECT user_id, unnest(generate_series(1, len(t))) AS i, unnest(t) AS text FROM (SELECT user_id, list_filter([CASE WHEN points >= 6 THEN 'priority user ' || user_id END, CASE WHEN p >= 5 THEN 'review purchases' END, CASE WHEN s > 0 THEN 'confirm signup' END, 'report'], lambda x: x IS NOT NULL) AS t FROM ({_POINTS}) WHERE points >= 6))""")
def q_protocol_lines(spark, sf):
    high = _points(spark, sf).where("points >= 6")
    parts = F.array_compact(F.array(F.concat(F.lit("priority user "), F.col("user_id").cast("string")), F.when(F.col("p") >= 5, F.lit("review purchases")), F.when(F.col("s") > 0, F.lit("confirm signup")), F.lit("report")))
    return high.select("user_id", F.posexplode(parts).alias("i", "text")).select("user_id", (F.col("i") + 1).cast("bigint").alias("line"), "text")


# -- the flagship ----------------------------------------------------------------------------------------------------


_FLAGSHIP = """WITH f AS (SELECT p_partkey AS partkey, p_type, p_size, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS nr, count(*) FILTER (WHERE l_returnflag = 'A') AS na, count(l_orderkey) AS n, max(l_discount) AS md, max(l_extendedprice) AS mp, max(l_quantity) AS mq, count(DISTINCT l_suppkey) AS ns, count(DISTINCT CASE WHEN s_acctbal > 7000 THEN l_suppkey END) AS nt, count(*) FILTER (WHERE l_returnflag = 'R') AS lr
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3), g AS (SELECT *, p_type = 'PROMO' AND p_size <= 10 AS bo, CASE WHEN n > 0 THEN 100.0 * lr / n END AS pr FROM f), c AS (SELECT partkey, bo, p_type, nr,
CASE WHEN bo THEN 0 WHEN nr >= 10 THEN 10 WHEN nr >= 8 THEN 9 WHEN nr >= 6 THEN 8 WHEN nr >= 1 THEN 7 WHEN na > 0 THEN 4 ELSE 0 END AS known,
CASE WHEN bo THEN 0 WHEN p_type = 'ECONOMY' THEN 10 WHEN p_type = 'STANDARD' THEN 9 WHEN p_type = 'LARGE' THEN 8 WHEN p_type = 'MEDIUM' AND p_size >= 25 THEN 7 WHEN p_type = 'MEDIUM' THEN 5 WHEN p_size >= 25 THEN 2 ELSE 0 END AS family,
CASE WHEN bo THEN 0 WHEN md >= 0.10 AND mp >= 70000 THEN 10 WHEN md >= 0.10 AND mp >= 60000 THEN 8 WHEN md >= 0.09 AND mp >= 50000 THEN 6 WHEN md IS NOT NULL THEN 1 ELSE 0 END AS pocket,
CASE WHEN p_size >= 40 THEN 10 WHEN p_size >= 25 THEN 7 WHEN p_size >= 10 THEN 3 ELSE 0 END AS level,
CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 10 WHEN p_type = 'STANDARD' THEN 7 WHEN p_type = 'LARGE' THEN 4 ELSE 1 END AS access,
CASE WHEN pr IS NULL THEN 0 WHEN pr < 10 THEN 10 WHEN pr < 20 THEN 8 WHEN pr < 30 THEN 6 WHEN pr < 40 THEN 4 WHEN pr < 50 THEN 2 ELSE 0 END AS ord,
CASE WHEN n >= 30 AND mq >= 45 THEN 10 WHEN n >= 25 THEN 7 WHEN n >= 20 THEN 5 WHEN n >= 10 THEN 3 ELSE 0 END AS breadth,
CASE WHEN nt >= 10 OR (ns >= 25 AND nt >= 8) THEN 10 WHEN nt >= 6 THEN 7 WHEN nt >= 3 THEN 4 WHEN nt >= 1 THEN 2 ELSE 0 END AS network FROM g),
s AS (SELECT *, round(least((10.0 * known + 6 * family + 5 * pocket + 2 * level + 2 * access + 2 * ord + breadth + network) / 290 * 100, CASE WHEN known = 0 AND family = 0 AND pocket = 0 THEN 30.0 ELSE 100.0 END, CASE WHEN bo THEN 20.0 ELSE 100.0 END), 2) AS track_a,
round((8.0 * CASE WHEN nr >= 12 THEN 10 WHEN nr >= 10 THEN 8 ELSE 0 END + 6 * CASE WHEN p_type = 'PROMO' THEN 10 WHEN p_type = 'LARGE' THEN 9 ELSE 1 END + 3 * level + 2 * breadth + network) / 200 * 100, 2) AS track_b FROM c)
SELECT partkey, known, family, pocket, level, access, ord, breadth, network, CAST(track_a AS DOUBLE) AS track_a, CAST(track_b AS DOUBLE) AS track_b, CAST(greatest(track_a, track_b) AS DOUBLE) AS composite, CASE WHEN track_a > track_b THEN 'A' WHEN track_b > track_a THEN 'B' ELSE 'Both' END AS modality, CASE WHEN greatest(track_a, track_b) >= 80 THEN 'High' WHEN greatest(track_a, track_b) >= 50 THEN 'Medium' ELSE 'Low' END AS class FROM s"""


@query(_FLAGSHIP)
def q_weighted_composite(spark, sf):
    """Eight scores per part, two weighted tracks with caps, and their class."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_returnflag", "l_discount", "l_extendedprice", "l_quantity")
    r = F.col("l_returnflag") == "R"
    # distinct counts by two levels of grouping: no row is expanded, and each level is combined before its shuffle
    orders = line.where(r).groupBy("l_partkey", "l_orderkey").agg(F.lit(1).alias("one")).groupBy("l_partkey").agg(n("nr"))
    pairs = line.groupBy("l_partkey", "l_suppkey").agg(n("n"), F.count_if(r).alias("lr"), F.count_if(F.col("l_returnflag") == "A").alias("na"), F.max("l_discount").alias("md"), F.max("l_extendedprice").alias("mp"), F.max("l_quantity").alias("mq"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    with_supplier = pairs.join(s, pairs["l_suppkey"] == s["s_suppkey"], "left")
    stats = with_supplier.groupBy("l_partkey").agg(F.sum("n").alias("n"), F.sum("lr").alias("lr"), F.sum("na").alias("na"), F.max("md").alias("md"), F.max("mp").alias("mp"), F.max("mq").alias("mq"), n("ns"), F.count_if(F.col("s_acctbal") > 7000).alias("nt"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    g = attach(attach(parts, stats, "l_partkey"), orders, "l_partkey").fillna(0, ["n", "lr", "na", "ns", "nt", "nr"])
    kind, size = F.col("p_type"), F.col("p_size")
    g = g.withColumn("bo", (kind == "PROMO") & (size <= 10)).withColumn("pr", F.when(F.col("n") > 0, 100.0 * F.col("lr") / F.col("n")))
    bo, md, mp, nr, nt = (F.col(x) for x in ("bo", "md", "mp", "nr", "nt"))
    c = g.select(
        F.col("l_partkey").alias("partkey"), "bo", "p_type", "nr",
        ladder((bo, 0), (nr >= 10, 10), (nr >= 8, 9), (nr >= 6, 8), (nr >= 1, 7), (F.col("na") > 0, 4), default=0).alias("known"),
        ladder((bo, 0), (kind == "ECONOMY", 10), (kind == "STANDARD", 9), (kind == "LARGE", 8), ((kind == "MEDIUM") & (size >= 25), 7), (kind == "MEDIUM", 5), (size >= 25, 2), default=0).alias("family"),
        ladder((bo, 0), ((md >= 0.10) & (mp >= 70000), 10), ((md >= 0.10) & (mp >= 60000), 8), ((md >= 0.09) & (mp >= 50000), 6), (md.isNotNull(), 1), default=0).alias("pocket"),
        bands(size, (40, 10), (25, 7), (10, 3), default=0).alias("level"),
        ladder((kind.isin("PROMO", "ECONOMY"), 10), (kind == "STANDARD", 7), (kind == "LARGE", 4), default=1).alias("access"),
        bands("pr", (10, 10), (20, 8), (30, 6), (40, 4), (50, 2), default=0, below=True).alias("ord"),
        ladder(((F.col("n") >= 30) & (F.col("mq") >= 45), 10), (F.col("n") >= 25, 7), (F.col("n") >= 20, 5), (F.col("n") >= 10, 3), default=0).alias("breadth"),
        ladder(((nt >= 10) | ((F.col("ns") >= 25) & (nt >= 8)), 10), (nt >= 6, 7), (nt >= 3, 4), (nt >= 1, 2), default=0).alias("network"),
    )
    a = 10.0 * F.col("known") + 6 * F.col("family") + 5 * F.col("pocket") + 2 * F.col("level") + 2 * F.col("access") + 2 * F.col("ord") + F.col("breadth") + F.col("network")
    nothing = (F.col("known") == 0) & (F.col("family") == 0) & (F.col("pocket") == 0)
    cap = lambda when, most: F.when(when, F.lit(most)).otherwise(F.lit(100.0))
    b = 8.0 * bands("nr", (12, 10), (10, 8), default=0) + 6 * ladder((kind == "PROMO", 10), (kind == "LARGE", 9), default=1) + 3 * F.col("level") + 2 * F.col("breadth") + F.col("network")
    scored = c.withColumn("track_a", F.round(F.least(a / 290 * 100, cap(nothing, 30.0), cap(bo, 20.0)), 2)).withColumn("track_b", F.round(b / 200 * 100, 2))
    scored = scored.withColumn("composite", F.greatest("track_a", "track_b"))
    modality = ladder((F.col("track_a") > F.col("track_b"), "A"), (F.col("track_b") > F.col("track_a"), "B"), default="Both")
    return scored.select("partkey", "known", "family", "pocket", "level", "access", "ord", "breadth", "network", "track_a", "track_b", "composite", modality.alias("modality"), bands("composite", (80, "High"), (50, "Medium"), default="Low").alias("class"))


# -- names, what is left to fetch, and reports -------------------------------------------------------------------------


@query("SELECT p_partkey AS partkey, CASE WHEN p_size > 10 AND p_name <> '' THEN CAST(p_partkey AS VARCHAR) || ':' || p_name ELSE CAST(p_partkey AS VARCHAR) END AS label FROM part")
def q_id_and_name(spark, sf):
    name = F.when(F.col("p_size") > 10, F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), id_and_name(F.col("p_partkey").cast("string"), name).alias("label"))


@query("SELECT DISTINCT c_custkey AS structure FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def q_still_missing(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("structure"))
    return still_missing(wanted, table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("structure")))


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC")
def q_counts_by_value_down(spark, sf):
    return value_counts(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority")), "priority", down=True)


@query("""SELECT CAST(s_nationkey AS BIGINT) AS score, 'S' || s_suppkey AS gene_symbol, 'TARGET: S' || s_suppkey || chr(10) || repeat('-', 80) || chr(10) || chr(10) || 'SCORES:' || chr(10) || '  Composite: 0.0/100' || chr(10)
|| '  Small Molecule: 0.0/100 (Literature: 0/100)' || chr(10) || '  Biologic: 0.0/100 (Literature: 0/100)' || chr(10) || '  Best Modality: Unknown' || chr(10) || chr(10) || 'VALIDATION:' || chr(10) || '  Level: ' || s_name || chr(10)
|| '  Score: ' || s_nationkey || '/10' || chr(10) || '  Publications: ' || s_nationkey * 2 || chr(10) || '  Clinical Trials: 0' AS value FROM supplier""")
def q_report_blocks(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("gene_symbol"),
        F.col("s_name").alias("Step12_Validation_Level"),
        F.col("s_nationkey").alias("Step12_Validation_Score"),
        (F.col("s_nationkey") * 2).alias("Step12_Literature_Publications"),
    )
    return validation_report(rows)
