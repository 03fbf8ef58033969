"""How tables meet: null keys, rules as rows, stages in buckets, failed answers, counts in passing."""

import contextlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rankmill.functions import rules
from rankmill.operators.rule_index import RULES, matched, rule_table
from rankmill.operators.tables import attach, lookup
from rankmill.plans import features, targets
from rankmill.sources import sinks, snapshots

PAIRS = "k string, j int, v int"


@contextlib.contextmanager
def settings(spark, wanted):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def some(rows):
    return sorted(map(tuple, rows), key=repr)


def test_null_keys_meet_null_keys(spark):
    left = [("a", 1, 0), (None, 1, 1), (None, 2, 2), ("b", None, 3), ("a", 2, 4), (None, None, 5), (None, None, 5)]
    right = [("a", 1, 9), (None, 7, 8), (None, 7, 7), ("c", 1, 6), ("a", 5, 5)]
    frame = lambda rows, names: spark.createDataFrame(rows, PAIRS).toDF(*names)
    a, b = frame(left, ("k", "j", "v")), frame(right, ("k", "o", "w"))
    found = attach(a, b, "k").select("k", "j", "v", "w")
    assert some(found.collect()) == some([(x[0], x[1], x[2], y[2] if y else None) for x in left for y in ([r for r in right if r[0] == x[0]] or [None])])
    one = [r for r in right if r[2] != 7 and r != ("a", 5, 5)]
    for how in ({}, {"unique": True}, {"both": True}):
        got = attach(a, frame(one, ("k", "o", "w")), "k", {"w": -1}, **how).select("k", "v", "w")
        assert some(got.collect()) == some([(x[0], x[2], next((r[2] for r in one if r[0] == x[0]), -1)) for x in left])
    many = attach(a, frame(right[1:3], ("k", "o", "w")), "k", both=True)
    assert some(many.select("k", "v", "w").collect()) == some([(x[0], x[2], 7 if x[0] is None else None) for x in left])
    for rows in ([], right):
        empty = attach(frame([], ("k", "j", "v")), frame(rows, ("k", "o", "w")), "k")
        assert empty.collect() == [] and empty.columns == ["k", "j", "v", "o", "w"]
    assert some(attach(a, frame([], ("k", "o", "w")), "k").select("k", "v", "w").collect()) == some([(x[0], x[2], None) for x in left])


def test_null_keys_of_several_columns(spark):
    left = [("a", 1, 0), (None, 1, 1), (None, 2, 2), ("b", None, 3), (None, None, 5), ("b", 1, 6)]
    right = [("a", 1, 9), (None, 1, 8), (None, None, 7), ("b", None, 6), ("b", None, 5)]
    a, b = spark.createDataFrame(left, PAIRS), spark.createDataFrame(right, PAIRS).withColumnRenamed("v", "w")
    wanted = [(*x, y[2] if y else None) for x in left for y in ([r for r in right if r[:2] == x[:2]] or [None])]
    assert some(attach(a, b, ["k", "j"]).collect()) == some(wanted)


def test_lookups_of_null_find_nothing(spark):
    a, b = spark.createDataFrame([("a", 1, 0), (None, 1, 1)], PAIRS), spark.createDataFrame([("a", 9), (None, 8)], "k string, w int")
    assert some(lookup(a, b, "k", {"w": -1}).collect()) == some([("a", 1, 0, 9), (None, 1, 1, -1)])


def test_rows_without_a_key_are_not_shuffled_by_it(spark):
    big = spark.range(100_000, numPartitions=4).selectExpr("if(id % 3 = 0, null, id) AS k", "id AS v")
    few = spark.range(40).selectExpr("if(id > 37, null, id) AS k", "id AS w")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        found = attach(big, few, "k").where("k IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in found) == 2 * 33334
    assert max(r["count"] for r in found) < 0.5 * 2 * 33334


def plain_hits(text, ids, families, strict):
    out = []
    for name, rule in families.items():
        low = None if text is None else text.lower()
        for k in rule["keywords"]:
            if low is not None and (re.search(rf"\b{re.escape(k.lower())}\b", low) if strict else k.lower() in low):
                out.append(f"{name}: Keyword: {k}")
        out += [f"{name}: {'Pfam' if i.startswith('PF') else 'InterPro'}: {i}" for i in rule["ids"] if i in (ids or [])]
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_ten_thousand_rules_hold_where_they_should(spark, strict):
    roll = random.Random(3)
    word = lambda least, most: "".join(roll.choice("abcdé ") for _ in range(roll.randrange(least, most)))
    families = {f"F{n}": {"keywords": [word(3, 9) for _ in range(18)] + ["In"] * (n == 3) + ["", "Q"] * (n == 5), "ids": [f"PF{roll.randrange(4000)}", f"IPR{roll.randrange(4000)}"]} for n in range(500)}
    texts = [(i, " ".join(word(2, 40) for _ in range(4)).upper(), [f"PF{roll.randrange(4000)}" for _ in range(30)]) for i in range(60)]
    texts += [(100, None, None), (101, "", []), (102, "x in y q", [None, "PF1", "PF1"]), (103, "abc " * (4_000 if strict else 40_000), None), (None, "in", None)]
    table = rule_table(spark, families)
    assert table.count() > 10_000 - 10
    rows = spark.createDataFrame(texts, "k int, t string, ids array<string>").select(F.struct("k").alias("key"), F.lower("t").alias("low"), "ids")
    found = {r["key"]["k"]: [h["evidence"] for h in r["hits"]] for r in matched(rows, table, strict).collect()}
    assert found == {k: e for k, t, ids in texts if (e := plain_hits(t, ids, families, strict))}


def test_the_plan_does_not_grow_with_the_rules(spark):
    rows = spark.createDataFrame([(1, "a kinase", None)], "key int, low string, ids array<string>")
    size = lambda n: len(matched(rows, spark.range(n).selectExpr("0 AS family_no", "cast(id AS int) AS rule_no", "'A' AS family", "'Keyword' AS kind", "concat('kin', id) AS value"))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(20) - size(20_000)) < 200


def test_a_table_of_rules_classifies_like_the_families(spark):
    said = ["Tyrosine Kinase of the membrane", "olfactory receptor, 7tm", "nothing", None, "Tyrosine Kinase of the membrane"]
    df = spark.createDataFrame([(t, ["PF00001", "IPR000719"] if i % 2 else None) for i, t in enumerate(said)], "t string, i array<string>")
    by = [features.classify_families(df, df["t"], features.first_list("i"), f) for f in (None, rules.FAMILIES, rule_table(spark, rules.FAMILIES))]
    found = [some(x.select("t", "druggable_family_type", "druggable_family_evidence").collect()) for x in by]
    assert found[0] == found[1] == found[2] and len(found[0]) == 5
    few = {"A": {"keywords": ["Kinase", "7tm"], "ids": ["PF00001"]}, "B": {"keywords": [], "ids": []}, "C": {"keywords": ["the"], "ids": ["IPR000719"]}}
    for strict in (False, True):
        by = [features.classify_families(df, df["t"], features.first_list("i"), f, strict) for f in (few, rule_table(spark, few))]
        assert some(by[0].collect()) == some(by[1].collect())
    for t, _, evidence in found[0]:
        assert not t or set(evidence.split("|")) >= set(plain_hits(t, None, rules.FAMILIES, False)[:3]) - {""}
    none = features.classify_families(df, df["t"], features.first_list("i"), spark.createDataFrame([], RULES)).collect()
    assert len(none) == 5 and not any(r["is_druggable_family"] for r in none)


# -- stages ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("answers")
    lines = {
        "gene_annotation": [{"query": g, "symbol": g, "uniprot": f"U{g}", "ensembl": {"gene": f"E{g}"}} for g in "ABC"],
        "drug_interactions": [{"gene": "A", "interactions": [{"drug": {"name": "x", "approved": True}}]}, {"gene": "B", "_status": "500", "_error": "server"}, {"gene": "C", "_status": "404"}],
        "tissue_expression": [{"gene": "A", "_status": "200", "data": [{"tissueSiteDetailId": "Lung", "median": 4.0}]}, {"gene": "B", "_error": "timed out"}],
        "target_level": [{"sym": "A", "tdl": "Tclin"}, {"sym": "B", "novelty": "not a number", "tdl": "Tbio"}],
    }
    for name in snapshots.SCHEMAS:
        (base / name).mkdir()
        (base / name / "part.json").write_text("".join(json.dumps(r) + "\n" for r in lines.get(name, [])))
    with (base / "drug_interactions" / "part.json").open("a") as f:
        f.write('{"gene": "D", "interactions": [{"drug": {"na\n{"gene":\n')
    return str(base)


def wide_scans(node, exchanged=False):
    """Of a plan's scans of stage tables with more than a few columns: whether an exchange stands above."""
    name = node.nodeName()
    exchanged = exchanged or "Exchange" in name
    found = [(exchanged, node.output().size())] if re.search(r"^Scan .*_stage\d\d(?!_)", name) and node.output().size() > 6 else []
    children = node.children()
    for i in range(children.size()):
        found += wide_scans(children.apply(i), exchanged)
    return found


def test_stages_attach_without_moving_the_wide_table(spark, root, tmp_path, monkeypatch):
    plans, keep = {}, sinks.StageStore.__call__

    def kept(self, df, name):
        plans[name] = wide_scans(df._jdf.queryExecution().executedPlan())
        return keep(self, df, name)

    monkeypatch.setattr(sinks.StageStore, "__call__", kept)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        pockets = spark.createDataFrame([("A", 1, 0.6, 0.8, 600.0, 0.5, 1.0, 9)], "gene_symbol string, pocket_id int, score double, druggability double, volume double, hydrophobicity double, polarity double, alpha_spheres int")
        genes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), (None,)], "gene_symbol string")
        found = {r["gene_symbol"]: r for r in targets.run(spark, genes, root, until=10, stages=str(tmp_path), pockets=pockets).collect()}
    for stage in (f"stage{i:02d}" for i in range(2, 11)):
        assert plans[stage] and not any(exchanged for exchanged, _ in plans[stage]), (stage, plans[stage])
    assert set(found) == {"A", "B", "C", "D", None}
    # failed answers, and those of nothing, count as no answer
    assert [found[g]["dgidb_found"] for g in "ABCD"] == [True, False, False, False]
    assert [found[g]["Step7_GTEx_Data_Available"] for g in "ABCD"] == [True, False, False, False]
    again = {(r["snapshot"], r["key"]): (r["status"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/refetch").collect()}
    assert again == {("drug_interactions", "B"): ("500", "server"), ("drug_interactions", "D"): (None, "not readable"), ("drug_interactions", None): (None, "not readable"), ("tissue_expression", "B"): (None, "timed out"), ("target_level", "B"): (None, "not readable")}


def test_a_store_counts_in_passing_and_opens_what_it_kept(spark, tmp_path):
    store = sinks.stage_store(spark, str(tmp_path))
    rows = spark.createDataFrame([("A", 1, None), ("B", None, None), (None, 3, None)], "gene_symbol string, x int, `odd name` string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("kept", "")
    held = store(rows, "one")
    assert len(jobs.getJobIdsForGroup("kept")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert store.profile["one"] == {"rows": 3, "coverage": {"gene_symbol": 2, "x": 2, "odd name": 0}}
    store(held.withColumn("y", F.lit(1)), "two")
    assert store.profile["two"] == {"rows": 3, "coverage": {"y": 3}}
    store(rows.drop("gene_symbol"), "loose")
    other = sinks.stage_store(spark, str(tmp_path))
    opened = other.open("one", int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert some(opened.collect()) == some(rows.collect())
    assert "Bucketed: true" in opened.groupBy("gene_symbol").count()._jdf.queryExecution().executedPlan().toString()
    for x in (store, other):
        x.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("stage_" + store.prefix, other.prefix))]


def test_publications_of_another_disease_do_not_count(spark):
    from rankmill.plans import validation

    papers = spark.createDataFrame([("A", "Migraine", 3, []), ("A2", "asthma", 5, []), ("A3", None, 7, [])], snapshots.SCHEMAS["literature"])
    trials = spark.createDataFrame([], snapshots.SCHEMAS["trials"])
    count = lambda *more: {r["gene_symbol"]: r["Step12_Literature_Publications"] for r in validation.evidence(papers, trials, *more).collect()}
    assert count() == {"A": 3, "A3": 7} and count("Asthma") == {"A2": 5, "A3": 7}
