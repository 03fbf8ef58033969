import random

import pytest
from pyspark.sql import functions as F

from rankmill.operators import rule_index
from rankmill.operators.rule_index import matched, rule_table
from tests.test_mechanisms import plain_hits, settings


def shuffled(node):
    """Of a plan that was run: the rows that each of its exchanges wrote, and those handed out by broadcasts."""
    metric = {"Exchange": "shuffleRecordsWritten", "BroadcastExchange": "numOutputRows"}.get(node.nodeName())
    found = [(node.nodeName(), node.metrics().apply(metric).value())] if metric else []
    children = node.children()
    for i in range(children.size()):
        found += shuffled(children.apply(i))
    return found


@pytest.mark.parametrize("length", [2, 40])
def test_texts_that_share_their_trigrams_are_not_shuffled_by_them(spark, length):
    families = {"A": {"keywords": ["kinase", "the"], "ids": ["PF00001"]}, "B": {"keywords": ["receptor"], "ids": []}}
    n = 400
    rows = spark.range(n).select(F.struct("id").alias("key"), F.concat(F.lit("the kinase "), F.repeat(F.lit("and receptor likeness "), length), "id").alias("low"), F.array(F.lit("PF00001")).alias("ids"))
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = matched(rows, rule_table(spark, families))._jdf.queryExecution()
        assert plan.toRdd().count() == n
        moved = shuffled(plan.executedPlan())
    # the hits alone, four a row, and counts and rules beside them; none of the data in a broadcast
    assert n <= sum(rows for kind, rows in moved if kind == "Exchange") <= 5 * n
    assert max(rows for kind, rows in moved if kind == "BroadcastExchange") < 40


def test_rows_are_never_handed_out_where_rules_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "HANDED", 0)
    rows = spark.range(400).select(F.struct("id").alias("key"), F.concat(F.lit("the kinase "), "id").alias("low"), F.array(F.lit("PF00001")).alias("ids"))
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = matched(rows, rule_table(spark, {"A": {"keywords": ["kinase", "the"], "ids": ["PF00001"]}}))._jdf.queryExecution()
        assert plan.toRdd().count() == 400
    # the trigrams' counts may be
    assert not [n for kind, n in shuffled(plan.executedPlan()) if kind == "BroadcastExchange" and (n == 400 or n > 1500)]


@pytest.mark.parametrize("strict", [False, True])
def test_rules_that_are_dealt_hold_like_those_handed_out(spark, monkeypatch, strict):
    roll = random.Random(5)
    word = lambda least, most: "".join(roll.choice("abcé ") for _ in range(roll.randrange(least, most)))
    families = {f"F{n}": {"keywords": [word(2, 6) for _ in range(6)] + ["", "İn"] * (n == 3), "ids": [f"PF{roll.randrange(40)}", f"IPR{roll.randrange(40)}"]} for n in range(20)}
    texts = [(i, " ".join(word(2, 30) for _ in range(3)), [f"PF{roll.randrange(40)}" for _ in range(4)]) for i in range(80)]
    texts += [(100, None, None), (101, "", []), (102, "abc", [None, "PF1", "PF1"]), (None, "abc", None)]
    rows = spark.createDataFrame(texts, "k int, t string, ids array<string>").select(F.struct("k").alias("key"), F.lower("t").alias("low"), "ids")
    table = rule_table(spark, families)
    found = []
    for most in (rule_index.HANDED, table.count() - 1):
        monkeypatch.setattr(rule_index, "HANDED", most)
        found.append({r["key"]["k"]: [h["evidence"] for h in r["hits"]] for r in matched(rows, table, strict).collect()})
    assert found[0] == found[1] == {k: e for k, t, ids in texts if (e := plain_hits(t, ids, families, strict))}


@pytest.mark.parametrize("kind", ["keywords", "ids"])
def test_rules_of_one_kind_alone(spark, kind):
    families = {"A": {kind: ["kinase" if kind == "keywords" else "PF1"]}}
    rows = spark.createDataFrame([(1, "a kinase", ["PF1"]), (2, "none", ["PF2"])], "key int, low string, ids array<string>")
    hits = [(r["key"], [h["family"] for h in r["hits"]]) for r in matched(rows, rule_table(spark, families)).collect()]
    assert hits == [(1, ["A"])]
