"""Stages' rows that come out of order, late or twice give the scores of a batch."""

import json
import random

import pytest

from rankmill.streaming.scores import UPDATES, attach_each, enrich_batch, enrich_stream, latest_scores, score_enriched, windowed_counts

SCHEMAS = {"stage02": "dgidb_num_approved int, has_approved_drugs boolean", "stage05": "has_druggable_pocket boolean, best_pocket_druggability double", "stage09": "Step9_Protein_Family string, Step9_Target_Development_Level string"}
SCORES = ["gene_symbol", "Step11_SmallMolecule_Score", "Step11_Biologic_Score", "Step11_Priority"]


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def updates():
    roll, rows = random.Random(4), []
    for gene in "ABCDEF":
        for day in range(1, 4):
            parts = {"stage02": {"dgidb_num_approved": roll.randrange(12), "has_approved_drugs": roll.random() < 0.5}, "stage05": {"has_druggable_pocket": True, "best_pocket_druggability": roll.random()}, "stage09": {"Step9_Protein_Family": roll.choice(["GPCR", "Kinase"]), "Step9_Target_Development_Level": "Tclin"}}
            rows += [(gene, stage, f"2024-01-{day:02d} 0{roll.randrange(9)}:00:00", json.dumps(p)) for stage, p in parts.items() if roll.random() < 0.8]
    return rows + rows[:3] + [("A", "stage02", "2024-01-03 23:00:00", None), (None, "stage02", "2024-01-01 00:00:00", "{}"), ("A", None, "2024-01-01 00:00:00", "{}")]


def scores(df):
    return sorted(map(tuple, df.select(SCORES).collect()))


def test_rows_in_any_order_give_the_scores_of_a_batch(spark, store, tmp_path):
    rows = updates()
    frame = lambda rs: spark.createDataFrame(rs, "gene_symbol string, stage string, time string, columns string").selectExpr("gene_symbol", "stage", "timestamp(time) AS time", "columns")
    whole = scores(score_enriched(enrich_batch(frame(rows)), SCHEMAS))
    assert len(whole) == 6
    for seed in (1, 2):
        mixed, base = list(rows), tmp_path / str(seed)
        random.Random(seed).shuffle(mixed)
        for at in range(0, len(mixed), 25):  # a micro-batch each
            frame(mixed[at : at + 25]).coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(frame([]).schema).parquet(f"{base}/in")
            attach_each(enrich_stream(stream, late="10 days"), lambda batch: score_enriched(batch, SCHEMAS), f"{base}/out", f"{base}/state").awaitTermination(200)
        assert scores(latest_scores(spark, f"{base}/out")) == whole
    assert UPDATES.startswith("gene_symbol")


def test_counts_of_windows(spark):
    events = spark.createDataFrame([("2024-01-01 10:05:00", "a"), ("2024-01-01 10:55:00", "a"), ("2024-01-01 11:00:00", "b")], "t string, event_type string").selectExpr("timestamp(t) AS ts", "event_type")
    assert sorted((str(r["start"]), r["event_type"], r["n"]) for r in windowed_counts(events).collect()) == [("2024-01-01 10:00:00", "a", 2), ("2024-01-01 11:00:00", "b", 1)]
