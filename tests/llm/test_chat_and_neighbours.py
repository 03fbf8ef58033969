import hashlib

import numpy as np

from rankmill.llm import chat, neighbours


def test_read_back(spark, tmp_path):
    rows = [(1, 0, "user", "hi <|im_start|>"), (1, 1, "assistant", "a \\ b </s> <|im_end|>"), (2, 1, "user", None), (2, 0, "system", "be"), (2, 2, "assistant", ""), (3, 0, "assistant", "first"), (3, 1, None, "x"), (4, 0, "user", "only"), (4, 0, "user", "only")]
    spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, formatted string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in chat.op7_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert (out[conv]["n_turns"], out[conv]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (out[conv]["loss_chars"], out[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c: r["valid"] for c, r in out.items()} == {1: True, 2: True, 3: False, 4: False, -1: True}
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert {r["conv_id"]: r["valid"] for r in chat.format_conversations(df).collect()} == {1: True, 2: True, 3: False, 4: False, -1: True}
    assert chat.format_conversations(df.limit(0)).collect() == []


def brute(rows, every, k):
    out = {}
    for q, x in rows.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), v) for v, y in rows.items() if v != q)
            out[q] = near[:k]
    return out


def check(spark, rows, table, every, k, least):
    found = {}
    for r in neighbours.nearest(table, every=every, k=k, leaf=128, trees=3).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    expected = brute(rows, every, k)
    assert set(found) == set(expected)
    hit = total = 0
    for q, near in expected.items():
        given = [found[q][i + 1] for i in range(len(near))]
        assert len(found[q]) == len(near) and given == sorted(given)
        hit += len({v for _, v in given} & {v for _, v in near})
        total += len(near)
        for s, v in given:
            assert abs(s - float(np.sqrt(((rows[q] - rows[v]) ** 2).sum()))) < 1e-12
    assert hit >= least * total, hit / total


def test_recall_with_copies_and_odd_rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 12)).astype(np.float32)
    x[300:520] = x[299]
    rows = {i: v.astype(float) for i, v in enumerate(x)}
    odd = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [None] + [1.0] * 11), (2080, [1.0, 2.0]), (None, [1.0] * 12), (2100, [])]
    table = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in odd] + [(20, [float(a) for a in x[20]], 2)], "vec_id long, embedding array<float>, node int")
    check(spark, rows, table, 20, 10, 0.95)


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    check(spark, {0: np.array([1.0, 0]), 1: np.array([0, 1.0]), 2: np.array([1.0, 1])}, table, 2, 10, 1.0)
    assert neighbours.nearest(table.limit(0), every=1).collect() == []
    assert neighbours.nearest(table.limit(1), every=1).collect() == []


def test_graph_is_good_and_search_sees_little_of_it(spark):
    """20,000 vectors in clusters, default options: recall against brute force, and the share of nodes that a query measures."""
    from pyspark.sql import functions as F

    from rankmill.llm import common

    r = np.random.default_rng(11)
    centres = r.normal(size=(20, 24))
    x = (centres[r.integers(0, 20, 20_000)] + 0.6 * r.normal(size=(20_000, 24))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, vector array<double>").repartition(8)
    scratch = common.Scratch(spark, "test")
    nodes = scratch.keep(table, "nodes")
    asked = list(range(0, 20_000, 400))
    edges = neighbours.build(scratch, nodes)
    assert edges.groupBy("node").count().agg(F.min("count"), F.max("count")).first()[:] == (neighbours.DEGREE, neighbours.DEGREE)
    seen = neighbours.search(scratch, spark.createDataFrame([(i,) for i in asked], "start long"), nodes, edges, whole=True)
    found: dict = {}
    for row in seen.collect():
        found.setdefault(row["start"], []).append((row["d"], row["node"]))
    assert sum(map(len, found.values())) / len(asked) < 0.05 * len(x)
    hit = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        hit += len({v for _, v in sorted(found[q])[1:11]} & set(np.argsort(d, kind="stable")[1:11].tolist()))
    assert hit >= 9.5 * len(asked), hit
