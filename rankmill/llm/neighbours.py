"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node, so copies make no edges among themselves; a node keeps the smallest ids of its rows, as many
as any answer can need. The graph begins with the neighbours within blocks of nodes that random projections bring
together, and is then refined: in each round every node introduces its neighbours, and those it is a neighbour of, to each
other, by joins of the edges with the vectors, and a node keeps its ``degree`` nearest. Two that have been introduced by a node
before aren't again: one of them must be a new neighbour there. A node with more neighbours than ``GROUP`` introduces
them in parts, dealt anew in each round, so that none is left out and no two are kept apart for good. Queries begin at
their own node and, round by round, expand the nodes of their beam
that aren't expanded yet, until there are none. Distances of the answers are computed in double precision
from the original vectors.

Every row takes part in the graph. Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component, and rows without an id, take no part; nor do vectors whose length isn't the table's most frequent one (of equally
frequent ones the largest); of several rows with one id that with the smallest vector counts; ties go to the smaller id;
with fewer candidates than asked for, all are given; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.llm import common

DEGREE = 56
TREES = 2
LEAF = 512  # nodes of a block that are compared with each other at first
MOST_ROUNDS = 8
SETTLED = 0.01  # of the edges new in a round: then the graph is good enough
GROUP = 112  # neighbours that are introduced to each other at once, about
BEAM = 64
LANDMARKS = 4
EDGES = pa.schema([("node", pa.int64()), ("nbr", pa.int64()), ("d", pa.float64())])


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    rows = table.select(table[id_col].cast("bigint").alias("vec_id"), table[vector_col].cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (size[0]["n"] if size else 0))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy()
    return flat.reshape(batch.num_rows, -1)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    """Edges from each row to its k nearest others."""
    n = len(ids)
    if n < 2:
        return
    square = (x * x).sum(1)
    d = square[:, None] + square[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, n - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    yield common.record_batch(EDGES, {"node": np.repeat(ids, k), "nbr": ids[near].ravel(), "d": np.sqrt(np.maximum(np.take_along_axis(d, near, 1), 0)).ravel().astype(float)})


def _first_edges(nodes: DataFrame, tree: int, leaf: int, degree: int) -> DataFrame:
    """Neighbours within blocks: nodes are ordered by the signs of some random projections and then by one more, and cut."""
    planes = 7

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "vector")
            random = np.random.default_rng((tree, x.shape[1]))
            axes = random.normal(size=(x.shape[1], planes + 1))
            p = x @ axes
            code = ((p[:, :planes] > 0) @ (1 << np.arange(planes))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(code), pa.array(p[:, planes]), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["node", "code", "along", "vector"])

    def run(batches):
        held: list = []
        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, leaf - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == leaf:
                    yield from close(held)
                    held, count = [], 0
        if held:
            yield from close(held)

    def close(held):
        x = np.concatenate([_matrix(b, "vector") for b in held if b.num_rows])
        yield from _nearest(np.concatenate([b.column("node").to_numpy() for b in held if b.num_rows]), x, degree)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(parts, nodes.count() // (4 * leaf)))
    placed = nodes.select("node", "vector").mapInArrow(place, "node bigint, code bigint, along double, vector array<float>")
    dealt = placed.repartitionByRange(parts, "code", "along").sortWithinPartitions("code", "along", "node").select("node", "vector")
    return dealt.mapInArrow(run, common.spark_schema(EDGES))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k nearest neighbours."""
    order = Window.partitionBy("node").orderBy("d", "nbr")
    return edges.groupBy("node", "nbr").agg(F.min("d").alias("d")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")


def _few(found: list[tuple], degree: int) -> pa.RecordBatch:
    """Of pairs (node, nbr, d) the nearest of each node, each pair once."""
    node, nbr, d = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((nbr, d, node))
    node, nbr, d = node[order], nbr[order], d[order]
    kept = np.r_[True, (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])]
    node, nbr, d = node[kept], nbr[kept], d[kept]
    at = np.arange(len(node))
    first = np.maximum.accumulate(np.where(np.r_[True, node[1:] != node[:-1]], at, 0))
    kept = at - first < degree
    return common.record_batch(EDGES, {"node": node[kept], "nbr": nbr[kept], "d": d[kept]})


def _introduce(edges: DataFrame, nodes: DataFrame, degree: int, turn: int) -> DataFrame:
    """Edges between nodes with a common neighbour, to one of which at least it is new, that are nearer than the farthest that the node has so far."""

    def run(batches):
        names = ("center", "part", "node", "new", "far")

        def groups():
            rest = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = (*(batch.column(c).to_numpy() for c in names), _matrix(batch, "vector"))
                if rest is not None:
                    columns = tuple(np.concatenate(p) for p in zip(rest, columns, strict=True))
                center, part = columns[:2]
                bounds = [0, *(np.flatnonzero((center[1:] != center[:-1]) | (part[1:] != part[:-1])) + 1).tolist()]
                for a, b in itertools.pairwise(bounds):
                    yield tuple(c[a:b] for c in columns[2:])
                rest = tuple(c[bounds[-1] :] for c in columns)
            if rest is not None:
                yield rest[2:]

        out: list = []
        count = 0
        for ids, new, far, x in groups():
            if len(ids) < 2 or not new.any():
                continue
            square = (x * x).sum(1)
            d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0))
            np.fill_diagonal(d, np.inf)
            i, j = np.nonzero((d < far[:, None]) & ((new[:, None] | new[None, :]) > 0))
            if len(i):
                out.append((ids[i], ids[j], d[i, j].astype(float)))
                count += len(i)
            if count > 400_000:
                yield _few(out, degree)
                out, count = [], 0
        if out:
            yield _few(out, degree)

    ways = edges.select(F.col("node").alias("center"), F.col("nbr").alias("member"), "new").union(edges.select("nbr", "node", "new"))
    both = ways.repartition("center").groupBy("center", "member").agg(F.max("new").alias("new"))
    # centres to which some member is new, and how many parts they have
    size = both.groupBy("center").agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.max("new").alias("some")).where("some = 1").drop("some")
    dealt = both.join(size, "center").withColumn("part", F.pmod(F.xxhash64("member", F.lit(turn)), "parts"))
    far = edges.groupBy("node").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(float("inf")).alias("far"))
    known = nodes.select("node", F.col("vector").cast("array<float>").alias("vector")).join(far, "node", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    met = dealt.join(known, dealt["member"] == known["node"]).select("center", "part", "node", "new", "far", "vector")
    return met.repartition("center", "part").sortWithinPartitions("center", "part").mapInArrow(run, common.spark_schema(EDGES))


def _landmark_edges(nodes: DataFrame) -> DataFrame:
    """Edges from every node to a few first nodes, so that none is without any, however the blocks fall."""
    found = nodes.orderBy("node").limit(LANDMARKS + 1).collect()
    ids, x = np.array([r["node"] for r in found], np.int64), np.array([r["vector"] for r in found], float)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, y = batch.column("node").to_numpy(), _matrix(batch, "vector")
            d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (y @ x.T), 0))
            i, j = np.nonzero(own[:, None] != ids[None, :])
            yield common.record_batch(EDGES, {"node": own[i], "nbr": ids[j], "d": d[i, j]})

    return common.map_arrow(nodes.select("node", "vector"), run, EDGES)


def build(scratch: common.Scratch, nodes: DataFrame, *, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, settled: float = SETTLED) -> DataFrame:
    """The graph's edges (node, nbr, d)."""
    edges = _landmark_edges(nodes)
    for t in range(trees):
        edges = edges.union(_first_edges(nodes, t, leaf, degree))
    edges = scratch.keep(_best(edges, degree).withColumn("new", F.lit(1)), "edges0")
    for k in range(1, MOST_ROUNDS + 1):
        # equal edges from both sides were there before; what is nearest of both has the old ones at the same distance
        met = _introduce(edges, nodes, degree, k).withColumn("new", F.lit(1))
        order = Window.partitionBy("node").orderBy("d", "nbr")
        both = edges.withColumn("new", F.lit(0)).union(met).groupBy("node", "nbr").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        edges = scratch.keep(both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= degree).drop("k"), f"edges{k}")
        scratch.drop(f"edges{k - 1}")
        changed = edges.agg(F.avg("new").alias("share")).first()["share"]
        if not changed or changed < settled:
            break
    return edges.select("node", "nbr", "d")


def search(scratch: common.Scratch, starts: DataFrame, nodes: DataFrame, edges: DataFrame, *, beam: int = BEAM, whole: bool = False) -> DataFrame:
    """Of each start node its beam: (start, node, d), at most ``beam`` rows, the start itself among them; if ``whole`` all nodes that were measured."""
    # what every round joins stays dealt by its key; a lost part is read again from its table
    ways = edges.select("node", "nbr").union(edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct().repartition("node").persist()
    known = nodes.select("node", "vector").repartition("node").persist()
    asked = starts.join(nodes, starts["start"] == nodes["node"]).select("start", F.col("vector").alias("asked")).repartition("start").persist()
    held = scratch.keep(starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("done")), "beam0")
    near = Window.partitionBy("start").orderBy("d", "node")
    for k in itertools.count(1):
        # what has been seen stays with its distance; what is in the beam and hasn't been expanded is, all at once
        ranked = scratch.keep(held.withColumn("place", F.row_number().over(near)), f"ranked{k}")
        turn = ranked.where((F.col("place") <= beam) & ~F.col("done")).select("start", "node")
        if turn.isEmpty():
            for table in (ways, known, asked):
                table.unpersist()
            return ranked.where(whole | (F.col("place") <= beam)).select("start", "node", "d")
        new = turn.join(ways, "node").select("start", F.col("nbr").alias("node")).repartition("node").distinct()
        measured = new.join(known, "node").join(asked, "start").select("start", "node", distance("vector", "asked").alias("d"), F.lit(False).alias("done"))
        before = ranked.select("start", "node", "d", (F.col("done") | (F.col("place") <= beam)).alias("done"))
        held = before.union(measured).groupBy("start", "node").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        if k > 1:
            scratch.drop(f"ranked{k - 1}")


def nearest(table: DataFrame, *, every: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    scratch = common.Scratch(spark, "neighbours")
    rows = scratch.keep(vectors(table, id_col, vector_col), "rows")
    node = rows.groupBy("vector").agg(F.min("vec_id").alias("node"))
    nodes = scratch.keep(node, "nodes")
    queries = scratch.keep(rows.where(F.col("vec_id") % every == 0).join(nodes, "vector").select(F.col("vec_id").alias("query_id"), F.col("node").alias("start")), "queries")
    # of each node the smallest ids of its rows: no answer needs more
    first = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)
    members = scratch.keep(few.join(nodes, "vector").select("node", "vec_id"), "members")
    edges = build(scratch, nodes, **options)
    found = search(scratch, queries.select("start").distinct(), nodes, edges, beam=max(BEAM, 2 * k + 2))
    answers = found.join(members, "node").select("start", "vec_id", "d")
    best = Window.partitionBy("query_id").orderBy("d", "vec_id")
    given = queries.join(answers, "start").where("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return given.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), every=100)
