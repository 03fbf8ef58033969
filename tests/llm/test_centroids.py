"""Clustering against a plain recount in Python's integers, and the screen against measuring everything."""

import hashlib
import math

import numpy as np
import pytest

from rankmill.llm import centroids, registry

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k, rounds, seed, dims):
    kept = [(i, [max(-centroids.MOST, min(centroids.MOST, math.floor(256 * x))) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    places = [v for _, v in drawn]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(places))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        places = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(places)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), tuple(places[j])) for i, j, d in found), key=repr)


def mine(frame, **options):
    rows = centroids.cluster(frame, **options).collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in rows), key=repr)


@pytest.mark.parametrize("dims,segments", [(3, 16), (8, 3)])
def test_rounds_equal_a_plain_recount(spark, dims, segments):
    random = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in random.normal(size=dims).round(2)], "x") for i in range(150)]
    rows += [(7, rows[7][1], "again"), (7, [0.0] * dims, None), (None, [0.5] * dims, None), (900, [1e30, -1e30, *[0.0] * (dims - 2)], "far")]
    rows += [(901, None, ""), (902, [1.0] * (dims + 1), ""), (903, [float("nan")] * dims, ""), (904, [float("inf")] * dims, ""), (905, [None] * dims, ""), (906, [], "")]
    rows += [(1000 + i, [0.25] * dims, "copies") for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, rounds in ((6, 3), (1, 2), (400, 1)):
        assert mine(frame, k=k, rounds=rounds, seed=2, dims=dims, segments=segments) == plain(rows, k, rounds, 2, dims)


def test_ties_go_to_the_smaller_number_and_an_empty_table_gives_none(spark):
    rows = [(i, [float(x), 0.0], "") for i, x in enumerate([-1, 1, 0, 0, -1, 1])]
    assert mine(spark.createDataFrame(rows, SCHEMA), k=4, rounds=2, seed=5, dims=2) == plain(rows, 4, 2, 5, 2)
    assert mine(spark.createDataFrame([], SCHEMA), k=4, rounds=2, seed=5, dims=2) == []


def test_the_screen_spares_distances_of_separated_clusters(spark):
    random = np.random.default_rng(1)
    places = random.normal(size=(30, 64)) * np.repeat(random.lognormal(0, 1.5, size=(30, 16)), 4, axis=1)
    rows = [(i, [float(x) for x in places[i % 30] + random.normal(size=64) * 0.05], "") for i in range(600)]
    found = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=30, rounds=2, seed=2, dims=64)
    assert found.agg({"measured": "avg"}).first()[0] < 6
    assert mine(spark.createDataFrame(rows, SCHEMA), k=30, rounds=2, seed=2, dims=64) == plain(rows, 30, 2, 2, 64)


def test_the_bound_never_passes_a_nearer_centroid():
    random = np.random.default_rng(3)
    for scale in (1, 300, centroids.MOST):
        x, c = (random.integers(-scale, scale + 1, size=(n, 64)) for n in (200, 25))
        c[3] = c[9]
        which, best, measured = centroids.assign(x, centroids.segment_norms(x), c, centroids.segment_norms(c))
        whole = ((x[:, None, :] - c[None]).astype(object) ** 2).sum(2)
        assert (best == whole.min(1)).all() and which.tolist() == [int(np.argmin(r)) for r in whole] and measured.max() <= 25


def test_query(spark, tmp_path):
    random = np.random.default_rng(4)
    rows = [(i, [float(x) for x in random.normal(size=64).round(3)], "") for i in range(200)] + [(300, [0.0] * 63, "")]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.QUERIES["op13_centroid_clustering"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    wanted = [(*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in plain(rows, 40, 5, 2, 64)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
