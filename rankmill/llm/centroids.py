"""Clustering around centroids in exact integers, with block norms as a screen.

A vector is kept with the norms of its segments (its compressed form). By Cauchy and Schwarz no vector is nearer to a
centroid than the distance of their segment norms: sum over segments of (|x_s| - |c_s|)^2 bounds the squared distance from
below. A vector visits the centroids in the order of that bound and stops once the next bound is over the least distance
found; only those visited get an exact integer distance. The bound is in floating point and is lowered by more than its rounding
error, so the screen changes no result, ties included.

The kept vectors are written once with their norms. A round is one pass: tasks assign their rows and give one row of sums per
centroid and task; Spark adds them up, and only the centroids' sums, whose size doesn't grow with the table, reach the driver. No
row is shuffled, so copies of one vector, however many, burden no task more than others.

Defined cases: vectors that are null, of another length than ``dims``, or hold a null or non-finite component aren't kept; a
component that would be beyond 2^27 is held at it, so that each distance fits a long; a null id counts as the empty text
when the first centroids are drawn; repeated rows are vectors of their own (equal hashes are ordered by components); with
fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import common

SEGMENTS = 16
SCALE = 256
MOST = 1 << 27  # of a component, so that 64 squares of differences fit a long
ROWS = 4096  # compared at once


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The norm of each segment of each row; segments differ in length by one at most."""
    segments = max(1, min(segments, x.shape[1]))
    starts = np.linspace(0, x.shape[1], segments, endpoint=False).astype(int)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1))


def assign(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest centroid (ties: the smaller number), its squared distance, and how many distances were measured."""
    n = len(x)
    bound = np.zeros((n, len(centroids)))
    for s in range(norms.shape[1]):
        bound += (norms[:, s, None] - centroid_norms[None, :, s]) ** 2
    size = (norms**2).sum(1)[:, None] + (centroid_norms**2).sum(1)[None, :]
    bound -= 1e-12 * size + 1e-6  # more than what rounding can have added
    order = np.argsort(bound, axis=1, kind="stable")
    rising = np.take_along_axis(bound, order, 1)
    best, which, measured = np.full(n, np.iinfo(np.int64).max), np.full(n, len(centroids)), np.zeros(n, np.int64)
    active = np.arange(n)
    for step in range(len(centroids)):
        active = active[rising[active, step] <= best[active]]
        if not len(active):
            break
        c = order[active, step]
        off = x[active] - centroids[c]
        d = np.einsum("ij,ij->i", off, off)
        better = (d < best[active]) | ((d == best[active]) & (c < which[active]))
        hit = active[better]
        best[hit], which[hit] = d[better], c[better]
        measured[active] += 1
    return which, best, measured


def kept_vectors(table: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", segments: int = SEGMENTS) -> DataFrame:
    """vec_id, v (whole components) and norms (of its segments) of the rows that take part."""
    x = F.col("x")
    rows = table.select(table[id_col].cast("bigint").alias("vec_id"), table[vector_col].cast("array<double>").alias("x"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(x.isNotNull() & (F.size(x) == dims)).where(fine)
    whole = F.transform(x, lambda e: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(e * SCALE))).cast("int"))

    def run(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(segment_norms(v, segments)), pa.list_(pa.float64()))], names=["vec_id", "v", "norms"])

    return rows.select("vec_id", whole.alias("v")).mapInArrow(run, "vec_id bigint, v array<int>, norms array<double>")


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hashes of ``seed:id``, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.select("v", hashed.alias("h")).orderBy("h", "v").limit(k).collect()], np.int64)


def _batches(batches, dims: int):
    for batch in common.slices(batches, ROWS):
        if batch.num_rows:
            x, norms = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("v", "norms"))
            yield batch, x.astype(np.int64), norms


def _sums(kept: DataFrame, centroids: np.ndarray, norms: np.ndarray) -> DataFrame:
    """cluster, n and the sums of components, from one row per task and cluster."""
    k, dims = centroids.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, own in _batches(batches, dims):
            which, *_ = assign(x, own, centroids, norms)
            n += np.bincount(which, minlength=k)
            np.add.at(sums, which, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = kept.select("v", "norms").mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")
    whole = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole)


def cluster(table: DataFrame, *, k: int, rounds: int, seed: int, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", segments: int = SEGMENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, the centroid itself, and how many distances were measured for the row."""
    spark = table.sparkSession
    scratch = common.Scratch(spark, "centroids")
    kept = scratch.keep(kept_vectors(table, dims, id_col, vector_col, segments), "kept")
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for row in _sums(kept, centroids, segment_norms(centroids, segments)).collect():  # a row per centroid
            moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
        if (moved == centroids).all():
            break  # nothing would change any more
        centroids = moved
    norms = segment_norms(centroids.reshape(-1, dims), segments)

    def run(batches):
        for batch, x, own in _batches(batches, dims):
            which, best, measured = assign(x, own, centroids, norms)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which, pa.int32()), pa.array(best), pa.array(measured, pa.int32())], names=["vec_id", "cluster", "distance", "measured"])

    done = scratch.keep(kept.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, measured int"), "assigned")
    scratch.drop("kept")
    places = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    totals = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = totals.agg(F.sum("cluster_inertia").alias("inertia"))
    # a row per centroid, and one row: k bounds both
    about = F.broadcast(totals.join(places, "cluster").crossJoin(F.broadcast(whole)))
    return done.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "measured")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids after 5 rounds; a digest of each vector's own."""
    found = cluster(common.table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, dims=64)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64) -> str:
    """The same by comparing every vector with every centroid; each round's centroids are a list of lists."""
    steps = [f"""
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT v, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h, v LIMIT {k})
)"""]
    near = """SELECT rid, arg_min(cluster, CAST(d AS HUGEINT) * 1000 + cluster) AS cluster, min(d) AS d FROM (
        SELECT rid, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS d FROM kept, c{i}) GROUP BY rid"""
    for i in range(rounds):
        steps.append(f"""
a{i} AS MATERIALIZED ({near.format(i=i)}), m{i} AS (
    SELECT cluster, list(CAST(m AS BIGINT) ORDER BY j) AS c FROM (
        SELECT cluster, j, (s - ((s % n) + n) % n) // n AS m FROM (
            SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS j FROM kept JOIN a{i} USING (rid)) GROUP BY cluster, j)) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (SELECT b.cluster, coalesce(m{i}.c, b.c) AS c FROM c{i} b LEFT JOIN m{i} USING (cluster))""")
    steps.append(f"\nlast AS MATERIALIZED ({near.format(i=rounds)})")
    return f"""WITH {",".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM last JOIN kept USING (rid) JOIN c{rounds} USING (cluster)"""

