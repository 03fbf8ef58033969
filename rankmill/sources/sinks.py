"""Writers of stage tables, exports and reports."""

from __future__ import annotations

import json
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """The stage's table as Parquet, read again: a restart begins from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, mark: str = "|") -> None:
    """An export with lists joined into one cell."""
    own = lambda c: F.col(f"`{c}`")  # noqa: E731  # names may have dots
    flat = [(F.array_join(own(c), mark) if t == "array<string>" else F.to_json(own(c)) if t.startswith(("array", "struct", "map")) else own(c)).alias(c) for c, t in df.dtypes]
    df.select(flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_priorities(df: DataFrame, path: str, least: int = 3, score: str = "Step6_Accessibility_Score") -> bool:
    """Rows with at least that score, if there are any."""
    found = df.where(F.col(score) >= least)
    if found.isEmpty():
        return False
    found.write.mode("overwrite").parquet(path)
    return True


def write_protocols(lines: DataFrame, path: str, key: str = "gene_symbol") -> None:
    """One folder of text per key, from (key, section, line, text)."""
    order = [c for c in ("section", "line") if c in lines.columns]
    lines.repartition(key).sortWithinPartitions(key, *order).select(key, "text").write.mode("overwrite").partitionBy(key).text(path)


def gene_list_json(genes: list[str]) -> str:
    return json.dumps({"genes": genes}, indent=2)


def metrics_report(metrics: DataFrame) -> DataFrame:
    """One text per row of metrics, with what the area and the correlation mean."""
    area = F.when(F.col("auc") >= 0.9, "Excellent").when(F.col("auc") >= 0.8, "Good").when(F.col("auc") >= 0.7, "Fair").otherwise("Poor")
    strength = F.when(F.abs("r") >= 0.7, "Strong").when(F.abs("r") >= 0.5, "Moderate").otherwise("Weak")
    parts = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(name).cast("string"), F.lit("not available"))) for name in ("n", "auc", "accuracy", "precision", "recall", "f1", "r", "rho")]
    cells = F.concat(F.lit("matrix: tn "), F.col("tn"), F.lit(" fp "), F.col("fp"), F.lit(" fn "), F.col("fn"), F.lit(" tp "), F.col("tp"))
    return metrics.select(F.concat_ws("\n", *parts, cells, F.concat(F.lit("discrimination: "), area), F.concat(F.lit("correlation: "), strength)).alias("value"))


class StageStore:
    """Keeps each stage's table in a shared folder, laid out for the next attach, and gives it back as read from there.

    A table with the key is written in as many buckets of it as a shuffle has partitions, sorted: attaching by the key then moves
    the new columns alone. Plans stay small from stage to stage, a restart begins at the last table (``open``), and a
    lost executor loses none. In the same pass as the write its rows and the coverage of its new columns are counted:
    ``profile`` has them by table, and a log line each. The tables' names are in the session's catalog until ``forget``.
    """

    def __init__(self, spark: SparkSession, base: str, key: str = "gene_symbol"):
        self.spark, self.base, self.key = spark, base.rstrip("/"), key
        self.prefix, self.names = f"stage_{uuid.uuid4().hex}", []
        self.profile: dict[str, dict] = {}
        self._seen: set[str] = set()

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        new = [c for c in df.columns if c not in self._seen]
        counts, watch = {f"c{i}": F.count(F.col(f"`{c}`")) for i, c in enumerate(new)}, Observation()
        watched = df.observe(watch, F.count(F.lit(1)).alias("rows"), *[x.alias(a) for a, x in counts.items()])
        if self.key in df.columns:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            writer = watched.write.bucketBy(buckets, self.key).sortBy(self.key)
            writer.mode("overwrite").option("path", f"{self.base}/{name}").saveAsTable(self._table(name))
            held = self.spark.table(self._table(name))
        else:
            held = write_stage(watched, f"{self.base}/{name}")
        found = watch.get
        rows = found["rows"]
        self._seen.update(new)
        self.profile[name] = {"rows": rows, "coverage": {c: found[f"c{i}"] for i, c in enumerate(new)}}
        shares = ", ".join(f"{c} {100 * n / rows:.1f} %" for c, n in self.profile[name]["coverage"].items()) if rows else "no rows"
        log.info("%s kept: %d rows, %d columns, new: %s", name, rows, len(df.columns), shares)
        return held

    def _table(self, name: str) -> str:
        table = f"{self.prefix}_{name}"
        if table not in self.names:
            self.names.append(table)
        return table

    def open(self, name: str, buckets: int) -> DataFrame:
        """A table that an earlier run has kept in so many buckets, with its layout."""
        schema = self.spark.read.parquet(f"{self.base}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"CREATE TABLE {self._table(name)} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {buckets} BUCKETS LOCATION '{self.base}/{name}'")
        return self.spark.table(self._table(name))

    def forget(self) -> None:
        """Takes the names out of the catalog; the files stay."""
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names = []


def stage_store(spark: SparkSession, path: str | None = None, key: str = "gene_symbol") -> StageStore:
    """A store in the given folder, else in one under spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    shared = path or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or give one")
    return StageStore(spark, path or f"{(shared or tempfile.mkdtemp(prefix='rankmill-')).rstrip('/')}/stages-{uuid.uuid4().hex}", key)
