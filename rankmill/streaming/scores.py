"""Scores over streams: of whole feature rows, as in a batch, and of stages' rows that come in any order and late."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rankmill.plans.composite import composite


def score_stream(features: DataFrame) -> DataFrame:
    """Stateless: each row is scored as in a batch."""
    return composite(features)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def attach_each(features: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch plan on each micro-batch and appends its rows; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A gene's row of one stage: when it was made, and its columns as JSON.
UPDATES = "gene_symbol string, stage string, time timestamp, columns string"
MERGED = "gene_symbol string, parts map<string,string>"


class Enriched(StatefulProcessor):
    """Keeps of each gene the newest row of each stage and gives all of them again when one changes.

    The newest is that of the greatest time, of equal times the greatest text: so the order in which rows come doesn't matter, nor does a row that
    comes twice. A gene that had no row for ``keep_ms`` of event time is forgotten.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "stage string", "millis bigint, columns string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changed, newest = False, 0
        for row in rows:
            now = (int(row["time"].timestamp() * 1000), row["columns"] or "{}")
            before = self.held.getValue((row["stage"],)) if self.held.containsKey((row["stage"],)) else None
            if before is None or now > tuple(before):
                self.held.updateValue((row["stage"],), now)
                changed = True
            newest = max(newest, now[0])
        if changed:
            timers = list(self.handle.listTimers())
            due = newest + self.keep_ms
            if not timers or max(timers) < due:
                for t in timers:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)
            yield Row(gene_symbol=key[0], parts={stage[0]: value[1] for stage, value in self.held.iterator()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def enrich_stream(updates: DataFrame, late: str = "1 day", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """A stream of stages' rows (``UPDATES``) -> gene_symbol and ``parts``, its newest row of each stage, whenever one changes.

    Rows without gene, stage or time are left out, as are those that come later than ``late``. Needs a state store
    of column families (spark.sql.streaming.stateStore.providerClass: RocksDB's).
    """
    known = updates.where("gene_symbol IS NOT NULL AND stage IS NOT NULL AND time IS NOT NULL").withWatermark("time", late)
    return known.groupBy("gene_symbol").transformWithState(Enriched(keep_ms), MERGED, "Update", "EventTime")


def enrich_batch(updates: DataFrame) -> DataFrame:
    """The same of all rows at once."""
    known = updates.where("gene_symbol IS NOT NULL AND stage IS NOT NULL AND time IS NOT NULL")
    said = F.coalesce("columns", F.lit("{}"))
    newest = known.groupBy("gene_symbol", "stage").agg(F.max(F.struct(F.date_trunc("millisecond", "time").alias("t"), said.alias("c"))).alias("m"))
    return newest.groupBy("gene_symbol").agg(F.map_from_entries(F.collect_list(F.struct("stage", "m.c"))).alias("parts"))  # as many as there are stages


def score_enriched(merged: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Scores of genes by what is known of them by now; ``schemas``: the columns of each stage."""
    read = merged.select("gene_symbol", *[F.from_json(F.col("parts")[stage], schema).alias(stage) for stage, schema in schemas.items()])
    return composite(read.select("gene_symbol", *[f"{stage}.*" for stage in schemas]))


def latest_scores(spark: SparkSession, path: str) -> DataFrame:
    """Of what ``attach_each`` wrote under ``path`` each gene's last row."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("gene_symbol").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "gene_symbol"]), "batch").alias("r"))
    return last.select("gene_symbol", "r.*").drop("batch")
