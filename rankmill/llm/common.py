"""What the operators share: reading, scratch tables, memos, Arrow helpers."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only these two columns, as ``doc_id`` and ``text``; whatever else the table holds can't clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where nothing is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="rankmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: While a scratch table is written: its shuffle files go as soon as it is there.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of this session have about so many bytes at most, if they may have more now: memory follows them, on both sides."""
    held = spark.conf.get(_BATCH, "64m").lower()
    number = held.rstrip("bkmgt")
    unit = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}[held[len(number) :][:1]]
    if not 0 < int(number) * unit <= most:
        spark.conf.set(_BATCH, str(most))


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """The session with these settings, and then with those it had."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder; they cut the lineage, and lost executors don't lose them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/rankmill-{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with settings(self.spark, _WRITING):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Memo(dict):
    """A dict that is emptied once it is larger than a cap, so that it can't grow with the corpus."""

    def __init__(self, cap: int, make=None):
        super().__init__()
        self.cap, self.make = cap, make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.cap:
            self.clear()


def no_cycles(function):
    """A function over batches that makes many objects and no cycles among them; the collector rests while it runs."""

    def run(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from function(batches)
        finally:
            if was:
                gc.enable()

    return run


def slices(batches, rows: int = 256):
    """Record batches in runs of a few rows, so that long texts don't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.float32()): "array<float>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def map_arrow(df: DataFrame, function, schema: pa.Schema) -> DataFrame:
    """mapInArrow where the function takes and gives record batches of at most some hundred rows."""
    return df.mapInArrow(lambda batches: function(slices(batches)), spark_schema(schema))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])
