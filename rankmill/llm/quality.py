"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a sparse ternary index vector that follows from its hash. A word's vector is the sum of the index vectors
of its neighbours at all its places in the corpus, one pass over all documents, reduced to unit length. A document is the
mean of its words' vectors. Words share hash buckets, so the table of vectors has a fixed size. What a word looks like
(upper case, signs at its end, digits, the same as the one before) counts as words of its own, next to it.

A two-layer network on the pooled vectors is fitted on a bounded sample of labelled documents, and a temperature is then
fitted on labelled documents that the network hasn't seen, which makes its probabilities calibrated.

Defined cases: a null text is an empty one and scores as the corpus's mean vector; a null doc_id is kept and is not held out;
repeated rows each give a row; an empty table gives none; rows without a label, or with a null one, teach nothing; of
several labels of one document the mean counts, rounded down; without labels of both kinds every score is the share of
label 1, or 0.5 with none; further columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import bpe, common

BITS = 14  # 2 ** BITS buckets of words
DIMENSIONS = 64
NONZERO = 4
REACH = 2
THRESHOLD = 0.3
PRIOR = 12
BATCH = 4_000_000  # bytes of text that are held as words at once
MOST_LABELLED = 20_000  # labelled documents that the network is fitted on, at most

_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - BITS)


SAME = bucket("<same>")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each bucket's index vector."""
    random = np.random.default_rng(20_240_501)
    places = np.argsort(random.random((1 << BITS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), random.choice(np.array([-1.0, 1.0]), (1 << BITS, NONZERO))


def _buckets(chunk: str) -> list[int]:
    """The words of a chunk without white space, and marks for what they look like."""
    out = []
    for part in _PARTS.findall(chunk):
        c = part[0]
        if c.isalpha():
            out.append(bucket(part.lower()))
            if len(part) > 1 and part.isupper():
                out.append(bucket("<upper>"))
        elif c.isdigit():
            out.append(bucket(f"<digits {min(len(part), 4)}>"))
        else:
            out += [bucket(f"<sign {c}>"), *([bucket("<signs>")] if len(part) > 1 else [])]
    return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' words, flat, and the texts' offsets."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    each = [_buckets(c) for c in coded.dictionary.to_pylist()]
    size = np.array([len(e) for e in each], np.int64)
    flat = np.array([b for e in each for b in e], np.int32)
    index = coded.indices.to_numpy().astype(np.int64)
    at = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    again = np.zeros(len(index), bool)
    again[1:] = index[1:] == index[:-1]
    again[at[:-1][at[:-1] < len(index)]] = False
    # a chunk that repeats the one before it is read from a copy that ends with the mark
    starts = np.cumsum(size) - size
    out, n = bpe.gather(flat, starts, size, index)
    if again.any():
        ends = np.cumsum(n)[again]
        out = np.insert(out, ends, SAME)
        n = n + again
    return out, np.r_[0, np.cumsum(n)][at]


class ContextSums:
    """Sums of the index vectors of each bucket's neighbours, and how often each bucket occurs."""

    def __init__(self):
        self.places, self.signs = index_vectors()
        self.sums, self.seen = np.zeros((1 << BITS) * DIMENSIONS), np.zeros(1 << BITS, np.int64)

    def add(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        self.seen += np.bincount(flat, minlength=1 << BITS)
        document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        keys = []
        for reach in range(1, REACH + 1):
            same = document[reach:] == document[:-reach]
            a, b = flat[:-reach][same].astype(np.int64), flat[reach:][same].astype(np.int64)
            keys += [a << BITS | b, b << BITS | a]
        if not keys or not sum(map(len, keys)):
            return
        pair, times = np.unique(np.concatenate(keys), return_counts=True)
        word, near = pair >> BITS, pair & ((1 << BITS) - 1)
        for k in range(NONZERO):
            self.sums += np.bincount(word * DIMENSIONS + self.places[near, k], self.signs[near, k] * times, len(self.sums))


SUMS = pa.schema([("bucket", pa.int32()), ("seen", pa.int64()), ("sums", pa.list_(pa.float32()))])


def word_vectors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """A unit vector for each bucket, from all documents, and last the corpus's mean; the size is fixed by the parameters above."""

    @common.no_cycles
    def run(batches):
        held = ContextSums()
        for batch in bpe.by_size(batches, BATCH):
            held.add(*words(bpe.texts_of(batch)))
        used = np.flatnonzero(held.seen)
        for part in np.array_split(used, max(1, len(used) // 4096)):
            rows = held.sums.reshape(-1, DIMENSIONS)[part].astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, DIMENSIONS, dtype=np.int32), rows.ravel())
            yield common.record_batch(SUMS, {"bucket": part, "seen": held.seen[part], "sums": lists})

    partial = common.id_and_text(docs, id_col, text_col).select("text").mapInArrow(run, common.spark_schema(SUMS))
    total = partial.groupBy("bucket").agg(F.sum("seen").alias("seen"), F.array(*[F.sum(F.col("sums")[k].cast("double")) for k in range(DIMENSIONS)]).alias("sums"))
    sums, seen = np.zeros((1 << BITS, DIMENSIONS), np.float32), np.zeros(1 << BITS)
    for batch in total.select("bucket", "seen", F.transform("sums", lambda x: x.cast("float")).alias("sums")).toArrow().to_batches():
        if batch.num_rows:
            at = batch.column("bucket").to_numpy()
            sums[at], seen[at] = batch.column("sums").flatten().to_numpy().reshape(-1, DIMENSIONS), batch.column("seen").to_numpy()
    return unit_vectors(sums, seen)


def unit_vectors(sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
    return np.concatenate([vectors, [seen @ vectors / max(1.0, seen.sum())]]).astype(np.float32)


def pool(vectors: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean vector of each document's words and of ``PRIOR`` average words of the corpus, which steady short texts."""
    out = np.repeat(vectors[-1:].astype(float), len(offsets) - 1, axis=0)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a < b:
            bucket_, times = np.unique(flat[a:b], return_counts=True)
            out[i] = (times @ vectors[bucket_] + PRIOR * vectors[-1]) / (b - a + PRIOR)
    return out


class Network:
    """Inputs, scaled -> tanh units -> one logit; fitted by Adam, then calibrated by a temperature."""

    def __init__(self, hidden: int = 32, rounds: int = 60, decay: float = 1e-4, seed: int = 7):
        self.hidden, self.rounds, self.decay, self.seed, self.constant = hidden, rounds, decay, seed, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        random = np.random.default_rng(self.seed)
        order = random.permutation(len(y))
        kept = max(1, len(y) // 5)
        if len(set(y[order[:kept]].tolist())) < 2:
            kept = 0
        own, apart = order[kept:], order[:kept] if kept else order
        self.mean, self.scale = x[own].mean(0), x[own].std(0) + 1e-9
        z = self._scaled(x)
        w = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), random.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        first, second, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for epoch in range(self.rounds):
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / self.rounds)) + 1e-4
            for part in np.array_split(random.permutation(own), max(1, len(own) // 256)):
                h = np.tanh(z[part] @ w[0] + w[1])
                error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y[part]) / len(part)
                back = np.outer(error, w[2]) * (1 - h * h)
                slopes = [z[part].T @ back + self.decay * w[0], back.sum(0), h.T @ error + self.decay * w[2], error.sum(keepdims=True)]
                t += 1
                for p, g, m, v in zip(w, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        logit, target = self.logit(x[apart]), y[apart]
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 121))
        loss = [np.logaddexp(0, np.where(target > 0, -logit, logit) / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(self._scaled(x) @ w[0] + w[1]) @ w[2] + w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def held_out(doc_id) -> F.Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


POOLED = pa.schema([("pooled", pa.list_(pa.float32())), ("quality", pa.int32())])


def fit(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors from all documents and a network from at most ``most`` labelled ones, those with the least hashes."""
    spark = docs.sparkSession
    vectors = word_vectors(docs, id_col=id_col, text_col=text_col)
    shared = spark.sparkContext.broadcast(vectors)  # 2 ** BITS x DIMENSIONS float32: 4 MB
    marks = labels.select(labels["doc_id"].alias("label_id"), labels["quality"].alias("quality")).where("label_id IS NOT NULL AND quality IS NOT NULL").where(~held_out("label_id"))
    marks = marks.groupBy("label_id").agg(F.floor(F.avg("quality")).cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    known = common.id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")

    @common.no_cycles
    def run(batches):
        for batch in bpe.by_size(batches, BATCH):
            x = pool(shared.value, *words(bpe.texts_of(batch))).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, DIMENSIONS, dtype=np.int32), x.ravel())
            yield common.record_batch(POOLED, {"pooled": lists, "quality": batch.column("quality")})

    found = known.mapInArrow(run, "pooled array<float>, quality int").toArrow().combine_chunks()
    y = found.column("quality").to_numpy().astype(float)
    x = found.column("pooled").combine_chunks().flatten().to_numpy().astype(float).reshape(len(y), DIMENSIONS) if len(y) else np.zeros((0, DIMENSIONS))
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # the same network whatever the order of rows
    return vectors, Network().fit(x[order], y[order])


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, vectors: np.ndarray, network: Network, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of label 1, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    @common.no_cycles
    def run(batches):
        vectors, network = shared.value
        for batch in bpe.by_size(batches, BATCH):
            x = pool(vectors, *words(bpe.texts_of(batch)))
            yield common.record_batch(SCORED, {"doc_id": batch.column("doc_id"), "score": network.probability(x)})

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, common.spark_schema(SCORED))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns."""
    common.small_batches(spark)
    vectors, network = fit(docs, common.table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast((vectors, network))
    names = docs.columns

    @common.no_cycles
    def run(batches):
        vectors, network = shared.value
        for batch in bpe.by_size(batches, BATCH):
            x = pool(vectors, *words(bpe.texts_of(batch)))
            yield batch.filter(pa.array(network.probability(x) >= THRESHOLD))

    return docs.select(names).mapInArrow(run, docs.schema)
