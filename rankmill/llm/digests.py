"""Document fingerprints: quartile bucket digests.

Every window of five bytes counts three of its byte triplets in 128 buckets. A fingerprint has, as hexadecimal digits,
a check byte, the length on a logarithmic scale, the ratios of the counts' quartiles, and two bits for each bucket: the
quartile that its count lies in. Two fingerprints differ by the sum of their bucket, length and ratio differences,
bounded by ``BOUND``; likeness is 1 less the share of that bound.

``fingerprint_pairs`` also fingerprints each text with its second half replaced by the beginning of the next document's.
Documents are dealt into ranges of ids, compressed; the first document of a range also goes to the range before it, so
each range is streamed for itself and no task sees more than a range.

Defined cases: a null text is an empty one; texts under five bytes have all counts zero but for their own bytes' triplets
(none under three bytes) and equal texts equal fingerprints; a null doc_id comes first in the order; rows with one doc_id
are ordered by their text's hash; a single document is its own next one; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import bpe, common

BUCKETS = 128
BOUND = 240
#: The places of the triplets in a window of five bytes, and the odd factors of their hashes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
FACTORS = ((0x9E3B, 0x85EB, 0xC2B3), (0x27D5, 0x1657, 0xB55B), (0x2C1B, 0x297B, 0x7F4B))


def counts(data: np.ndarray) -> np.ndarray:
    """Triplets by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    n = len(data)
    wide = data.astype(np.uint32)
    for places, factors in zip(TRIPLETS, FACTORS, strict=True):
        m = n - places[2]
        if m <= 0:
            continue
        h = wide[:m] * np.uint32(factors[0] * 0x10001)
        h += wide[places[1] : places[1] + m] * np.uint32(factors[1] * 0x101)
        h ^= wide[places[2] : places[2] + m] * np.uint32(factors[2] * 0x1001)
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(25)
        total += np.bincount(h, minlength=BUCKETS)
    return total


def digest(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    c = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), 1 << 20):  # windows that begin here
        part = data[at : at + (1 << 20) + 4]
        c += counts(part) - (counts(part[1 << 20 :]) if len(part) > 1 << 20 else 0)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    code = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = (code[0::4] << 6 | code[1::4] << 4 | code[2::4] << 2 | code[3::4]).astype(np.uint8)
    length = min(255, int(8 * math.log2(len(raw) + 1)))
    ratios = (q1 * 15 // q3 if q3 else 0) << 4 | (q2 * 15 // q3 if q3 else 0)
    return bytes([hashlib.blake2b(raw, digest_size=1).digest()[0], length, ratios]).hex() + packed.tobytes().hex()


_QUARTER = np.array([[(b >> s) & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.int16)
_COST = np.array([0, 1, 2, 6], np.int64)


def difference(a: str, b: str) -> int:
    """From 0 for equal fingerprints to BOUND."""
    if a == b:
        return 0
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    body = int(_COST[np.abs(_QUARTER[x[3:]] - _QUARTER[y[3:]])].sum())
    length = max(0, abs(int(x[1]) - int(y[1])) - 1)
    ratios = sum(max(0, abs((int(x[2]) >> s & 15) - (int(y[2]) >> s & 15)) - 1) for s in (4, 0))
    return min(BOUND, body + min(24, length) + 2 * ratios + int(x[0] != y[0]))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            texts = bpe.texts_of(batch).to_pylist()
            yield common.record_batch(schema, {"doc_id": batch.column("doc_id"), "n_chars": [len(t) for t in texts], "fingerprint": [digest(t) for t in texts]})

    return common.map_arrow(common.id_and_text(docs, id_col, text_col), run, schema)


PAIRED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited", pa.string())])
_LEAST = -(2**63)


def fingerprint_pairs(docs: DataFrame, *, ranges: int | None = None, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to the edited and to the next one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * parts
    rows = common.id_and_text(docs, id_col, text_col).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_LEAST)).alias("place"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    )
    edges = sorted({int(x) for x in rows.select(F.col("place").cast("double")).approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.25 / ranges)})
    bounds = np.array(edges, np.int64)
    keys = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("tie", pa.int64())])

    def least(batches):
        for batch in batches:
            place, tie = (batch.column(c).to_numpy() for c in ("place", "tie"))
            part = np.searchsorted(bounds, place, side="right")
            order = np.lexsort((tie, place))
            at = order[np.unique(part[order], return_index=True)[1]]
            yield common.record_batch(keys, {"part": part[at], "place": place[at], "tie": tie[at]})

    # one small row per range: the key of the first row of each
    keyed = rows.select("place", "tie").mapInArrow(least, common.spark_schema(keys))
    first = sorted((r["part"], r["k"]["place"], r["k"]["tie"]) for r in keyed.groupBy("part").agg(F.min(F.struct("place", "tie")).alias("k")).collect())
    before = {(place, tie): first[i - 1][0] for i, (_, place, tie) in enumerate(first)}  # the last range's next row is the first of all
    moved = pa.schema([("part", pa.int32()), ("guest", pa.int32()), ("place", pa.int64()), ("tie", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])

    def deal(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            place, tie = (batch.column(c).to_pylist() for c in ("place", "tie"))
            part = np.searchsorted(bounds, batch.column("place").to_numpy(), side="right").tolist()
            packed = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            out = list(zip(part, [0] * len(part), place, tie, batch.column("doc_id").to_pylist(), packed, strict=True))
            out += [(before[r[2], r[3]], 1, *r[2:]) for r in out if (r[2], r[3]) in before]
            yield common.record_batch(moved, dict(zip(moved.names, map(list, zip(*out, strict=True)), strict=True)))

    def run(batches):
        press = zstandard.ZstdDecompressor()

        def stream():
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "packed")), strict=True):
                    text = press.decompress(r[3]).decode("utf-8", "surrogatepass")
                    yield r[0], r[1], r[2], text, digest(text)

        out = []
        held = None
        for row in stream():
            if held is not None and held[0] == row[0] and not held[1]:
                new = edited(held[3], row[3])
                mark = held[4] if new == held[3] else digest(new)
                out.append((held[2], len(held[3]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[4], mark, likeness(held[4], mark), likeness(held[4], row[4]), new if keep_text else None))
                if len(out) >= 256:
                    yield common.record_batch(PAIRED, dict(zip(PAIRED.names, map(list, zip(*out, strict=True)), strict=True)))
                    out = []
            held = row
        if out:
            yield common.record_batch(PAIRED, dict(zip(PAIRED.names, map(list, zip(*out, strict=True)), strict=True)))

    dealt = common.map_arrow(rows, deal, moved)
    sorted_ = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", "place", "tie").select("part", "guest", "doc_id", "packed")
    return common.map_arrow(sorted_, run, PAIRED)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(common.table(spark, sf_dir, "documents"), keep_text=False).drop("edited")
