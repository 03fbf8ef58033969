"""Byte-pair merging over length-bucketed, padded numpy matrices, and byte-level encoding and decoding on it.

Words of similar length share a matrix, one word a row. In each round every row merges its leftmost pair of
least rank: the ranks of adjacent pairs are kept beside the ids, the place is an argmin by row, and both
matrices are compacted by one column. Only the two pairs that a merge makes are looked up, in an open-addressed
hash table held in numpy arrays. Rows without a pair to merge leave the matrix. Words beyond ``LONG`` bytes
are merged with a heap, which gives the same ids in n log n steps.

Defined cases: a null text is an empty one, an empty text has no ids; a null doc_id is kept; repeated rows each
give a row; an empty table gives none; further columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import common

NEVER = np.int32(2**31 - 1)
LONG = 256
STEP = 8  # matrices are this much wider from one bucket to the next


class PairTable:
    """(left id, right id) -> (rank, merged id), looked up for whole arrays."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(left)) * 5))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank, self.merged = np.full(size, NEVER), np.zeros(size, np.int32)
        key = (left << np.uint64(32)) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]] = key[todo[put]]
            self.rank[at[put]] = np.asarray(rank)[todo[put]]
            self.merged[at[put]] = np.asarray(merged)[todo[put]]
            todo = todo[~put]
            slot[todo] = np.where(self.keys[slot[todo]] == np.uint64(2**64 - 1), slot[todo], (slot[todo] + 1) & (size - 1))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NEVER where there is none. Negative ids are padding."""
        key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(2**32 - 1))
        slot = self._slot(key)
        found = self.keys[slot]
        odd = np.flatnonzero((found != key) & (found != np.uint64(2**64 - 1)))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & (len(self.keys) - 1)
            found[odd] = self.keys[slot[odd]]
            odd = odd[(found[odd] != key[odd]) & (found[odd] != np.uint64(2**64 - 1))]
        hit = (found == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[slot], NEVER), self.merged[slot]


class Merger:
    def __init__(self, pairs: PairTable):
        self.pairs = pairs
        self._known: dict | None = None

    def merge(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' first ids, flat, and where they begin -> flat ids, each word's start there and its length."""
        lengths = np.diff(offsets)
        starts, sizes, flats, base = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [], 0
        bucket = np.where(lengths > LONG, -1, -(-lengths // STEP))
        for b in np.unique(bucket):
            rows = np.flatnonzero(bucket == b)
            if b == -1:
                done = [self._by_heap(ids[offsets[r] : offsets[r + 1]].tolist()) for r in rows]
                size, flat = np.array([len(x) for x in done]), np.array(list(itertools.chain.from_iterable(done)), np.int32)
            elif b == 0:
                continue
            else:
                width = int(b) * STEP
                column = np.arange(width)
                inside = column < lengths[rows][:, None]
                matrix = np.full((len(rows), width), -1, np.int32)
                matrix[inside] = ids[(offsets[rows][:, None] + column)[inside]]
                size = self._rounds(matrix, lengths[rows].copy())
                flat = matrix[column < size[:, None]]
            starts[rows] = base + np.cumsum(size) - size
            sizes[rows] = size
            flats.append(flat)
            base += len(flat)
        return np.concatenate(flats) if flats else np.zeros(0, np.int32), starts, sizes

    def _rounds(self, result: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merges in place; gives each row's new length."""
        row, m = np.arange(len(result)), result.copy()
        if m.shape[1] < 2:
            return size
        rank, made = (x.reshape(len(m), -1) for x in self.pairs.find(m[:, :-1].ravel(), m[:, 1:].ravel()))
        while True:
            at = rank.argmin(1)
            go = rank[np.arange(len(m)), at] != NEVER
            if not go.all():
                ended = row[~go]
                result[ended, : m.shape[1]] = m[~go]
                row, m, rank, made, at = row[go], m[go], rank[go], made[go], at[go]
            if not len(row):
                return size
            each = np.arange(len(m))
            m[each, at] = made[each, at]
            size[row] -= 1
            keep = np.ones(m.shape, bool)
            keep[each, at + 1] = False
            m = m[keep].reshape(len(m), -1)
            if m.shape[1] < 2:
                result[row, :1] = m
                return size
            keep = np.ones(rank.shape, bool)
            keep[each, at] = False
            rank, made = rank[keep].reshape(len(m), -1), made[keep].reshape(len(m), -1)
            for who, pair in ((np.flatnonzero(at > 0), -1), (np.flatnonzero(at < rank.shape[1]), 0)):
                p = at[who] + pair
                rank[who, p], made[who, p] = self.pairs.find(m[who, p], m[who, p + 1])

    def _by_heap(self, ids: list[int]) -> list[int]:
        if self._known is None:
            t = self.pairs
            full = np.flatnonzero(t.keys != np.uint64(2**64 - 1))
            self._known = dict(zip(t.keys[full].tolist(), zip(t.rank[full].tolist(), t.merged[full].tolist(), strict=True), strict=True))
        known, n = self._known, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*known[k], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in known]
        heap = [(r, i, a, b, made) for r, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (found := known.get(ids[left] << 32 | ids[right])):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return [x for x in ids if x >= 0]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the index one after another, and the length of each."""
    n = sizes[index]
    total = np.cumsum(n)
    return flat[np.repeat(starts[index] - (total - n), n) + np.arange(total[-1] if len(total) else 0)], n


def in_documents(chunks: pa.Array, split, merge) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists of chunks, flat, with the offset of each list. Equal chunks are split, and equal words merged, once.

    split: distinct chunks -> all their words, dictionary-encoded, and each chunk's number of words.
    """
    coded = chunks.flatten().dictionary_encode()
    words, many = split(coded.dictionary)
    flat, starts, sizes = merge(words.dictionary)
    per_word, n = gather(flat, starts, sizes, words.indices.to_numpy())
    ends = np.r_[0, np.cumsum(n)]
    last = np.cumsum(many)
    chunk_start, chunk_size = ends[last - many], ends[last] - ends[last - many]
    ids, n = gather(per_word, chunk_start, chunk_size, coded.indices.to_numpy())
    lists = np.asarray(chunks.offsets) - chunks.offsets[0].as_py()
    return ids, np.r_[0, np.cumsum(n)][lists]


def utf8(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and their offsets."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]] if len(at) else data[:0], (at - at[0]) if len(at) else np.zeros(1, np.int64)


class ByteLevel:
    """Encoding by a table of ranks, each match of a pattern for itself, and decoding."""

    #: Whitespace where a chunk's end could change the match, and what isn't split at all.
    RUNS = r"[ \n]{3}|[ \n]{2}\z|[\x00-\x09\x0B-\x1F\x7F-\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, made = np.array(pairs, np.int64).T
        self.merger = Merger(PairTable(left, right, made.astype(np.int32), made.astype(np.int32)))
        self.whole = ranks

    def chunks(self, texts: pa.Array) -> pa.Array:
        """Each text as parts that match for themselves as they do in the text."""
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
        lists = pc.split_pattern(marked, "\x01")
        odd = pc.match_substring_regex(texts, self.RUNS).to_numpy(zero_copy_only=False)
        if not odd.any():
            return lists
        plain = lists.to_pylist()
        for i in np.flatnonzero(odd):
            plain[i] = self.pattern.findall(texts[i].as_py())
        return pa.array(plain, pa.list_(pa.string()))

    def _split(self, chunks: pa.Array):
        words = [self.pattern.findall(c) for c in chunks.to_pylist()]
        flat = pa.array(list(itertools.chain.from_iterable(words)), pa.string())
        return flat.dictionary_encode(), np.array([len(w) for w in words], np.int64)

    def _merge(self, words: pa.Array):
        data, offsets = utf8(words)
        return self.merger.merge(self.first[data], offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the texts' offsets."""
        return in_documents(self.chunks(texts), self._split, self._merge)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column("text"), "")


def by_size(batches, most: int = 16_000_000):
    """Batches cut where their texts have more bytes than this (one text may have more)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in itertools.pairwise(edges):
            yield batch.slice(a, b - a)


def encode_decode(docs: DataFrame, *, ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the bytes that these decode to."""

    @common.no_cycles
    def run(batches):
        import public_tokenizers

        coder = ByteLevel(common.tokenizer_path(ranks), pattern or public_tokenizers.PATTERN)
        for batch in by_size(batches):
            ids, at = coder.encode(texts_of(batch))
            each = [ids[a:b] for a, b in itertools.pairwise(at.tolist())]
            yield common.record_batch(ENCODED, {"doc_id": batch.column("doc_id"), "n_tokens": np.diff(at), "ids": [x.astype("<u4").tobytes() for x in each], "decoded": [coder.decode(x) for x in each]})

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, common.spark_schema(ENCODED))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(common.table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
