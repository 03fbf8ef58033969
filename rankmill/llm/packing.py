"""Packing by Karmarkar-Karp multiway differencing.

``pack`` tokenises documents, cuts them into pieces of at most a capacity and puts the pieces into windows.
Every input partition packs what it reads, in groups of ``group_docs`` documents, or fewer where these have ``group_tokens``
tokens or more: nothing is shuffled, and no
task holds more than one group. Input in more partitions than it has groups, by documents and by bytes, is read in fewer, so that few groups are small. A group of T tokens gets ceil(T / capacity) windows; partial partitions with
opposing imbalances are merged until one remains, and while its fullest window exceeds the capacity the
differencing is run again with one window more.

Defined cases: a null text is an empty one; an empty text has its end id alone; a null doc_id is kept; repeated
rows are packed each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import bpe, common

CAPACITY = 4096
END_ID = 2
TOKEN_BYTES = 3  # of text, about
SMALL = 2 << 20  # bytes of text that make windows enough for one of them, half empty, not to matter
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\n]+|\n")
_BEYOND = r"[^\t\n\r\x20-\x7E\x{A1}-\x{FF}]"  # what isn't printable Latin-1


class WordEncoder:
    """Ids of a lower-casing BPE with word ends, as the tokenizers library gives them.

    Words are independent there, so each distinct word of a batch is merged once, by the matrices of ``bpe``.
    Texts beyond Latin-1, or with special tokens in them, go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        with open(path, encoding="utf-8") as f:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(f)["model"]["merges"]]
        left, right, made = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).T
        self.merger = bpe.Merger(bpe.PairTable(left, right, np.arange(len(merges), dtype=np.int32), made.astype(np.int32)))
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.first, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c in map(chr, range(256)):
            for byte, sign in zip(c.encode(), split.pre_tokenize_str(c)[0][0], strict=True):
                self.first[byte], self.last[byte] = vocab[sign], vocab[sign + "</w>"]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    @staticmethod
    def _split(chunks: pa.Array):
        words = _WORDS.findall("\n".join(chunks.to_pylist()))
        flat = pa.array([*words, "\n"] if len(chunks) else [], pa.string())
        ends = np.flatnonzero(pc.equal(flat, "\n").to_numpy(zero_copy_only=False))
        return flat.filter(pc.not_equal(flat, "\n")).dictionary_encode(), np.diff(np.r_[-1, ends]) - 1

    def _merge(self, words: pa.Array):
        data, offsets = bpe.utf8(words)
        ids = self.first[data]
        ids[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        return self.merger.merge(ids, offsets)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        odd = pc.match_substring_regex(texts, _BEYOND)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        ids, at = bpe.in_documents(chunks, self._split, self._merge)
        data = ids.astype("<u4").tobytes()
        out = [data[4 * a : 4 * b] for a, b in itertools.pairwise(at.tolist())]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def difference(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """The window of each length, and the fullest window's load, after multiway differencing.

    A partial partition is a vector of loads, largest first. The two with the widest spread are merged, the
    largest load of one with the smallest of the other, until one is left.
    """
    n = len(lengths)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64), int(lengths.sum())
    heap: list[tuple[int, int]] = []
    nodes: list[tuple] = []
    loads: dict[int, np.ndarray] = {}
    for i, x in enumerate(lengths.tolist()):
        nodes.append((i,))
        heap.append((-x, i))
    heapq.heapify(heap)
    single = lengths.astype(np.int64)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        if a in loads:
            total = loads.pop(a).copy()
        else:
            total = np.zeros(windows, np.int64)
            total[0] = single[a]
        if b in loads:
            total += loads.pop(b)[::-1]
        else:
            total[-1] += single[b]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        nodes.append((a, b, order))
        loads[len(nodes) - 1] = total
        heapq.heappush(heap, (int(total[-1] - total[0]), len(nodes) - 1))
    root = heap[0][1]
    fullest = int(loads[root][0]) if root in loads else int(single[root])
    window = np.empty(n, np.int64)
    todo: list[tuple[int, np.ndarray | None]] = [(root, np.arange(windows))]
    while todo:
        node, slot = todo.pop()  # slot: the final window of each of the node's places
        if len(nodes[node]) == 1:
            window[node] = slot[0]
            continue
        a, b, order = nodes[node]
        below = np.empty(windows, np.int64)
        below[order] = slot
        todo += [(a, below), (b, below[::-1])]
    return window, fullest


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset there of each piece; no window holds more than the capacity."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and int(lengths.max()) > capacity:
        raise ValueError("a piece is longer than a window")
    windows = max(1, -(-int(lengths.sum()) // capacity))
    window, fullest = difference(lengths, windows)
    while fullest > capacity:
        windows += 1
        window, fullest = difference(lengths, windows)
    order = np.argsort(window, kind="stable")
    w, x = window[order], lengths[order]
    before = np.cumsum(x) - x
    first = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, before, 0)) if len(w) else before
    offset = np.empty(len(w), np.int64)
    offset[order] = before - base
    return window, offset


def cut(tokens: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """Pieces of a document: whole windows first, then its rest in pieces of at most ``grain``."""
    whole = tokens // capacity * capacity
    return [(s, capacity) for s in range(0, whole, capacity)] + [(s, min(grain, tokens - s)) for s in range(whole, tokens, grain)]


def tasks(rows: DataFrame, group_docs: int, group_tokens: int) -> int:
    """In how many tasks to pack: as many as there are groups. Only where there are fewer of ``group_docs`` documents than
    cores the texts' bytes are summed, and few but long texts still make use of each core."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    by_count = rows.count() // group_docs
    if by_count >= cores:
        return by_count
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, by_count, size // (group_tokens * TOKEN_BYTES), min(cores, size // SMALL))


def pack(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = 800, group_tokens: int = 4_000_000, grain: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, its ids as little-endian unsigned 32-bit integers."""

    @common.no_cycles
    def run(batches):
        encoder = WordEncoder(common.tokenizer_path(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        base, sequence = TaskContext.get().partitionId() << 36, 0

        def groups():
            held: list[tuple] = []
            size = 0
            for batch in bpe.by_size(batches):
                for doc, data in zip(batch.column("doc_id").to_pylist(), encoder.encode(bpe.texts_of(batch)), strict=True):
                    held.append((doc, data))
                    size += len(data) // 4
                    if len(held) >= group_docs or size >= group_tokens:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for group in groups():
            rows = []
            for doc, data in group:
                data += end
                tokens = len(data) // 4
                rows += [(doc, s, n, tokens, data[4 * s : 4 * (s + n)]) for s, n in cut(tokens, capacity, grain)]
            full = np.array([r[2] == capacity for r in rows])
            lengths = np.array([r[2] for r in rows], np.int64)
            window, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            window[full] = np.arange(full.sum())
            if (~full).any():
                window[~full], offset[~full] = pack_lengths(lengths[~full], capacity)
                window[~full] += full.sum()
            columns = dict(zip(("doc_id", "start", "length", "doc_tokens", "ids"), map(list, zip(*rows, strict=True)), strict=True))
            columns |= {"sequence_id": base + sequence + window, "offset": offset}
            sequence += int(window.max()) + 1
            yield common.record_batch(SCHEMA, columns)

    rows = common.id_and_text(docs, id_col, text_col)
    return rows.coalesce(tasks(rows, group_docs, group_tokens)).mapInArrow(run, common.spark_schema(SCHEMA))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
