"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: for every string of up to ``ORDER`` bytes how often each byte follows it. A text's
code length in a language is what an arithmetic coder would need with that tree frozen: a byte is coded in the longest context
that the tree has; where it didn't follow there, an escape is coded and the next shorter context is tried, in which the bytes
seen in the longer one are excluded; at last all bytes left are alike. The least code length names the language.

Counts come from all learning rows. A task counts strings in sorted arrays, Spark adds the counts up; no text is shuffled. A
string stays in its language's tree if at least one in ``SHARES`` / languages of the language's bytes ends in it: so the
tree is bounded, whatever the corpus, by (ORDER + 1) x SHARES strings for all languages, and the rule is the same at every size. What
isn't kept counts as escapes. As the statistics are frozen, escapes and exclusions are compiled beforehand into two numbers a
string and language: the code length of a byte is ``a[longest known string before it] - v[longest known string that
ends in it]``, in each language. A text is then one search for its longest known strings and sums over them.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is each one if nothing could be learnt; equal
code lengths go to the language first in order; rows without text or language teach nothing; a null id counts as the empty
text in the choice of learning rows; repeated rows count as often as they are there; an empty table gives no rows; further columns
are ignored. Whole texts are read, long ones in blocks.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import common

ORDER = 4
SHARES = 1 << 17
LANGUAGES = 64  # more would make the table of all trees too wide
BLOCK = 1 << 20  # bytes at once
COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
SCORED = "doc_id bigint, lang_pred string, score double, bits double"
_LETTER = re.compile(r"[^\W\d_]")


def remainder(id_col: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo."""
    x = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(x.cast("string"), F.lit("")).cast("binary")) % of


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


def windows(texts: list[bytes], order: int = ORDER, block: int = BLOCK):
    """Blocks of texts end to end: (which text each run belongs to, where runs start, keys, how many bytes each key may use).

    A key holds the last order + 1 bytes, the newest in the highest place; near a text's start fewer of them count.
    A run that goes on with a text from the block before keeps its full context.
    """
    runs, size = [], 0

    def close():
        data = np.frombuffer(b"".join(texts[i][max(0, at - order) : end] for i, at, end in runs), np.uint8)
        lead = np.array([min(at, order) for _, at, _ in runs])
        whole = np.array([end - at for _, at, end in runs]) + lead
        starts = np.cumsum(whole) - whole
        before = np.arange(len(data)) - np.repeat(starts, whole)
        keys = np.zeros(len(data), np.int64)
        for j in range(order + 1):
            keys[j:] |= data[: len(data) - j].astype(np.int64) << (8 * (order - j))
        known = np.minimum(before + 1, order + 1)
        own = before >= np.repeat(lead, whole)  # the others are only context
        sizes = whole - lead
        return np.array([i for i, *_ in runs]), np.cumsum(sizes) - sizes, keys[own], known[own]

    for i, text in enumerate(texts):
        for at in range(0, len(text), block):
            end = min(len(text), at + block)
            runs.append((i, at, end))
            size += end - at
            if size >= block:
                yield close()
                runs, size = [], 0
    if runs:
        yield close()


def count_strings(keys: np.ndarray, known: np.ndarray, order: int = ORDER):
    """(size, key, n) of all strings that end at a position; a string's key has its bytes alone, the newest highest."""
    full = np.sort(keys[known > order])
    rest, rest_known = keys[known <= order], known[known <= order]
    for size in range(1, order + 2):
        some = np.concatenate([full, np.sort(rest[rest_known >= size])]) >> (8 * (order + 1 - size))
        if not len(some):
            continue
        cut = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        yield size, some[cut], np.diff(np.append(cut, len(some)))


def counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, size, key and n over all rows (text, lang)."""

    def run(batches):
        held, size = {}, 0

        def flush():
            for lang, texts in held.items():
                for _, _, keys, known in windows(texts, order):
                    for k, found, n in count_strings(keys, known, order):
                        yield common.record_batch(COUNTS, {"lang": pa.array([lang] * len(found)), "size": pa.array(np.full(len(found), k, np.int32)), "key": pa.array(found), "n": pa.array(n)})

        for batch in common.slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                data = text.encode()
                held.setdefault(lang, []).append(data)
                size += len(data)
                if size >= 4 * BLOCK:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    parts = rows.select("text", "lang").where("text <> '' AND lang IS NOT NULL").mapInArrow(run, common.spark_schema(COUNTS))
    return parts.groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def trees(counted: DataFrame, order: int = ORDER, shares: int = SHARES) -> tuple[list[str], pa.Table]:
    """The languages in order, and their kept strings: lang, size, key, n, and of what follows each how often and how many bytes."""
    totals = {r["lang"]: r["n"] for r in counted.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    names = sorted(totals)
    if not names:
        return names, None
    total = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in totals.items()))
    kept = counted.where(F.col("n") * F.lit(shares // len(names)) >= total[F.col("lang")])
    # what a string is without its newest byte
    before = F.expr("key & (shiftleft(1L, 8 * (size - 1)) - 1)")
    follow = counted.groupBy("lang", (F.col("size") - 1).alias("size"), before.alias("key")).agg(F.sum("n").alias("after"), F.count("*").alias("kinds"))
    root = follow.where("size = 0").select("lang", "size", "key", F.col("after").alias("n"), "after", "kinds")
    inner = kept.join(follow.where("size > 0"), ["lang", "size", "key"], "left").select("lang", "size", "key", "n", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
    return names, inner.unionByName(root).toArrow()


class Model:
    """Compiled trees: ``a`` and ``v`` by string and language, and a hash table from strings to their rows; row 0 is no string."""

    def __init__(self, names: list[str], table: pa.Table | None, order: int = ORDER):
        self.names, self.order = names, order
        if not names:
            return
        lang = np.searchsorted(np.array(names), np.array(table["lang"].to_pylist()))
        size, key, n, after, kinds = (table[c].to_numpy() for c in ("size", "key", "n", "after", "kinds"))
        tag = (size.astype(np.int64) << 48) | key
        self.tags = np.unique(tag)  # by size, then key; the first is the empty string
        row, many = np.searchsorted(self.tags, tag), len(self.tags)
        sizes, keys = self.tags >> 48, self.tags & ((1 << 48) - 1)
        find = lambda k, x: np.searchsorted(self.tags, (k << 48) | x)
        older = find(np.maximum(sizes - 1, 0), np.where(sizes > 0, keys >> 8, 0))  # without the oldest byte
        context = find(np.maximum(sizes - 1, 0), np.where(sizes > 0, keys & ((1 << (8 * np.maximum(sizes - 1, 0))) - 1), 0))  # without the newest
        self.a, self.v = np.zeros((many, len(names))), np.zeros((many, len(names)))
        for i in range(len(names)):
            own = lang == i
            has = np.zeros(many, bool)
            seen, follow, alike = (np.zeros(many, np.int64) for _ in range(3))
            has[row[own]], seen[row[own]], follow[row[own]], alike[row[own]] = True, n[own], after[own], kinds[own]
            strings = np.flatnonzero(has & (sizes > 0))
            stay, shorter = np.zeros(many, np.int64), np.zeros(many, np.int64)
            np.add.at(stay, context[strings], seen[strings])  # of what follows, what is kept
            np.add.at(shorter, context[strings], np.where(sizes[strings] > 1, seen[older[strings]], 0))  # the same bytes after the context without its oldest byte
            escape = alike + follow - stay
            whole = follow + alike
            w, a, v = np.zeros(many), np.zeros(many), np.zeros(many)
            left = 256 - np.count_nonzero(has & (sizes == 1))
            w[0] = (np.log(left) if left else 0.0) - np.log(escape[0])
            a[0] = np.log(whole[0]) + w[0]
            for k in range(1, order + 2):
                at = np.flatnonzero(sizes == k)
                a[at], v[at] = a[older[at]], v[older[at]]  # what isn't in this tree is as its longest end that is
                mine = at[has[at]]
                v[mine] = w[context[mine]] + np.log(seen[mine])
                more = mine[follow[mine] > 0] if k <= order else mine[:0]
                w[more] = w[older[more]] + np.log(whole[older[more]] - shorter[more]) - np.log(escape[more])
                a[more] = np.log(whole[more]) + w[more]
            self.a[:, i], self.v[:, i] = a, v
        self.gain = np.ascontiguousarray((self.a - self.v).T)
        self._hash()

    def _hash(self) -> None:
        bits = max(8, int(len(self.tags) * 4 - 1).bit_length())
        self.shift, table = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64)
        rows = np.zeros(1 << bits, np.int32)
        left, place = np.arange(len(self.tags)), self._place(self.tags)
        while len(left):
            free = table[place] < 0
            table[place[free]] = self.tags[left[free]]  # of several the last one wins
            put = table[place] == self.tags[left]
            rows[place[put]] = left[put]
            left, place = left[~put], (place[~put] + 1) & (len(table) - 1)
        self.table, self.rows = table, rows

    def _place(self, tags: np.ndarray) -> np.ndarray:
        return ((tags.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rows(self, tags: np.ndarray) -> np.ndarray:
        """The row of each string, -1 for those that no tree has."""
        place = self._place(tags)
        held = self.table[place]
        out = np.where(held == tags, self.rows[place], np.int32(-1))
        on = np.flatnonzero((held != tags) & (held >= 0))
        while len(on):
            place[on] = (place[on] + 1) & (len(self.table) - 1)
            held = self.table[place[on]]
            hit = held == tags[on]
            out[on[hit]] = self.rows[place[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def longest(self, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The row of the longest known string that ends at each position."""
        out = np.zeros(len(keys), np.int32)
        on = np.flatnonzero(known > self.order)
        for size in range(self.order + 1, 0, -1):
            found = self._rows((np.int64(size) << 48) | (keys[on] >> (8 * (self.order + 1 - size))))
            out[on] = np.maximum(found, 0)
            on = on[found < 0]
            if size > 1:
                on = np.concatenate([on, np.flatnonzero(known == size - 1)])
        return out

    def code_lengths(self, texts: list[bytes], block: int = BLOCK) -> np.ndarray:
        """The code length of each text in each language, in nats."""
        cost = np.zeros((len(texts), len(self.names)))
        last = np.zeros(len(texts), np.int64)
        for which, starts, keys, known in windows(texts, self.order, block):
            rows = self.longest(keys, known)
            for i in range(len(self.names)):
                np.add.at(cost[:, i], which, np.add.reduceat(self.gain[i][rows], starts))
            last[which] = rows[np.append(starts[1:], len(rows)) - 1]
        some = np.array([len(t) > 0 for t in texts], bool)
        cost[some] += self.a[0] - self.a[last[some]]  # each byte's context is the string before it: the first has none, the last is none's
        return cost


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, shares: int = SHARES) -> Model:
    """A model from all rows with text and language."""
    scratch = common.Scratch(docs.sparkSession, "languages")
    counted = scratch.keep(counts(docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")), order), "counts")
    model = Model(*trees(counted, order, shares), order)
    scratch.drop("counts")
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (its share by the code lengths) and bits (code length in that language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SHARES and LANGUAGES

    def run(batches):
        known = shared.value
        for batch in common.slices(batches):
            texts = batch.column("text").to_pylist()
            names, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if known.names and has_letter(t)]
            if some:
                cost = known.code_lengths([texts[i].encode() for i in some])
                best = cost.argmin(1)
                least = cost[np.arange(len(some)), best]
                score[some], bits[some] = 1 / np.exp(least[:, None] - cost).sum(1), least / np.log(2)
                for i, b in zip(some, best, strict=True):
                    names[i] = known.names[b]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(names, pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, SCORED)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from those whose remainder of 4 isn't 2."""
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs.where(remainder(docs["doc_id"], 4) != 2)))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
