"""Token counts from a prefix table.

For every prefix of a word the table holds the last piece of its encoding and its exact number of pieces. A prefix
ends with exactly one piece that stands, unmerged, beside the last piece of what comes before it; so one pass over a
word fills its table from the tables of its own shorter prefixes. No piece of the vocabulary holds a word break
after another character, so words are independent and a text's table is the words' tables end to end. From it come
the count of a text, of any of its prefixes, and the longest prefix within a budget, without encoding anything again.

Defined cases: a null text is an empty one; an empty text has no tokens; a null doc_id is kept; repeated rows each
give a row; an empty table gives none; further columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import bpe, common

BREAK = "▁"
LOOSE = 1 << 21  # a character that isn't a piece has this plus its code point for an id
NOTHING = 2 * LOOSE - 1
NEVER = float("-inf")
_UNITS = re.compile(f"{BREAK}+[^{BREAK}]*|[^{BREAK}]+")


class PrefixCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = model
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.piece = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.text_of = {i: p for p, i in self.piece.items()}
        self.score = {p: model.get_score(i) for p, i in self.piece.items()}
        self.ends: dict = {}  # pieces by their characters from the last to the first, their ids under ""
        for p, i in self.piece.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.stands = common.Memo(2_000_000, self._stands)
        self.words = common.Memo(500_000)
        self._arrays()
        if any(BREAK in p.lstrip(BREAK) for p in self.piece):
            raise ValueError("a piece holds a word break after another character: words aren't independent")

    def _arrays(self) -> None:
        """The tree of pieces, and what is known of pairs, as numpy arrays for ``tables``."""
        code = np.zeros(0x110000, np.int32)
        letters = sorted({c for p in self.piece for c in p})
        code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.code = code
        steps, made, todo = [], [-1], [(self.ends, 0)]
        while todo:
            node, k = todo.pop()
            for c, below in node.items():
                if c:
                    steps.append((k, code[ord(c)], len(made)))
                    todo.append((below, len(made)))
                    made.append(below.get("", -1))
        left, right, to = np.array(steps, np.int64).T
        self.steps = bpe.PairTable(left, right, np.zeros(len(to), np.int32), to.astype(np.int32))
        self.made = np.array(made, np.int64)
        self.pair, self.pair_stands = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _stand(self, pair: np.ndarray) -> np.ndarray:
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out, odd = self.pair_stands[slot], np.flatnonzero(self.pair[slot] != pair)
        if len(odd):
            new, back = np.unique(pair[odd], return_inverse=True)
            known = np.array([self.stands[x] for x in new.tolist()], bool)
            out[odd] = known[back]
            self.pair[slot[odd]], self.pair_stands[slot[odd]] = pair[odd], out[odd]
        return out

    def tables(self, points: np.ndarray) -> np.ndarray:
        """``table`` for many units of one length, a column each: code points by place -> counts by prefix."""
        width, n = points.shape
        code = self.code[points]
        counts, last = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), NOTHING * 2 * LOOSE, np.int64)
        for i in range(1, width + 1):
            row, state, found = np.arange(n), np.zeros(n, np.int32), []
            for k in range(i - 1, -1, -1):
                there, to = self.steps.find(state, code[k, row])
                go = there != bpe.NEVER
                row, state = row[go], to[go]
                if not len(row):
                    break
                end = self.made[state]
                held = end >= 0
                found.append((k, row[held], end[held]))
            loose = np.ones(n, bool)
            for k, row, end in reversed(found):
                open_ = loose[row]
                row, end = row[open_], end[open_]
                ok = self._stand(last[k, row] | end)
                row, end = row[ok], end[ok]
                last[i, row], counts[i, row], loose[row] = end * 2 * LOOSE, counts[k, row] + 1, False
            row = np.flatnonzero(loose)
            c = points[i - 1, row].astype(np.int64)
            last[i, row], counts[i, row] = (LOOSE + c) * 2 * LOOSE, counts[i - 1, row] + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        return counts

    def totals(self, units: list[str]) -> np.ndarray:
        """Number of tokens of each unit."""
        out, length = np.zeros(len(units), np.int64), np.array([len(u) for u in units], np.int64)
        for n in np.unique(length).tolist():
            who = np.flatnonzero(length == n)
            if n > 64 and len(who) < 20:
                out[who] = [self.table(units[i])[-1] for i in who]
                continue
            points = np.frombuffer("".join([units[i] for i in who]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(who), n)
            for at in range(0, len(who), 50_000):
                out[who[at : at + 50_000]] = self.tables(np.ascontiguousarray(points[at : at + 50_000].T))[-1]
        return out

    def _encode(self, text: str) -> list[str]:
        """Pieces by merging, again and again, the leftmost pair of best score."""
        parts = list(text)
        score = self.score.get
        pairs = [score(a + b, NEVER) for a, b in itertools.pairwise(parts)]
        while pairs and (best := max(pairs)) != NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def _text(self, i: int) -> str:
        return self.text_of[i] if i < LOOSE else chr(i - LOOSE)

    def _stands(self, pair: int) -> bool:
        """Whether the encoding of two pieces' text is just these two; with no piece before, of the second's."""
        a, b = divmod(pair, 2 * LOOSE)
        both = [self._text(b)] if a == NOTHING else [self._text(a), self._text(b)]
        return self._encode("".join(both)) == both

    def table(self, unit: str) -> list[int]:
        """Number of tokens of each prefix of a unit, from the empty one on."""
        n = len(unit)
        counts, last = [0] * (n + 1), [NOTHING * 2 * LOOSE] * (n + 1)
        stands, root = self.stands, self.ends
        for i in range(1, n + 1):
            node, k, found = root, i, []
            while k:
                node = node.get(unit[k - 1])
                if node is None:
                    break
                k -= 1
                if "" in node:
                    found.append((k, node[""]))
            for k, p in reversed(found):
                if stands[last[k] | p]:
                    last[i], counts[i] = p * 2 * LOOSE, counts[k] + 1
                    break
            else:  # a character of its own, as bytes
                c = unit[i - 1]
                last[i], counts[i] = (LOOSE + ord(c)) * 2 * LOOSE, counts[i - 1] + len(c.encode("utf-8", "surrogatepass"))
        return counts

    def units(self, texts: pa.Array) -> pa.Array:
        """Lists of units, each without the one break that it begins with; a unit that begins otherwise has U+0001 before it."""
        lists = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, f"  |[{BREAK}\x01]|\\A |\\A\\z").to_numpy(zero_copy_only=False)
        if not odd.any():
            return lists
        plain = lists.to_pylist()
        for i in np.flatnonzero(odd):
            plain[i] = ["\x01" + u for u in self.units_of(texts[int(i)].as_py())]
        return pa.array(plain, pa.list_(pa.string()))

    @staticmethod
    def units_of(text: str) -> list[str]:
        return _UNITS.findall(BREAK + text.replace(" ", BREAK)) if text else []

    def count(self, texts: pa.Array, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each text, and code points of its longest prefix with no more than ``limit`` tokens."""
        self.stands.trim()
        lists = self.units(texts)
        coded = lists.flatten().dictionary_encode()
        units = [u[1:] if u[:1] == "\x01" else BREAK + u for u in coded.dictionary.to_pylist()]
        index, at = coded.indices.to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        ends = np.r_[0, np.cumsum(self.known_totals(units)[index])] if units else np.zeros(1, np.int64)
        n, chars = np.diff(ends[at]), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        if limit is not None and (n > limit).any():
            length = np.array([len(u) for u in units], np.int64)
            for i in np.flatnonzero(n > limit):
                # the unit in which the limit is passed; those before it fit whole
                a, most = at[i], ends[at[i]] + limit
                k = int(np.searchsorted(ends, most, side="right")) - 1
                inside = max(j for j, c in enumerate(self.table(units[index[k]])) if ends[k] + c <= most)
                chars[i] = max(0, int(length[index[a:k]].sum()) + inside - 1)  # the first break isn't in the text
        return n, chars

    def known_totals(self, units: list[str]) -> np.ndarray:
        """``totals``, of which those of many words seen before are held."""
        self.words.trim()
        found = list(map(self.words.get, units))
        new = [i for i, n in enumerate(found) if n is None]
        for i, n in zip(new, self.totals([units[i] for i in new]).tolist(), strict=True):
            found[i] = self.words[units[i]] = n
        return np.array(found, np.int64)

    def prefixes(self, text: str) -> np.ndarray:
        """Number of tokens of each prefix of a text, by its code points, from the empty one on."""
        out, base = [0], 0
        for k, unit in enumerate(self.units_of(text)):
            counts = self.table(unit)
            out += [base + c for c in counts[2 if k == 0 else 1 :]]  # the first break isn't in the text
            base += counts[-1]
        return np.array(out, np.int32)

    def fits(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with no more tokens than the budget."""
        return int(self.count(pa.array([text], pa.string()), budget)[1][0])


@lru_cache(maxsize=2)
def counter_of(path: str) -> PrefixCounter:
    """One counter for all tasks of a worker: what it has learnt of pairs stays."""
    return PrefixCounter(path)


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fitting_chars", pa.int64())])


def count_tokens(docs: DataFrame, *, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes and tokens, whether it is over the limit, and how many of its characters fit the limit."""

    @common.no_cycles
    def run(batches):
        counter = counter_of(common.tokenizer_path(model))
        for batch in bpe.by_size(batches):
            texts = bpe.texts_of(batch)
            n, chars = counter.count(texts, limit)
            yield common.record_batch(COUNTED, {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts), "n_tokens": n, "over_limit": n > limit, "fitting_chars": chars})

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, common.spark_schema(COUNTED))


def prefix_table(docs: DataFrame, *, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and prefix_tokens, the number of tokens of each prefix, for the functions below."""

    def run(batches):
        counter = counter_of(common.tokenizer_path(model))
        for batch in common.slices(batches, 64):
            counter.stands.trim()
            rows = [counter.prefixes(t).tolist() for t in bpe.texts_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return common.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, prefix_tokens array<int>")


def tokens_of_prefix(prefix_tokens: Column | str, chars: Column | int) -> Column:
    """Tokens of the first so many characters."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1).cast("int"))


def longest_prefix(prefix_tokens: Column | str, budget: Column | int) -> Column:
    """Characters of the longest prefix within a budget of tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    held = F.filter(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull())
    return F.array_max(held)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
