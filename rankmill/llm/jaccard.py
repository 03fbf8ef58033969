"""N-gram Jaccard join: a size-aware, heavy-light join of sets of word shingles.

Documents with equal sets are one set from the start. Two sets of sizes a and b link when their overlap is at least
c(a, b) = ceil(num * (a + b) / (num + den)).

Light: sets up to a boundary enumerate their subsets of each size c(a, b) that a partner can ask for; two such sets link
exactly if they share one. Heavy: larger sets (and those light ones that a larger set can reach) are posted in inverted
lists, which are then scanned. There is a list for each shingle and class of sizes, and a set is posted in those of its
rarest shingles only: in one order of all shingles two linked sets of sizes a and b share one of their first a - c + 1
and b - c + 1. The order is by how often a shingle's bucket occurs in all documents, counted in a table of fixed size, and
then by hash; any order gives the same links, and this one keeps passages that very many documents share out of the
lists. The boundary is that of least cost over the sizes that the documents have: a subset costs one, a posting one more than
the length of a list, which is estimated from the table's counts.

In a list every member is first compared with the list's leader, its member that shares most lists; linked members are
merged into components. Lists whose members are then in one component are done, and of those with the same members one
is kept; in what remains every pair across components is met, in blocks of members, first by parity sketches, which bound
how much two sets can share, and where that leaves it open by the sets. So no pairs within groups of copies are made,
and yet each pair that shares a list is in one component or has been compared. What links is decided by whole sets.

Links are counted where that is asked for, all of them and not only those that components need. Linked sets are in one
component, and their sizes in the same or adjacent bands of a geometric scale. So the members of each component are dealt
into blocks by band, every block is compared with itself and with all others in its band and the next one by a product of
whole sets, and only the numbers leave the task. n_links of a row is the number of other documents whose text has an
equal or a linked set; a document counts once for each of its different sets.

Defined cases: a text without words, or a null one, has an empty set and links with nothing; a row with a null doc_id has
its set's size, a null component and no links, and isn't counted as one; rows with one doc_id and different texts link through their own sets, and
the document's component is the smallest one of its rows; repeated rows each give a row; an empty table gives none;
further columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import bpe, common, shingles

MOST_LIGHT = 64
BITS = 20  # 2 ** BITS buckets of the table of counts
STEPS = 2048  # its counts are kept as logarithms, with so many steps to a doubling
AT_ONCE = 2_000_000  # bytes of text whose sets are held at once
BLOCK = 512  # members of a list that one task compares with as many others, and the most bytes of their sketches
BLOCK_BYTES = 8_000_000
MEMBERS = 2048  # most sets in a block of those whose links are counted, and about the most elements in it
ELEMENTS = 1_000_000
WIDE = 4096  # elements in one product of such blocks
_ALL = (1 << 64) - 1


class Scheme:
    """What each size posts, for one similarity num / den."""

    def __init__(self, num: int, den: int, light: int = 0):
        self.num, self.den, self.light = num, den, light
        self.first = [1]  # the smallest size of each class

    @classmethod
    def fitted(cls, num: int, den: int, sizes: np.ndarray, scan: float) -> Scheme:
        """With the boundary of least cost, where so many sets have each size, and a list so many members."""
        some, scheme = np.flatnonzero(sizes[: MOST_LIGHT + 1]).tolist(), cls(num, den)

        def cost(light: int) -> float:
            return sum(float(sizes[a]) * scheme.cost(a, light, scan) for a in some if a)

        scheme.light = min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))
        return scheme

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, a: int) -> int:
        """The smallest size that can link with size a; ``most`` the largest."""
        return -(-self.num * a // self.den)

    def most(self, a: int) -> int:
        return self.den * a // self.num

    def size_class(self, a: int) -> int:
        while self.first[-1] <= a:
            self.first.append(self.most(self.first[-1]) + 1)
        return int(np.searchsorted(self.first, a, side="right")) - 1

    def subsets(self, a: int, light: int) -> set[int]:
        """Sizes of the subsets that a light set of size a enumerates; for equal sets nothing is needed."""
        return {self.overlap(a, b) for b in range(max(1, self.least(a)), min(self.most(a), light) + 1) if not self.overlap(a, b) == a == b and self.overlap(a, b) <= min(a, b)}

    def lists(self, a: int, light: int) -> list[tuple[int, int]]:
        """Classes in whose lists a set of size a is posted, and for how many of its rarest shingles."""
        k = self.size_class(a)
        self.size_class(self.first[k])
        while len(self.first) < k + 2:
            self.size_class(self.first[-1])
        beyond, out = self.first[k + 1], []
        if a > light or beyond - 1 > light and self.most(a) > light:
            out.append((k, a - self.overlap(a, self.least(a)) + 1))
        if self.most(a) >= beyond and self.most(a) > light:
            out.append((k + 1, a - self.overlap(a, beyond) + 1))
        return out

    def cost(self, a: int, light: int, scan: float) -> float:
        made = sum(math.comb(a, c) for c in self.subsets(a, light)) if a <= light else 0
        return made + (1 + scan) * sum(p for _, p in self.lists(a, light))

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)

    def keys(self, own: np.ndarray, mixed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keys that a set posts; linked sets, unless equal, share one. Counts are the logarithms by bucket."""
        a, out = len(own), []
        with np.errstate(over="ignore"):
            if a <= self.light:
                total = mixed.sum(dtype=np.uint64)
                for c in self.subsets(a, self.light):
                    left_out = np.array(list(itertools.combinations(range(a), a - c)), np.int64).reshape(math.comb(a, c), a - c)
                    out.append(shingles.mix(total - mixed[left_out].sum(1, dtype=np.uint64) + np.uint64(c * 0x5851F42D4C957F2D & _ALL)))
            lists = self.lists(a, self.light)
            if lists:
                order = counts[own >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(48) | own >> np.uint64(16)
                ends = np.partition(order, sorted({p - 1 for _, p in lists}))
                for k, p in lists:  # of equal places in the order all are taken
                    out.append(shingles.mix(own[order <= ends[p - 1]] ^ shingles.mix(np.array([k << 32 | 1 << 60], np.uint64))))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


COUNTS = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
_BLOCKS = 256  # of the table; and one with the sizes of the sets


def frequencies(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of counts, as logarithms, from all documents; and how many texts have each number of shingles up to MOST_LIGHT."""

    def blocks(table, sizes):
        rows = [*table.reshape(_BLOCKS, -1), sizes]
        return common.record_batch(COUNTS, {"block": np.arange(_BLOCKS + 1), "counts": [r.astype("<i8" if r is sizes else "<i4").tobytes() for r in rows]})

    @common.no_cycles
    def count(batches):
        table, sizes, held, many = np.zeros(1 << BITS, np.int32), np.zeros(MOST_LIGHT + 1, np.int64), [], 0

        def add():
            table[:] += np.bincount(np.concatenate(held), minlength=1 << BITS).astype(np.int32)
            held.clear()

        for batch in bpe.by_size(batches, AT_ONCE):
            flat, size = shingles.occurrences(batch.column("text"), n)
            sizes += np.bincount(size[size <= MOST_LIGHT], minlength=MOST_LIGHT + 1)
            held.append((flat >> np.uint64(64 - BITS)).astype(np.int32))
            many += len(flat)
            if many > 1 << BITS:
                add()
                many = 0
        if held:
            add()
            yield blocks(table, sizes)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                x = np.frombuffer(raw.as_buffer(), "<i8" if b == _BLOCKS else "<i4")
                sums[b] = sums[b] + x if b in sums else x.astype(np.int64)
        for b, x in sums.items():
            kept = x.astype("<i8") if b == _BLOCKS else np.minimum(65535, np.log2(1 + x) * STEPS).astype("<u2")
            yield common.record_batch(COUNTS, {"block": [b], "counts": [kept.tobytes()]})

    found = docs.select("text").mapInArrow(count, common.spark_schema(COUNTS)).repartition("block").mapInArrow(total, common.spark_schema(COUNTS))
    table, sizes = np.zeros((_BLOCKS, (1 << BITS) // _BLOCKS), np.uint16), np.zeros(MOST_LIGHT + 1, np.int64)
    for r in found.toArrow().to_pylist():  # 2 ** BITS numbers, whatever the documents are
        if r["block"] == _BLOCKS:
            sizes += np.frombuffer(r["counts"], "<i8")
        else:
            table[r["block"]] = np.frombuffer(r["counts"], "<u2")
    return table.ravel(), sizes


def scan_length(counts: np.ndarray) -> float:
    """About how many members a list has: the variance of the buckets' counts over their mean, without the largest hundredth.

    Shingles that occur once make counts whose variance is their mean, and those that occur m times one that is m times that.
    """
    x = np.sort(2.0 ** (counts / STEPS) - 1)
    x = x[: len(x) - len(x) // 100]
    return max(1.0, float(x.var() / x.mean())) if x.any() else 1.0


POSTED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])
SETS = pa.schema([("set_id", pa.int64()), ("size", pa.int64()), ("elements", pa.binary())])


def _set_id(own: np.ndarray, mixed: np.ndarray) -> int:
    """64 bits that stand for a set; 0 for the empty one."""
    if not len(own):
        return 0
    with np.errstate(over="ignore"):
        x = shingles.mix(np.array([mixed.sum(dtype=np.uint64) ^ np.uint64(len(own))]))
    return int(x.astype(np.int64)[0]) or 1


def sketch(mixed: np.ndarray) -> bytes:
    """For each of a power of two of places, about as many as elements, whether an odd number of elements falls there.

    Two sketches differ in no more places than their sets differ in elements. A sketch whose halves are laid over each
    other, odd on odd giving even, is the sketch of half the places.
    """
    bits = 1 << max(6, (len(mixed) - 1).bit_length())
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _each_set(batches, n: int):
    for batch in bpe.by_size(batches, AT_ONCE):
        flat, at = shingles.sets(batch.column("text"), n)
        mixed = shingles.mix(flat)
        yield batch, [(flat[a:b], mixed[a:b]) for a, b in itertools.pairwise(at.tolist())]


def post(docs: DataFrame, n: int, scheme: Scheme, counts) -> DataFrame:
    """Of each row its set's size and id, and, once a task for each set, its sketch and the keys that it posts."""

    @common.no_cycles
    def run(batches):
        seen: common.Memo = common.Memo(1_000_000)
        for batch, found in _each_set(batches, n):
            ids, sketches, keys = [], [], []
            seen.trim()
            for d, (own, mixed) in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids.append(_set_id(own, mixed))
                new = d is not None and len(own) > 0 and ids[-1] not in seen
                sketches.append(sketch(mixed) if new else None)
                keys.append(scheme.keys(own, mixed, counts.value).astype(np.int64) if new else None)
                if new:
                    seen[ids[-1]] = True
            ends = np.cumsum([0, *[0 if k is None else len(k) for k in keys]])
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate([np.zeros(0, np.int64), *[k for k in keys if k is not None]]))
            yield common.record_batch(POSTED, {"doc_id": batch.column("doc_id"), "n_shingles": [len(f[0]) for f in found], "set_id": ids, "sketch": sketches, "keys": lists})

    return docs.mapInArrow(run, common.spark_schema(POSTED))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Of each row (text, wanted) the set, where its id is the wanted one."""

    @common.no_cycles
    def run(batches):
        for batch, found in _each_set(batches, n):
            kept = [(w, len(own), own.tobytes()) for w, (own, mixed) in zip(batch.column("wanted").to_pylist(), found, strict=True) if _set_id(own, mixed) == w]
            yield common.record_batch(SETS, {name: [k[i] for k in kept] for i, name in enumerate(SETS.names)})

    return docs.select("text", "wanted").mapInArrow(run, common.spark_schema(SETS))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b, own, other) -> the linked (a, b)."""

    def run(batches):
        for batch in common.slices(batches, 1024):
            own, other = batch.column("own").to_pylist(), batch.column("other").to_pylist()
            x = [(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(own, other, strict=True)]
            both = np.array([_common(p, q) for p, q in x], np.int64)
            size = np.array([(len(p), len(q)) for p, q in x], np.int64).reshape(-1, 2)
            yield batch.select(["a", "b"]).filter(pa.array(scheme.linked(both, size[:, 0], size[:, 1])))

    return pairs.select("a", "b", "own", "other").mapInArrow(run, common.spark_schema(LINKS))


def _open(pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b, sizes, sketches) -> the (a, b) that their sketches don't show to be apart."""

    def run(batches):
        for batch in common.slices(batches, 4096):
            size, other = (batch.column(c).to_numpy() for c in ("a_size", "b_size"))
            apart = np.array([_apart(p, q) for p, q in zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist(), strict=True)], np.int64)
            most = np.minimum((size + other - apart) // 2, np.minimum(size, other))
            yield batch.select(["a", "b"]).filter(pa.array(scheme.linked(most, size, other)))

    return pairs.select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch").mapInArrow(run, common.spark_schema(LINKS))


def _apart(p: bytes, q: bytes) -> int:
    """In how many places two sketches differ, the longer one laid over itself."""
    x, y = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    n = min(len(x), len(y))
    odd = np.bitwise_xor.reduce(x.reshape(-1, n), 0) ^ np.bitwise_xor.reduce(y.reshape(-1, n), 0)
    return int(np.bitwise_count(odd).sum())


def _common(p: np.ndarray, q: np.ndarray) -> int:
    x = np.sort(np.concatenate([p, q]))
    return int((x[1:] == x[:-1]).sum())


def _blocks(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (part, side, component, set_id, size, sketch), sorted by part and side -> pairs across components that may link.

    A part has the members of two blocks of a list, on sides 0 and 1, or of one, on side 0, to compare with itself. A
    pair goes on unless its sketches alone show that too few elements are common.
    """

    def pairs(held):
        side, component, ids, size = (np.array([h[i] for h in held], np.int64) for i in range(4))
        packed = [np.frombuffer(h[4], np.uint8) for h in held]
        width = np.array([len(x) for x in packed])
        found = [np.zeros((2, 0), np.int64)]
        for w in np.unique(width):
            who = np.flatnonzero(width >= w)  # of each pair the shorter sketch has this width, the longer one is laid over itself
            flat = np.stack([np.bitwise_xor.reduce(packed[i].reshape(-1, w), 0) for i in who]).view(np.uint64)
            for x, i in enumerate(who.tolist()):
                other = who[x + 1 :]
                ok = (np.minimum(width[other], width[i]) == w) & (component[other] != component[i])
                ok &= scheme.den * np.minimum(size[other], size[i]) >= scheme.num * np.maximum(size[other], size[i])
                if side.any():
                    ok &= side[other] != side[i]
                other = other[ok]
                if len(other):
                    apart = np.bitwise_count(flat[x + 1 :][ok] ^ flat[x]).sum(1, dtype=np.int64)
                    most = np.minimum((size[other] + size[i] - apart) // 2, np.minimum(size[other], size[i]))
                    other = other[scheme.linked(most, size[other], size[i])]
                    found.append(np.stack([np.minimum(ids[other], ids[i]), np.maximum(ids[other], ids[i])]))
        return np.concatenate(found, 1)

    def run(batches):
        def stream():
            for batch in common.slices(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("part", "side", "component", "set_id", "size", "sketch")), strict=True)

        for _, group in itertools.groupby(stream(), key=lambda r: r[0]):
            held = [r[1:] for r in group]
            if len(held) > 1:
                a, b = pairs(held)
                if len(a):
                    yield common.record_batch(LINKS, {"a": a, "b": b})

    return rows.mapInArrow(run, common.spark_schema(LINKS))


COUNTED = pa.schema([("set_id", pa.int64()), ("n", pa.int64())])


def _linked_docs(alone: bool, left: np.ndarray, sets: list[np.ndarray], docs: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Of each set the documents of the sets that it links with: of all others if alone, else of those on the other side."""
    size = np.array([len(x) for x in sets], np.int64)
    a, b = (np.arange(len(sets)),) * 2 if alone else (np.flatnonzero(left), np.flatnonzero(~left))
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    place = np.cumsum(times > 1) - 1
    kept = times[at] > 1
    owner, at = owner[kept], place[at[kept]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int((times > 1).sum()), WIDE):
        i, j = np.searchsorted(at, (low, low + WIDE))
        held = np.zeros((len(sets), int(at[j - 1]) + 1 - low), np.float32)
        held[owner[i:j], at[i:j] - low] = 1
        both += held @ held.T if alone else held[a] @ held[b].T
    found = np.zeros(len(sets), np.int64)
    for k in range(0, len(a), 256):
        rows = a[k : k + 256]
        ok = scheme.linked(both[k : k + 256].astype(np.int64), size[rows][:, None], size[b][None, :])
        if alone:
            ok[np.arange(len(rows)), rows] = False
        found[rows] += ok @ docs[b]
        if not alone:
            found[b] += docs[rows] @ ok
    return found


def _count(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (part, side, set_id, docs, elements), sorted by part -> how many documents each set links with in that part.

    Sides are 0 and 1 where two blocks meet, and 2 where a block meets itself.
    """

    def run(batches):
        def stream():
            for batch in common.slices(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("part", "side", "set_id", "docs", "elements")), strict=True)

        for _, group in itertools.groupby(stream(), key=lambda r: r[0]):
            held = list(group)
            side, ids, docs = (np.array([h[i] for h in held], np.int64) for i in (1, 2, 3))
            alone = bool(side[0] == 2)
            if len(held) < 2 or not alone and side.min() == side.max():
                continue
            found = _linked_docs(alone, side == 0, [np.frombuffer(h[4], np.uint64) for h in held], docs, scheme)
            some = np.flatnonzero(found)
            if len(some):
                yield common.record_batch(COUNTED, {"set_id": ids[some], "n": found[some]})

    return rows.mapInArrow(run, common.spark_schema(COUNTED))


def count_links(scratch: common.Scratch, sets: DataFrame, joined: DataFrame, weights: DataFrame, scheme: Scheme) -> DataFrame:
    """set_id, linked: the documents of the other sets that each set links with. Weights has the sets of several documents."""
    # sizes of linked sets are at most one band apart; the width is a trifle more, for rounding
    width = math.log(max(scheme.den / scheme.num, 1.05)) * (1 + 1e-9)
    own = sets.select("set_id", "size").join(joined, F.col("set_id") == F.col("node")).select("set_id", "component", "size")
    members = scratch.keep(own.join(weights, "set_id", "left").select("set_id", "component", "size", F.coalesce("n_docs", F.lit(1)).cast("bigint").alias("docs"), F.floor(F.log("size") / width).alias("band")), "members")
    full = lambda n, e: F.greatest(F.ceil(n / MEMBERS), F.ceil(e / ELEMENTS))
    by_band = members.groupBy("component", "band").agg(F.count("*").alias("n"), F.sum("size").alias("e"))
    # components of more than one block, which are few, and their bands; all others are one part
    big = by_band.groupBy("component").agg(F.sum("n").alias("all_n"), F.sum("e").alias("all_e")).where(full(F.col("all_n"), F.col("all_e")) > 1).select("component")
    bands = scratch.keep(by_band.join(big, "component").select("component", "band", full(F.col("n"), F.col("e")).alias("blocks")), "bands")
    near = lambda d, name: bands.select("component", (F.col("band") - d).alias("band"), F.col("blocks").alias(name))
    dealt = members
    for d, name in ((0, "blocks"), (1, "above"), (-1, "below")):
        dealt = dealt.join(near(d, name), ["component", "band"], "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(2)), F.coalesce("blocks", F.lit(1).cast("bigint"))))
    zero, block = F.lit(0).cast("bigint"), F.col("block")
    upto = lambda c, f: F.when(F.col(c).isNotNull(), F.transform(F.sequence(zero, F.col(c) - 1), f)).otherwise(F.array().cast("array<struct<part:bigint,side:int>>"))
    part = lambda side, *key: F.struct(F.xxhash64("component", *key).alias("part"), side.cast("int").alias("side"))
    same = upto("blocks", lambda o: part(F.when(block == o, 2).when(block < o, 0).otherwise(1), F.lit(0), "band", F.least(block, o), F.greatest(block, o)))
    up = upto("above", lambda o: part(F.lit(0), F.lit(1), "band", block, o))
    down = upto("below", lambda o: part(F.lit(1), F.lit(1), F.col("band") - 1, o, block))
    whole = F.array(part(F.lit(2), F.lit(2)))
    parts = dealt.select("set_id", "docs", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(F.concat(same, up, down))).alias("p")).select("set_id", "docs", "p.part", "p.side")
    rows = parts.join(sets.select("set_id", "elements"), "set_id").repartition("part").sortWithinPartitions("part")
    return _count(rows.select("part", "side", "set_id", "docs", "elements"), scheme).groupBy("set_id").agg(F.sum("n").alias("linked"))


def components(scratch: common.Scratch, links: DataFrame, name: str) -> DataFrame:
    """(a, b) -> (node, component), the smallest node that each node reaches.

    Each round every node's neighbours are attached to the smallest of them and the node itself, large ones first and
    then small ones, until nothing changes; a group becomes a star in a logarithmic number of rounds.
    """
    def state(table: DataFrame):
        return table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
    before = state(edges)
    for k in itertools.count(1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct()
        edges = scratch.keep(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        after = state(edges)
        if before == after:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after


def link(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, and n_links if ``links``. Equal sets are linked; others when num / den of their union is common."""
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "jaccard")
    texts = common.id_and_text(docs, id_col, text_col)
    table, sizes = frequencies(texts, n)
    counts = spark.sparkContext.broadcast(table)  # 2 ** BITS x 16 bits: 2 MB
    scheme = Scheme.fitted(num, den, sizes, scan_length(table))
    posted = scratch.keep(post(texts, n, scheme, counts), "posted")
    rows = scratch.keep(posted.select("doc_id", "n_shingles", "set_id"), "rows")
    named = rows.where("doc_id IS NOT NULL AND set_id <> 0")
    groups = named.groupBy("set_id").agg(F.min("doc_id").alias("least_doc")).select(F.col("set_id").alias("group_id"), "least_doc")
    # lists with more than one set
    each = posted.where("sketch IS NOT NULL")
    one = F.count("*").over(_by("key"))
    shared = scratch.keep(each.select("set_id", F.explode("keys").alias("key")).repartition("key").distinct().withColumn("members", one).where("members > 1"), "shared")
    degree = shared.groupBy("set_id").agg(F.sum("members").alias("degree"))
    light = scratch.keep(each.select("set_id", F.col("n_shingles").alias("size"), "sketch").join(degree, "set_id").dropDuplicates(["set_id"]), "light")
    scratch.drop("posted")

    def fetch(wanted: DataFrame, name: str) -> DataFrame:
        """The sets with these ids, from the text of one document of each."""
        asked = scratch.keep(wanted.join(groups, F.col("set_id") == F.col("group_id")).select(F.col("set_id").alias("wanted"), "least_doc"), f"asked_{name}")
        found = scratch.keep(_sets(texts.join(asked, F.col("doc_id") == F.col("least_doc")), n), name)
        many = found.agg(F.count("*").alias("n"), F.count_distinct("set_id").alias("sets")).first()
        return found if many["n"] == many["sets"] else scratch.keep(found.dropDuplicates(["set_id"]), f"{name}_once")  # repeated rows

    def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("elements").alias("own")), "a")
        return _compare(left.join(sets.select(F.col("set_id").alias("b"), F.col("elements").alias("other")), "b"), scheme)

    # every member of a list with its leader, the one that shares most
    led = shared.join(light.select("set_id", "size", "degree"), "set_id").withColumn("leader", F.max(F.struct("degree", "set_id", "size")).over(_by("key")))
    fits = den * F.least("size", "leader.size") >= num * F.greatest("size", "leader.size")
    pairs = led.where(fits & (F.col("leader.set_id") != F.col("set_id"))).select(F.col("set_id").alias("a"), F.col("leader.set_id").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(light.select(*[F.col(c).alias(name) for c, name in (("set_id", side), ("size", f"{side}_size"), ("sketch", f"{side}_sketch"))]), side)
    opened = scratch.keep(_open(pairs, scheme), "opened")
    sets = fetch(opened.select(F.col("a").alias("set_id")).union(opened.select("b")).distinct(), "sets")
    first = scratch.keep(compare(opened, sets), "first")
    found = components(scratch, first, "by_leader")
    # what is left: lists of more than a pair with members of several components, one of those with equal members
    among = shared.where("members > 2").join(light.select("set_id", "size"), "set_id").join(found, F.col("set_id") == F.col("node"), "left")
    inside = scratch.keep(among.select("key", "set_id", "size", F.coalesce("component", "set_id").alias("component")), "inside")
    mark = F.xxhash64("set_id")
    open_ = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum(F.shiftright(mark, 20)).alias("x"), F.bit_xor(mark).alias("y"), F.sum("size").alias("bits"))
    open_ = open_.where("low <> high").groupBy("members", "x", "y").agg(F.min("key").alias("key"), F.max("bits").alias("bits"))
    held = inside.join(open_, "key").withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bits") / (8 * BLOCK_BYTES))))
    held = held.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    held = held.select("*", other.alias("other")).select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("part"), (F.col("block") > F.col("other")).cast("int").alias("side"), "component", "set_id")
    likely = _blocks(held.join(light.select("set_id", "size", "sketch"), "set_id").repartition("part").sortWithinPartitions("part", "side", "set_id").select("part", "side", "component", "set_id", "size", "sketch"), scheme)
    pairs = scratch.keep(likely.distinct(), "likely")
    scratch.drop("shared", "light", "opened", "inside")
    more = fetch(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().join(sets.select("set_id"), "set_id", "left_anti"), "more")
    sets = sets.union(more)
    second = scratch.keep(compare(pairs, sets), "second")
    # components of documents: links between sets, and rows of one document with several sets
    several = named.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("doc_id")
    bound = named.join(several, "doc_id").select("doc_id", F.col("set_id").alias("b")).join(named.groupBy("doc_id").agg(F.min("set_id").alias("a")), "doc_id").where("a <> b").select("a", "b")
    joined = components(scratch, first.union(second).union(bound), "all")
    classes = groups.join(joined, F.col("group_id") == F.col("node"), "left").select("group_id", "least_doc", F.coalesce("component", "group_id").alias("class"))
    least = classes.groupBy("class").agg(F.min("least_doc").alias("component_id"))
    ids = classes.join(least, "class").select(F.col("group_id").alias("set_id"), "component_id")
    if links:
        joined = scratch.keep(joined, "joined")
        weights = scratch.keep(named.select("set_id", "doc_id").distinct().groupBy("set_id").agg(F.count("*").alias("n_docs")).where("n_docs > 1"), "weights")
        linked = scratch.keep(count_links(scratch, sets, joined, weights, scheme), "linked")
        ids = ids.join(linked, "set_id", "left").join(weights, "set_id", "left").select("set_id", "component_id", (F.coalesce("linked", F.lit(0)) + F.coalesce("n_docs", F.lit(1)) - 1).alias("n_links"))
    ids = scratch.keep(ids, "ids")
    out = rows.join(ids, "set_id", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    scratch.drop(*[name + once for name in ("sets", "more") for once in ("", "_once")], "asked_sets", "asked_more", "first", "likely", "second", "joined", "weights", "members", "bands", "linked")
    others = [F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links")] if links else []
    return out.select("doc_id", "n_shingles", own.alias("component_id"), *others)


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"), n=3, num=90, den=100, links=True)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Documents without words or without an id stay; of several rows with the id that stays, the one with the least hash does.
    """
    del sf_dir
    kept = common.Scratch(spark, "kept").keep(link(docs).where("component_id = doc_id").groupBy(F.col("doc_id").alias("kept__id")).agg(F.count("*").alias("kept__rows")), "kept")
    out = docs.join(kept, docs["doc_id"] == kept["kept__id"], "left").where(F.col("kept__id").isNotNull() | docs["doc_id"].isNull())
    out = out.select([docs[c] for c in docs.columns])
    if kept.where("kept__rows > 1").isEmpty():
        return out
    row = F.struct(*docs.columns)
    one = out.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return one.select([F.col("row")[c].alias(c) for c in docs.columns]).union(out.where("doc_id IS NULL"))
