import itertools
import random
import re

import pytest

from rankmill.llm import jaccard
from rankmill.llm.jaccard import Scheme, link

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, lengths, edits, groups=6, each=12):
    r = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(groups):
        base = [f"w{g}_{r.randrange(400)}" for _ in range(r.choice(lengths))]
        if g % 2:
            base[:0] = passage
        for _ in range(each):
            words = list(base)
            for _ in range(r.randrange(edits + 1)):
                k = r.randrange(len(words))
                words[k : k + 1] = r.choice([[], [f"e{r.randrange(10**6)}"], [words[k], f"e{r.randrange(9)}"]])
            rows.append((len(rows), r.choice([" ", "\n", " \t"]).join(words).upper() if r.random() < 0.2 else " ".join(words)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "num", "den", "lengths", "edits"), [(3, 90, 100, (2, 5, 11, 14, 17, 21, 30, 60), 2), (3, 90, 100, (150, 400), 6), (5, 80, 100, (6, 9, 13, 20, 45), 2), (5, 80, 100, (120, 300), 7)])
def test_components_match_brute_force(spark, n, num, den, lengths, edits):
    rows = near_copies(n * num + len(lengths), lengths, edits)
    out = link(spark.createDataFrame(rows, "doc_id long, text string"), n=n, num=num, den=den)
    assert sorted(map(tuple, out.collect())) == brute(rows, n, num, den)


def test_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = near_copies(5, (100,), 7, groups=2, each=40)
    out = link(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90, den=100)
    assert sorted(map(tuple, out.collect())) == brute(rows, 3, 90, 100)


def linked_docs(rows, n, num, den):
    """Of each row the number of other (document, set)s whose set is equal or linked."""
    held = {(d, shingle_set(t, n)) for d, t in rows if d is not None}
    out = []
    for d, t in rows:
        x = shingle_set(t, n)
        near = [o for o in held if o != (d, x) and x and o[1] and den * len(x & o[1]) >= num * len(x | o[1])]
        out.append((d if d is not None else -1, len(x), len(near) if d is not None else 0))
    return sorted(out)


@pytest.mark.parametrize(("members", "elements"), [(2048, 1_000_000), (7, 1_000_000), (2048, 900)])
def test_all_links_are_counted(spark, monkeypatch, members, elements):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "ELEMENTS", elements)
    rows = near_copies(8, (40, 90, 100), 4, groups=3, each=40)
    # a chain from short to long, with links across bands and none between its ends
    words = [f"c{i}" for i in range(160)]
    rows += [(1000 + k, " ".join(words[:k])) for k in range(60, 160, 4)]
    rows += [(1000, rows[-1][1]), (1001, rows[-1][1]), (1001, rows[-2][1]), (1001, rows[-2][1]), (None, rows[-1][1]), (2000, None), (2001, "one"), (2002, "ONE")]
    out = link(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90, den=100, links=True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[3]) for r in out.collect()) == linked_docs(rows, 3, 90, 100)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É a"), (8, "é a"), (9, long), (10, long + " more"), (4, "one"), (11, "other text of the row"), (11, "one two")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, key string")
    assert sorted(map(tuple, link(df, n=3, num=90, den=100).collect())) == brute(rows, 3, 90, 100)
    nulls = spark.createDataFrame([(None, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, link(nulls, n=3, num=90, den=100).collect()), key=str) == [(3, 2, 3), (None, 2, None)]
    assert link(nulls.limit(0)).collect() == []


def test_linked_sets_share_a_key():
    r = random.Random(3)
    import numpy as np

    from rankmill.llm.shingles import mix

    counts = np.random.default_rng(1).integers(0, 5, 1 << jaccard.BITS).astype(np.uint16)
    for num, den, light in ((90, 100, 20), (80, 100, 9), (80, 100, 0)):
        scheme = Scheme(num, den, light)
        for _ in range(1500):
            a = r.choice([r.randrange(1, 30), r.randrange(30, 200)])
            b = r.randrange(a, scheme.most(a) + 1)
            c = scheme.overlap(a, b)
            if c > a:
                continue
            values = np.array([r.getrandbits(64) for _ in range(a + b - c)], np.uint64)
            x, y = np.sort(values[:a]), np.sort(values[a - c :])
            if a == b == c:
                continue
            assert np.intersect1d(scheme.keys(x, mix(x), counts), scheme.keys(y, mix(y), counts)).size, (num, a, b, c)
