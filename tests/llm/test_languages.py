"""Code lengths against plain prediction by partial matching, byte by byte, with escapes and exclusions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rankmill.llm import languages, registry

CORPUS = {"aa": ["the cat sat on the mat", "a cat, the hat", "the", "x"], "bb": ["der hund und der mund", "und rund", "ä ö ü straße"], "cc": ["\n\t 123"]}


class Plain:
    """One language's tree as dictionaries; ``least`` is how often a string must be there to be kept."""

    def __init__(self, texts, order, least):
        self.order, seen, follow = order, Counter(), defaultdict(Counter)
        for t in map(str.encode, texts):
            for end in range(1, len(t) + 1):
                for k in range(1, min(end, order + 1) + 1):
                    seen[t[end - k : end]] += 1
                    follow[t[end - k : end - 1]][t[end - 1]] += 1
        self.kept = {s: n for s, n in seen.items() if n >= least}
        self.follow = {c: f for c, f in follow.items() if c == b"" or c in self.kept}

    def share(self, before, byte):
        context = before[len(before) - min(len(before), self.order) :]
        while context not in self.follow:
            context = context[1:]
        got, barred = 1.0, set()
        while True:
            f = self.follow[context]
            stay = {b: n for b, n in f.items() if context + bytes([b]) in self.kept}
            escape = len(f) + sum(n for b, n in f.items() if b not in stay)
            whole = sum(n for b, n in stay.items() if b not in barred) + escape
            if byte in stay:
                return got * stay[byte] / whole
            got *= escape / whole
            barred |= set(stay)
            if not context:
                return got / (256 - len(barred))
            context = context[1:]

    def cost(self, text):
        return -sum(math.log(self.share(text[:i], text[i])) for i in range(len(text)))


def compiled(corpus, order, least):
    names, rows = sorted(corpus), []
    for name in names:
        plain = Plain(corpus[name], order, least)
        key = lambda s: int.from_bytes(s[::-1], "big")
        for s in [b"", *plain.kept]:
            f = plain.follow.get(s, {}) if len(s) <= order else {}
            rows.append((name, len(s), key(s), plain.kept.get(s, 0), sum(f.values()), len(f)))
    return languages.Model(names, pa.table(dict(zip(("lang", "size", "key", "n", "after", "kinds"), zip(*rows, strict=True), strict=True))), order)


@pytest.mark.parametrize("order,least", [(4, 1), (2, 1), (4, 2), (3, 3)])
def test_code_lengths_are_those_of_plain_coding(order, least):
    texts = [b"the cat", b"", b"q", b"und the hund", "straße zz".encode(), b"aaaaaaaa", bytes(range(256)), b"the mat sat on the cat and the hat"]
    model = compiled(CORPUS, order, least)
    for block in (1 << 20, 5):
        found = model.code_lengths(texts, block)
        for i, name in enumerate(sorted(CORPUS)):
            plain = Plain(CORPUS[name], order, least)
            assert np.allclose(found[:, i], [plain.cost(t) for t in texts], rtol=1e-9, atol=1e-9)


def test_shares_of_all_bytes_add_up_to_one():
    model = compiled(CORPUS, 4, 1)
    for before in (b"", b"t", b"the ", b"zz", b"hund u"):
        one = model.code_lengths([before + bytes([b]) for b in range(256)]) - model.code_lengths([before])
        assert np.allclose(np.exp(-one).sum(0), 1)


def test_trees_count_all_rows_and_keep_by_share(spark):
    rows = [(i, t, name, "clash") for name, texts in CORPUS.items() for i, t in enumerate(texts)] + [(9, None, "aa", ""), (9, "text", None, ""), (None, "", "dd", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, size string").repartition(3)
    for shares, order in ((1 << 20, 4), (90, 4), (90, 2)):
        names, table = languages.trees(languages.counts(docs, order), order, shares)
        assert names == ["aa", "bb", "cc"]
        for name in names:
            total = sum(len(t.encode()) for t in CORPUS[name])
            plain = Plain(CORPUS[name], order, total / (shares // 3))
            own = {r["key"].to_bytes(8, "big").lstrip(b"\0")[::-1] if r["size"] else b"": r for r in table.to_pylist() if r["lang"] == name}
            assert {s: r["n"] for s, r in own.items() if s} == plain.kept
            for s, r in own.items():
                f = plain.follow.get(s, {}) if len(s) <= order else {}
                assert (r["after"], r["kinds"]) == (sum(f.values()), len(f))


def test_query_learns_from_its_rows_alone(spark, tmp_path):
    said = {"en": "the cat and the dog went over there with that hat ", "de": "der hund und die katze gingen dort mit dem hut über "}
    words = {k: v.split() for k, v in said.items()}
    rows = [(i, " ".join(words[k][(i * 7 + j) % len(words[k])] for j in range(3 + i % 5)), k, "s") for i in range(200) for k in [("en", "de")[i % 2]]]
    rows += [(1001, None, "en", ""), (1002, "", "en", ""), (1003, "12 34 ²", "en", ""), (1004, "the cat " * 60_000, None, ""), (None, "der hund", "de", ""), (1005, "the cat", "de", ""), (1005, "the cat", "de", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    found = [r.asDict() for r in registry.QUERIES["op11_language_id"](spark, str(tmp_path)).collect()]
    assert len(found) == len(rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    plain = {k: Plain([t for i, t, lang, _ in rows if lang == k and t and not held(i)], 4, 1) for k in said}
    texts = {i: t for i, t, *_ in rows}
    for r in found:
        text = texts[r["doc_id"]]
        if r["doc_id"] in (1001, 1002, 1003):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] == 1004:
            assert (r["lang_pred"], r["score"]) == ("en", 1.0)
        else:
            cost = {k: p.cost(text.encode()) for k, p in plain.items()}
            assert r["lang_pred"] == min(sorted(cost), key=cost.get)
            assert math.isclose(r["score"], 1 / sum(math.exp(min(cost.values()) - c) for c in cost.values()), rel_tol=1e-6)
    assert sum(r["lang_pred"] == lang for r in found for i, _, lang, _ in rows[:200] if i == r["doc_id"]) >= 195
    assert registry.QUERIES["op11_language_id"](spark, f"{tmp_path}/empty").collect() == []


def test_without_learning_rows_all_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[:3] for r in languages.predict(docs, languages.learn(docs)).collect()] == [(1, "und", 0.0)]


def test_too_many_languages_are_refused(spark):
    docs = spark.range(languages.LANGUAGES + 1).selectExpr("id AS doc_id", "'text' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError, match="languages"):
        languages.learn(docs)
