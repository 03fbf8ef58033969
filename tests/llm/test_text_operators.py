import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rankmill.llm import bpe, digests, licenses, packing, quality, token_counts

ODD = [None, "", " ", "a", "  two  spaces ", "\n\n\nlines\n", "Ünïcode ñandú", "日本語 テキスト", "😀 emoji 😀", "it's DON'T 12½", "x" * 3000, "ab" * 400 + "xyz" * 90, "<|endoftext|> inside", "▁ under ▁", "tab\tand\x0bfeed\x0c", "plain words of a text, and more. " * 300, "same", "same", "\x01 \x1c \x85 \xa0 end", "<s> </s> <unk>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", 1, 0.5) for i, t in enumerate(ODD)] + [(None, "no id", "extra", 1, 0.5), (3, "a", "extra", 1, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int, score double").repartition(3)


def given(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)


def test_encoding_is_the_librarys_and_decodes_to_the_text(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.encode_decode(docs).collect()), key=str)
    assert len(out) == docs.count()
    expected = []
    for d, t in given(docs):
        ids = library.encode_ordinary(t)
        expected.append((d, len(ids), np.array(ids, "<u4").tobytes(), t.encode()))
    assert out == sorted(expected, key=str)
    assert bpe.encode_decode(docs.limit(0)).collect() == []


def test_token_counts_are_the_librarys(spark, docs):
    counter = token_counts.PrefixCounter(P.path("piece_bpe_32k.model"))
    out = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"], r["fitting_chars"]) for r in token_counts.count_tokens(docs, limit=20).collect()}
    expected = set()
    for d, t in given(docs):
        prefixes = [len(counter.library.encode(t[:i])) for i in range(min(len(t), 120) + 1)]
        n = len(counter.library.encode(t))
        expected.add((d, len(t.encode()), n, n > 20, len(t) if n <= 20 else max(i for i, c in enumerate(prefixes) if c <= 20)))
    assert out == expected


def test_prefix_table_answers(spark):
    df = spark.createDataFrame([(1, "Some words, 123 and é日 at the end"), (2, None)], "doc_id long, text string")
    table = token_counts.prefix_table(df)
    counter = token_counts.PrefixCounter(P.path("piece_bpe_32k.model"))
    rows = {r["doc_id"]: r for r in table.select("doc_id", "prefix_tokens", token_counts.tokens_of_prefix("prefix_tokens", 9).alias("nine"), token_counts.longest_prefix("prefix_tokens", 6).alias("six")).collect()}
    text = "Some words, 123 and é日 at the end"
    counts = [len(counter.library.encode(text[:i])) for i in range(len(text) + 1)]
    assert rows[1]["prefix_tokens"] == counts
    assert rows[1]["nine"] == counts[9]
    assert rows[1]["six"] == max(i for i, c in enumerate(counts) if c <= 6)
    assert (rows[2]["prefix_tokens"], rows[2]["nine"], rows[2]["six"]) == ([0], 0, 0)


def test_packing_holds_each_id_once(spark, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = packing.pack(docs, group_docs=5, capacity=64, grain=24).collect()
    windows, texts = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    for p in sorted(pieces, key=lambda p: p["start"]):
        if p["doc_id"] not in (None, 3):
            texts[p["doc_id"]] = texts.get(p["doc_id"], b"") + bytes(p["ids"])
            assert len(texts[p["doc_id"]]) == 4 * (p["start"] + p["length"])
    for d, t in given(docs):
        if d not in (None, 3):
            assert texts[d] == np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes(), t
    total = sum(p["length"] for p in pieces)
    assert total == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in given(docs))
    assert packing.pack(docs.limit(0)).collect() == []


def test_differencing_balances():
    r = np.random.default_rng(1)
    for n, k in ((1, 1), (5, 3), (40, 7), (300, 40)):
        lengths = r.integers(1, 1000, n)
        window, fullest = packing.difference(lengths, k)
        loads = np.bincount(window, lengths, k)
        assert loads.sum() == lengths.sum() and loads.max() == fullest
        if n >= 40:
            assert fullest <= lengths.sum() / k * 1.1
    window, offset = packing.pack_lengths(np.full(9, 3000), 4096)
    assert len(set(window.tolist())) == 9 and not offset.any()


def test_license_scan(spark):
    texts = {1: "Used under the MIT License. under THE mit license", 2: "Licensed under the Apache License, Version 2.0.", 3: "Licensed under CC BY-NC 4.0.", 4: "nothing at all", 5: None, 6: "SPDX-License-Identifier: BSD-3-Clause-Clear", 7: "This work is licensed under the GNU General Public License, version 3.", 8: "summit license und mit"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, labels string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, t in texts.items():
        words = word.findall((t or "").lower())
        assert rows[k]["n_words"] == len(words)
        base = sorted((label, i) for label, p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert sorted((b["label"], b["first_word"]) for b in rows[k]["base"]) == base
    labels = {k: {d["label"] for d in rows[k]["detections"]} for k in texts}
    assert labels[6] == {"bsd-3-clause-clear"} and labels[7] == {"gpl-3"} and labels[1] == {"mit"} and not labels[4] and not labels[8]
    assert rows[4]["score"] == 0 and 0 < rows[7]["score"] <= 1 and len(licenses.make_rules()) >= 200


def test_tags_and_names_have_the_same_labels():
    scanner = licenses.Scanner()
    of = lambda text: {d[0] for d in scanner.scan(text)["detections"]}
    pairs = {"GPL-2.0-only": "GNU General Public License version 2", "Apache-2.0": "Apache License 2.0", "MPL-2.0": "Mozilla Public License 2.0", "LGPL-2.1-only": "GNU Lesser General Public License 2.1", "GPL-3.0-or-later": "GNU General Public License v3 or later", "MIT-0": "released under the MIT-0 license"}
    for tag, name in pairs.items():
        assert of(f"SPDX-License-Identifier: {tag}") and of(f"SPDX-License-Identifier: {tag}") <= of(name), (tag, of(f"SPDX-License-Identifier: {tag}"), of(name))
    written = {label for label, _, _ in licenses.WRITTEN}
    assert licenses.label_of("bsd 3 clause") == "bsd-3-clause" and licenses.label_of("mit 0") == "mit-0" and licenses.label_of("cc by nc 4 0") == "cc-by-nc"
    assert {licenses.label_of(i) for i in licenses.IDENTIFIERS if i.startswith(("mit", "apache", "mpl", "lgpl 2 1", "cc0", "cddl", "epl", "isc", "zlib"))} <= written | {"lgpl-2.1-or-later"}


def samples(tree):
    """For a parsed pattern, strings that it matches, with each of its branches in one of them."""
    from re import _constants as C

    out = [""]
    for op, value in tree:
        if op is C.LITERAL:
            each = [chr(value)]
        elif op is C.ANY:
            each = ["x"]
        elif op is C.IN:
            each = ["1" if item is C.CATEGORY and arg is C.CATEGORY_DIGIT else "w" if item is C.CATEGORY else chr(arg if item is C.LITERAL else arg[0]) for item, arg in value]
        elif op is C.SUBPATTERN:
            each = samples(value[3])
        elif op is C.BRANCH:
            each = [x for b in value[1] for x in samples(b)]
        else:
            assert op is C.MAX_REPEAT, op
            each = [x * value[0] for x in samples(value[2])] if value[0] else ["", *samples(value[2])]
        each = list(dict.fromkeys(each))
        # each of the new ones with the first of the old, and each of the old with the first of the new
        out = list(dict.fromkeys([out[0] + e for e in each] + [o + each[0] for o in out]))
    return out


def test_license_gate_accepts_what_rules_match():
    from re import _parser

    scanner, tried = licenses.Scanner(), 0
    assert len({r.name for r in scanner.rules}) == len(scanner.rules) and len(licenses.WRITTEN) >= 200
    assert len({p for _, _, p in licenses.WRITTEN}) == len(licenses.WRITTEN)
    assert all(min(map(len, r.keywords[0])) >= 4 for r in scanner.rules)
    for rule in scanner.rules:
        own = 0
        for text in samples(_parser.parse(rule.pattern.pattern.removesuffix("(?= )"))):
            line = f"{text} "
            if rule.pattern.search(line):
                own += 1
                hit = {key for _, key in scanner.gate.iter(line)}
                assert not any(c.isdisjoint(hit) for c in rule.keywords), (rule.name, text)
        assert own, rule.name
        tried += own
    assert tried > 2 * len(scanner.rules)
    for text, label in {"under the terms of the GNU Library General Public License version 2": "lgpl-2", "released under the BSL 1.0": "boost-1", "licensed by MIT": "mit", "licensed under the LGPL v2.1": "lgpl-2.1", "released through the PSF license": "python-2", "under the MIT X Consortium license": "x11", "licensed under ASL 2.0": "apache-2"}.items():
        found = scanner.scan(text)
        assert label in {d[0] for d in found["detections"]} and found["score"] > 0, (text, found)


def naive_scan(rules, text):
    """Labels and words of the detections that stay, rule by rule and pair by pair."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line, kept = " " + " ".join(words) + " ", []
    for rule in rules:
        for m in sorted(rule.pattern.finditer(line), key=lambda m: (m.start(), -m.end())):
            if not any(a <= m.start() and m.end() <= b for a, b, _ in kept):
                kept.append((m.start(), m.end(), rule))
    kept.sort(key=lambda k: k[:2])
    return len(words), [(r.label, line[: a + 1].count(" ") - 1, line[:b].count(" ")) for a, b, r in kept], 1 - float(np.prod([1 - r.score for _, _, r in kept]))


def license_texts():
    import random
    from re import _parser

    r, rules = random.Random(2), licenses.make_rules()
    pieces = [s.strip() for rule in rules for s in samples(_parser.parse(rule.pattern.pattern.removesuffix("(?= )")))] + ["under the MIT License", "CC BY-NC", "apache license version 2.", "é", "\n", "word", "GNU", "mit", "license"]
    return [None, "", "...", *[" ".join(r.choice(pieces) for _ in range(r.randrange(1, 30))) for _ in range(120)]]


def test_license_query_is_the_naive_scanners(spark, tmp_path):
    texts, rules = license_texts(), licenses.make_rules()
    spark.createDataFrame([*enumerate(texts), (None, "mit license"), (3, texts[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in licenses.op4_license_scans(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts) + 1
    for d, text in [*enumerate(texts), (None, "mit license")]:
        n, found, score = naive_scan(rules, text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        base = [(i, label) for label, p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        given, starts = out[d], [i for i, _ in base]
        assert (given["n_words"], given["n_base"], given["first_word"], given["last_word"]) == (n, len(base), min(starts, default=None), max(starts, default=None))
        assert given["base_labels"] == ",".join(sorted({x for _, x in base})) and given["labels"] == ",".join(sorted({x for _, x in base} | {x for x, _, _ in found}))
        assert abs(given["score"] - (1.0 if base else score)) < 1e-12
    scanner = licenses.Scanner()
    for text in texts:
        assert [(x, a, b) for x, _, a, b, _ in scanner.scan(text or "")["detections"]] == naive_scan(rules, text)[1]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_dense_license_text_takes_linear_time():
    import time

    text, scanner = " ".join(t for t in license_texts() if t), licenses.Scanner()
    text = (text + " ") * (3_000_000 // len(text) + 1)
    began = time.process_time()
    assert len(scanner.scan(text)["detections"]) > 10_000
    assert time.process_time() - began < 15


def test_fingerprint_pairs(spark, docs, tmp_path):
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"] or "", r["doc_id"]) for r in docs.collect())
    out = digests.fingerprint_pairs(docs, ranges=5).collect()
    assert len(out) == len(rows)
    by_id = {}
    for i, (_, text, d) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        by_id.setdefault(d, set()).add((len(text), hashlib.sha256(digests.edited(text, after).encode()).hexdigest(), digests.digest(text), digests.digest(after)))
    for r in out:
        held = [x for x in by_id[r["doc_id"]] if x[0] == r["n_chars"] and x[1] == r["edited_sha256"]]
        assert held and r["fingerprint"] == held[0][2] and 0 <= r["near_edited"] <= 1
        assert r["near_next"] in {digests.likeness(x[2], x[3]) for x in held}
        assert hashlib.sha256(r["edited"].encode()).hexdigest() == r["edited_sha256"]
    assert digests.fingerprint_pairs(docs.limit(0)).collect() == []


def test_digest_follows_the_text():
    text = " ".join(f"word{i % 97} and some other {i}" for i in range(400))
    a, b = digests.digest(text), digests.digest(text[:5000] + " small edit " + text[5000:])
    other = digests.digest(" ".join(f"quite {i * 7919 % 1000} another matter" for i in range(400)))
    assert digests.likeness(a, a) == 1 and digests.likeness(a, b) > 0.8 > digests.likeness(a, other) >= 0
    long = "abc def " * 300_000
    assert digests.digest(long) == digests.digest(long)


def test_quality_separates_and_holds_out(spark):
    good = [f"the {w} of a small house and the river was long with {w} water" for w in ("old", "red", "cold", "warm", "deep")]
    bad = [f"BUY!! {w}!! NOW!! $$$ {w} {w} {w} {w} CLICK!! ###" for w in ("pills", "gold", "coin", "shoes", "watch")]
    rows = [(i, f"{(good if i % 3 else bad)[i % 5]} {(good if i % 3 else bad)[(i // 5) % 5]}", None) for i in range(300)] + [(300, None, None), (301, "", None), (None, "the old house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    vectors, network = quality.fit(docs, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, network).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) == 303 and all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= 0.3) == (i % 3 > 0) for i in held]) == 1
    kept = quality.score(docs.limit(0), vectors, network).collect()
    assert kept == []
    empty_vectors, constant = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, empty_vectors, constant).collect()} == {0.5}


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7} of words {i % 11}") for i in range(80)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(80)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    scores = []
    for rows in (labels, turned):
        v, n = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        scores.append(sorted((r["doc_id"], r["score"]) for r in quality.score(docs, v, n).collect()))
    assert scores[0] == scores[1]
