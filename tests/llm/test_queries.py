"""The registered queries over tables in files, against libraries and plain recounts."""

import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from rankmill.llm import bpe, digests, packing, quality, registry, token_counts

TEXTS = [None, "", "x", "Some plain words, 12 of them.", "Ünïcode 日本語 😀", "long words and more words. " * 900, "same text", "same text", "  spaces\n\nlines ", "a" * 700]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    rows = [(i * 3, t, "odd", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(2).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i * 3, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{base}/empty/documents.parquet")
    return str(base), {d: t or "" for d, t, *_ in rows}


def collected(spark, name, where):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, where).collect()}


def test_packing_query(spark, folder):
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), registry.QUERIES["op1_packing"](spark, folder[0]).collect()
    for d, text in folder[1].items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        own, at = sorted((p for p in pieces if p["doc_id"] == d), key=lambda p: p["start"]), 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    held = {}
    for p in pieces:
        held.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in held.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)]])[:-1].tolist() and sum(n for _, n in places) <= 4096
    assert registry.QUERIES["op1_packing"](spark, f"{folder[0]}/empty").collect() == []


def test_padding_is_small_however_the_table_is_split(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "repeat(concat('word', id % 91, ' '), cast(100 + id * 37 % 523 as int)) AS text").repartition(32)
    pieces = packing.pack(docs).collect()
    windows = len({p["sequence_id"] for p in pieces})
    assert sum(p["length"] for p in pieces) > 0.99 * 4096 * windows
    # groups closed by tokens hold each id once too
    assert sum(p["length"] for p in packing.pack(docs, group_tokens=5000).collect()) == sum(p["length"] for p in pieces)


def test_few_long_documents_use_each_core(spark):
    cores = spark.sparkContext.defaultParallelism
    long = spark.range(40, numPartitions=40).selectExpr("id AS doc_id", "repeat('some words ', 100000) AS text")
    assert packing.tasks(long, 800, 4_000_000) == cores
    assert packing.tasks(long, 800, 100_000) == 40 * 1_100_000 // 300_000
    assert packing.tasks(long.selectExpr("doc_id", "'short' AS text"), 800, 4_000_000) == 1
    assert packing.tasks(spark.range(5000).selectExpr("id AS doc_id", "'short' AS text"), 800, 4_000_000) == 6
    assert packing.tasks(long.limit(0), 800, 4_000_000) == 1


def test_encoding_query(spark, folder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = collected(spark, "op3_byte_bpe", folder[0])
    for d, text in folder[1].items():
        ids = library.encode_ordinary(text)
        assert tuple(out[d]) == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    # all ids of the ranks are reached by merging, so that no whole piece needs a look-up of its own
    coder = bpe.ByteLevel(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    some = sorted(ranks, key=ranks.get)[256::97]
    at = np.r_[0, np.cumsum([len(t) for t in some])]
    flat, _, sizes = coder.merger.merge(coder.first[np.frombuffer(b"".join(some), np.uint8)], at)
    assert (sizes == 1).all() and sorted(flat.tolist()) == sorted(ranks[t] for t in some)


def test_token_count_query(spark, folder):
    library = token_counts.PrefixCounter(P.path("piece_bpe_32k.model")).library
    out = collected(spark, "op8_token_counts", folder[0])
    for d, text in folder[1].items():
        n = len(library.encode(text))
        assert (out[d]["n_bytes"], out[d]["n_tokens"], out[d]["over_limit"]) == (len(text.encode()), n, n > 4096)
        fits = out[d]["fitting_chars"]
        assert len(library.encode(text[:fits])) <= 4096 and (fits == len(text) or len(library.encode(text[: fits + 1])) > 4096)
    assert any(r["over_limit"] for r in out.values()) and registry.QUERIES["op8_token_counts"](spark, f"{folder[0]}/empty").collect() == []


def plain_digest(text):
    """The fingerprint by a loop over windows, without numpy."""
    raw, count = text.encode(), [0] * 128
    for places, f in zip(digests.TRIPLETS, digests.FACTORS, strict=True):
        for i in range(len(raw) - places[2]):
            a, b, c = (raw[i + p] for p in places)
            h = (a * f[0] * 0x10001 + b * f[1] * 0x101) % 2**32 ^ c * f[2] * 0x1001 % 2**32
            count[h * 0x9E3779B1 % 2**32 >> 25] += 1
    q1, q2, q3 = (sorted(count)[k] for k in (31, 63, 95))
    code = [(n > q1) + (n > q2) + (n > q3) for n in count]
    body = bytes(code[i] << 6 | code[i + 1] << 4 | code[i + 2] << 2 | code[i + 3] for i in range(0, 128, 4))
    ratios = (q1 * 15 // q3 if q3 else 0) << 4 | (q2 * 15 // q3 if q3 else 0)
    return (bytes([hashlib.blake2b(raw, digest_size=1).digest()[0], min(255, int(8 * math.log2(len(raw) + 1))), ratios]) + body).hex(), code


def test_fingerprint_query(spark, folder):
    out, ids = collected(spark, "op9_fingerprints", folder[0]), sorted(folder[1])
    for d, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, following = folder[1][d], folder[1][after]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        (mark, code), (new_mark, new_code), (_, next_code) = map(plain_digest, (text, new, following))
        assert (out[d]["n_chars"], out[d]["edited_sha256"], out[d]["fingerprint"], out[d]["edited_fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), mark, new_mark)
        for name, other, same in (("near_edited", new_code, mark == new_mark), ("near_next", next_code, text == following)):
            least = sum((0, 1, 2, 6)[abs(a - b)] for a, b in zip(code, other, strict=True))
            assert 0 <= out[d][name] <= 1 and (out[d][name] == 1 if same else out[d][name] <= max(0.0, 1 - least / digests.BOUND) + 1e-12)
            assert out[d][name] >= 1 - (least + 24 + 60 + 1) / digests.BOUND


def test_quality_query(spark, folder):
    out = collected(spark, "op2_quality_classifier", folder[0])
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= quality.THRESHOLD) and 0 <= r["score"] <= 1
    assert set(out) == set(folder[1])


def test_sql_of_the_join(spark, folder):
    import duckdb

    own = duckdb.connect()
    near = " ".join(f"w{i}" for i in range(60))
    extra = [(1000, near), (1001, near + " end"), (1002, "Start " + near), (1003, near.upper()), (1004, "one"), (1005, "ONE")]
    rows = [*folder[1].items(), *extra]
    base = f"{folder[0]}/join"
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{base}/documents.parquet")
    own.execute(f"CREATE VIEW documents AS SELECT * FROM '{base}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_shingles", "component_id", "n_links"]
    found = sorted(map(tuple, registry.QUERIES["op10_ngram_jaccard"](spark, base).select(columns).collect()))
    assert found == sorted(map(tuple, own.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL['op10_ngram_jaccard']})").fetchall()))
