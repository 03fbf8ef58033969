import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from rankmill.llm import quality
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import spans


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(160):
        if i % 8 == 0:
            text = " ".join(f"BUY!!! {r.choice(['NOW', 'GOLD', 'PILLS'])}$$$" for _ in range(60))
        else:
            text = " ".join(r.choice(words) for _ in range(80))
        rows.append((i, text))
    for i in range(160, 200):
        base = rows[r.randrange(1, 8)][1].split(" ")
        for _ in range(r.randrange(3)):
            base[r.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base)))
    rows += [(200, rows[9][1] + " token=abcdef123456"), (201, rows[10][1] + " and then some more words with AKIA" + "B" * 20), (202, None), (203, ""), (204, "short text")]
    return [(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in rows]


def redacted(text):
    out, at = [], 0
    for start, _, kind, end in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def test_stages_and_run_match_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.score(read, *quality.fit(read, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    kept = [(d, t) for d, t, *_ in rows if scores[d] >= quality.THRESHOLD]
    assert {d for d, _ in kept} >= {d for d, *_ in rows[:160] if d % 8} and not {d for d, _ in kept} & set(range(0, 160, 8))
    firsts = {d: t for d, _, c in brute(kept, 5, 80, 100) for e, t in kept if e == d == c}
    assert len(firsts) < len(kept)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = {d: np.array([*library.encode(redacted(t) or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in firsts.items()}
    found = {}
    for p in sorted(out, key=lambda p: p["start"]):
        found[p["doc_id"]] = found.get(p["doc_id"], b"") + bytes(p["ids"])
    assert found == expected


def test_all_but_the_last_stage_keep_the_columns(spark, tmp_path):
    rows = corpus(4)[:40] + [(None, "without an id", "en", None, 13), (1, corpus(4)[1][1], "en", "src1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert (after.columns, [t for _, t in after.dtypes]) == (docs.columns, [t for _, t in docs.dtypes]), name
        ids = [r["doc_id"] for r in after.collect()]
        assert None in ids and stage(spark, docs.limit(0), str(tmp_path)).collect() == []
        if name == "near_duplicates":
            assert ids.count(1) == 1
