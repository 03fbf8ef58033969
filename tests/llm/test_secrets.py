import hashlib
import random
import re

from rankmill.llm.secrets import BASE_RULES, RULES, clauses, scan_secrets, stage_secrets

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def spans(text, rules=None):
    out = []
    for rank, r in enumerate(rules or RULES):
        pattern, group, least = BASE.get(r.kind) or (re.compile(r.pattern), r.group, r.least)
        out += [(m.start(), rank, r.kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def texts():
    r = random.Random(4)
    pieces = ["password", "Token", "api_key", "APIKEY", "secret", "=", " : ", '"', "'", "abc12", "abc123=", "AKIA", "ABCDEFGH12345678", "AKIA44", "deadbeef", "0123456789abcdef", "é", "日", "\n", " ", "x", "token=secret", ":", "=é", "ghp_", "a" * 36, "eyJabcdefgh1.", "😀", "https://u:", "pass1@h", "-----BEGIN RSA PRIVATE KEY-----", "Authorization: Bearer "]
    out = [None, "", "none", 'secret="token":abcdefg', "password = hunter2x", "PASSWD:'" + "a" * 5 + "' x", "f" * 23, "f" * 24, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "é token=abcdef", "x" * 200_000 + " token=abcdef"]
    return out + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(400)]


def test_spans_match_brute_force(spark):
    given = [*texts(), "token=abcdef", "token=abcdef"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(given)], "doc_id long, text string, kinds string, spans int")
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in scan_secrets(df).collect()}
    assert len(found) == len(given)
    for i, t in enumerate(given):
        assert found[i] == spans(t), t


def test_candidates_lose_no_match():
    for r in RULES:
        for t in texts():
            if t and re.search(r.pattern, t):
                assert any(all(g in t.lower() for g in c) for c in clauses(r.pattern)), (r.kind, t)
    assert clauses(BASE_RULES[2].pattern) == [frozenset()]
    assert sorted(map(sorted, clauses("a(?:bcd|xyz)?e"))) == [[]]


def test_stage_redacts_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "see token=abcdef1 and é AKIA" + "B" * 20 + " end", "en"), (None, None, "de"), (3, "clean", None), (4, "", "x")], "doc_id long, text string, row string")
    out = stage_secrets(spark, df, "")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "see [assign] and é [access] end", "en"), (None, None, "de"), (3, "clean", None), (4, "", "x")], key=str)


def test_query_digests(spark, tmp_path):
    from rankmill.llm.secrets import op6_secret_scans

    given = texts()
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op6_secret_scans(spark, str(tmp_path)).collect()}
    for i, t in enumerate(given):
        base = spans(t, BASE_RULES)
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert rows[i]["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans(t))
        assert [rows[i][f"n_{r.kind}"] for r in BASE_RULES] == [sum(s[2] == r.kind for s in base) for r in BASE_RULES]
