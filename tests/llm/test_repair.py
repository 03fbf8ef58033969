"""Repairs against trying all edits, and pieces against whole conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rankmill.llm import registry, repair

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn int, role string, text string, n int"


def exhaustive(rows, inserted=3):
    """The cheapest edits of (role, fault) rows by trying all of them, with up to so many inserted turns; (cost, audit, initials)."""
    choices = []
    for role, fault in rows:
        gone = [(4, "D", "")]
        charge = 3 if fault == "truncated" else 0
        kept = [] if fault in ("blank", "duplicate") else [(charge, "K", role[:1] or "?"), (3 + charge, "R", "u"), (3 + charge, "R", "a")]
        choices.append(gone + kept)
    extra = [list(x) for k in range(inserted + 1) for x in itertools.product("ua", repeat=k)]
    best = None
    for edits in itertools.product(*choices):
        for new in extra:
            for places in itertools.combinations_with_replacement(range(len(edits) + 1), len(new)):
                line, audit, cost, at = "", "", 3 * len(new), 0
                for i in range(len(edits) + 1):
                    while at < len(new) and places[at] == i:
                        line, audit, at = line + new[at], audit + "I", at + 1
                    if i < len(edits):
                        cost, audit, line = cost + edits[i][0], audit + edits[i][1], line + edits[i][2]
                if LEGAL.fullmatch(line) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, line)
    return best


def test_the_search_finds_what_trying_all_edits_finds():
    roll = random.Random(5)
    for _ in range(150):
        rows = [(roll.choice(["system", "user", "assistant", "assistant", "", "tool"]), roll.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(roll.randrange(4))]
        (cost, audit), *_ = repair.search([(r[:1], f, 1) for r, f in rows]).values()
        assert (cost, audit) == exhaustive(rows)[:2], rows
        lines = repair.repaired([(r, "x", 1) for r, _ in rows], audit)
        assert "".join(x[0] for x in lines) == exhaustive(rows)[2]


def test_counted_copies_are_the_same_as_rows_of_their_own():
    roll = random.Random(6)
    for _ in range(200):
        counted = [(roll.choice("suax"), roll.choice(["", "truncated", "blank"]), roll.randrange(1, 4)) for _ in range(roll.randrange(5))]
        single = [x for r, f, n in counted for x in [(r, f, 1), *[(r, f if f == "blank" else "duplicate", 1)] * (n - 1)]]
        assert repair.search(counted) == repair.search(single)


def test_joined_pieces_cost_and_edit_what_the_whole_does():
    roll = random.Random(7)
    for _ in range(60):
        items = [(roll.choice("suuaax"), roll.choice(["", "", "", "truncated", "duplicate"]), roll.choice([1, 1, 2])) for _ in range(roll.randrange(1, 40))]
        cuts = sorted({0, len(items), *[roll.randrange(len(items)) for _ in range(4)]})
        parts = [items[a:b] for a, b in itertools.pairwise(cuts)]
        cost, path = repair.join_pieces([{e: repair.search(p, e, tuple(repair.MOVES), each=True) for e in repair.MOVES} for p in parts])
        ((whole_cost, whole),) = repair.search(items).values()
        assert (cost, "".join(a for _, a in path)) == (whole_cost, whole)


def plain(rows):
    """What the query gives for damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32], r[1], r[2]))
    seen, marked = set(), []
    for _, role, text in rows:
        core = text.rstrip(repair.SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    count = lambda f: sum(x[2] == f for x in marked)
    ((cost, audit),) = repair.search([(r[:1], f, 1) for r, _, f in marked]).values()
    lines = repair.repaired([(r, t, 1) for r, t, _ in marked], audit)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    return (gaps, count("blank"), count("duplicate"), count("truncated"), wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def odd():
    """conv_id -> rows (turn, role, text), with what could go wrong."""
    roll = random.Random(8)
    said = ["Yes.", "no", " ", "", "Ünï 😀!", "a: b\nc?", "Yes.", "long " * 500 + "."]
    rows = {c: [(roll.choice([None, *range(9)]), roll.choice(["system", "user", "assistant", "", " ", "r" * 40 + str(roll.randrange(3))]), roll.choice(said)) for _ in range(roll.randrange(1, 12))] for c in [*range(40), None]}
    rows[100] = [(t, ("user", "assistant")[t % 2], f"line {t % 50}.") for t in range(400)]
    rows[101] = [(3, "user", "again.")] * 300
    rows[102] = [(None, "assistant", f"{i}") for i in range(60)]
    return rows


@pytest.mark.parametrize("most", [1024, 3])
def test_every_conversation_is_repaired_whole_or_in_pieces(spark, odd, most):
    flat = [(c, *r, 1) for c, rows in odd.items() for r in rows]
    found = repair.repair(spark.createDataFrame(flat, SCHEMA).repartition(3), most).collect()
    assert len(found) == len(odd)
    for r in found:
        assert tuple(r[c] for c in COLUMNS) == plain(odd[r["conv_id"]]), r["conv_id"]


def harmed(conv, turn, role, text):
    """The damage, row by row."""
    show = lambda x: " " if x is None else str(x)
    kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
    role, text = show(role), show(text)
    if kind == 1:
        text = ""
    elif kind == 2:
        text = re.sub("[.!?]", "", text)
    elif kind == 4:
        role = "user"
    return [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def test_query(spark, odd, tmp_path):
    flat = [(c, *r, "clash") for c, rows in odd.items() for r in rows] + [(500, None, None, None, ""), (501, 1, None, "So it is.", ""), (501, 2, "assistant", None, "")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    flat.append((dropped, 0, "user", "Gone.", ""))
    frame = spark.createDataFrame(flat, "conv_id long, turn int, role string, text string, n string")
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in registry.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    after = {}
    for c, turn, role, text, _ in flat:
        after.setdefault(c, []).extend(harmed(c, turn, role, text))
    assert found.keys() == after.keys()
    for c, rows in after.items():
        assert found[c] == (plain(rows) if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), c
    assert not after[dropped]
    assert registry.QUERIES["op12_conversation_repair"](spark, f"{tmp_path}/empty").collect() == []
