"""Repair of conversations by A* over the edit lattice.

A state is how many of a conversation's rows are done and the last role that was given (none, system, user, assistant). Keeping a
row costs 0, giving it the role user or assistant 3, deleting it 4, inserting an empty user or assistant turn 3; a row whose
text is cut off costs 3 more unless it is deleted; blank and repeated rows must go. What is reached is empty, or an optional
system turn and then pairs of user and assistant. States leave the heap by (cost + heuristic, audit). The heuristic is the
sum over the rows to come of what can't be avoided: each deletion that must be, and 3 for each text cut off. It never
falls by more than a step costs, so the first time that a goal leaves the heap its cost is least, and of the cheapest
audits (the edits' initials) its own is the first in ASCII.

Equal rows of one turn are counted before anything is shuffled; which text was said earlier comes from a grouping by text and
role, not from a conversation as a whole. Rows are then sorted by conversation and turn in ranges, so a conversation may
lie in several tasks. One that ends in the task where it began, within a piece's bounds, is done there. Of any other each piece
gives the cheapest audits from each state to each state; these are joined in order (audits concatenate, costs add up), and each
piece is repaired by its own part of the audit. The digest of a conversation in pieces is streamed over the pieces' repaired texts.

Defined cases: a null role or text is one space, so is a null id or turn in the checksum; null turns come first and don't count for
gaps; rows of one turn are ordered by role and text (first by 32 characters of each); a null id is a conversation; repeated
rows are rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: state -> initial of the next role -> state: 0 nothing yet, 1 system, 2 user, 3 assistant
MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"
PIECE_ROWS, PIECE_CHARS = 1024, 4_000_000

Item = tuple[str, str, int]  # role's initial, fault ("blank", "duplicate", "truncated", ""), how often


def search(items: list[Item], entry: int = 0, exits: tuple = FINAL, each: bool = False) -> dict[int, tuple[int, str]]:
    """The cheapest audit from a state to the exits: to the best of them, or with ``each`` to every one that can be reached.

    An item's further copies are deleted right behind it: no audit that does otherwise comes before.
    """
    rest = [0] * (len(items) + 1)
    for i in range(len(items) - 1, -1, -1):
        _, fault, n = items[i]
        rest[i] = rest[i + 1] + DELETE * (n - 1) + {"blank": DELETE, "duplicate": DELETE, "truncated": TRUNCATED}.get(fault, 0)
    heap, closed, found = [(rest[0], "", 0, entry)], set(), {}
    while heap and len(found) < (len(exits) if each else 1):
        f, audit, i, q = heapq.heappop(heap)
        if (i, q) in closed:
            continue
        closed.add((i, q))
        cost = f - rest[i]
        if i == len(items) and q in exits:
            found[q] = (cost, audit)
        steps = [(INSERT, "I", i, p) for r, p in MOVES[q].items() if r in ROLES]
        if i < len(items):
            initial, fault, n = items[i]
            more, gone = DELETE * (n - 1), "D" * (n - 1)
            steps.append((DELETE + more, "D" + gone, i + 1, q))
            if fault in ("", "truncated"):
                charge = more + (TRUNCATED if fault else 0)
                steps += [(REROLE + charge, "R" + gone, i + 1, p) for r, p in MOVES[q].items() if r in ROLES]
                if initial in MOVES[q]:
                    steps.append((KEEP + charge, "K" + gone, i + 1, MOVES[q][initial]))
        for price, edit, j, p in steps:
            if (j, p) not in closed:
                heapq.heappush(heap, (cost + price + rest[j], audit + edit, j, p))
    return found


def repaired(rows: list[tuple[str, str, int]], audit: str, entry: int = 0) -> list[str]:
    """The lines ``role:text`` that an audit makes of rows (role, text, how often); the state it begins in decides new roles."""
    out, state, edits = [], entry, iter(audit)
    for role, text, n in rows:
        for edit in edits:
            if edit == "D":
                break
            initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
            state = MOVES[state][initial]
            out.append(f"{role if edit == 'K' else ROLES[initial]}:{text if edit != 'I' else ''}")
            if edit != "I":
                break
        for _ in range(n - 1):
            next(edits)
    for _ in edits:  # inserted at the end
        initial = "a" if state == 2 else "u"
        state = MOVES[state][initial]
        out.append(f"{ROLES[initial]}:")
    return out


def join_pieces(pieces: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost over a conversation's pieces (entry -> exit -> (cost, audit)), and of each piece its entry and audit.

    What the surviving audits have in common isn't compared again.
    """
    reached, back = {0: (0, "")}, []
    for ways in pieces:
        options: dict[int, list] = {}
        for entry, (cost, audit) in reached.items():
            for at, (more, edits) in ways[entry].items():
                options.setdefault(at, []).append((cost + more, audit + edits, entry))
        best = {at: min(found) for at, found in options.items()}
        back.append({at: entry for at, (_, _, entry) in best.items()})
        shared = len(os.path.commonprefix([audit for _, audit, _ in best.values()]))
        reached = {at: (cost, audit[shared:]) for at, (cost, audit, _) in best.items()}
    cost, _, at = min((*reached[at], at) for at in FINAL if at in reached)
    path = []
    for ways, came in zip(reversed(pieces), reversed(back), strict=True):
        entry = came[at]
        path.append((entry, ways[entry][at][1]))
        at = entry
    return cost, path[::-1]


# -- rows and their faults ---------------------------------------------------------------------------------------------


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage, with ``n``, how often."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = table.select(table["conv_id"].cast("bigint").alias("conv_id"), table["turn"].cast("bigint").alias("turn"), table["role"].alias("role"), table["text"].alias("text"))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, with ``n`` and the first fault of the first of them."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # texts that come in several turns: the first such turn (null before all)
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    again = once.groupBy("conv_id", "role", "text").agg(F.count("*").alias("turns"), F.min(order).alias("first")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "first")
    joined = once.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    core = F.rtrim("text", F.lit(SPACE))
    fault = F.when(core == "", "blank").when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


_WAY = "struct<entry:int,at:int,cost:bigint,audit:string>"
_ROW = "struct<role:string,text:string,n:bigint>"
PIECES = f"conv_id bigint, piece bigint, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, cost bigint, audit string, repaired_sha256 string, ways array<{_WAY}>, rows array<{_ROW}>"
_ARROW_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("at", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_ARROW_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))
_ARROW_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("first", pa.string()), ("last", pa.string()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("ways", _ARROW_WAYS), ("rows", _ARROW_ROWS),
])


def sha256(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def illegal(pair: str) -> bool:
    return pair not in ("su", "ua", "au")


def _piece(conv, number: int, rows: list, whole: bool) -> dict:
    """What is known of some consecutive rows (role, text, n, fault); of a whole conversation its repair."""
    items = [(role[:1], fault, n) for role, _, n, fault in rows]
    of = lambda kind: sum(n for _, _, n, fault in rows if fault == kind)
    copies = sum(n - 1 for _, _, n, fault in rows if fault in ("", "truncated"))
    wrong = sum(n - 1 for _, _, n, _ in rows) + sum(illegal(a[0] + b[0]) for a, b in itertools.pairwise(items))
    out = {"conv_id": conv, "piece": number, "whole": whole, "blank": of("blank"), "duplicate": of("duplicate") + copies, "truncated": sum(fault == "truncated" for *_, fault in rows), "illegal": wrong, "first": items[0][0], "last": items[-1][0]}
    plain = [r[:3] for r in rows]
    if whole:
        (cost, audit), *_ = search(items).values()
        return out | {"cost": cost, "audit": audit, "repaired_sha256": sha256(repaired(plain, audit)), "ways": None, "rows": None}
    ways = [{"entry": entry, "at": at, "cost": cost, "audit": audit} for entry in MOVES for at, (cost, audit) in search(items, entry, tuple(MOVES), each=True).items()]
    return out | {"cost": None, "audit": None, "repaired_sha256": None, "ways": ways, "rows": [{"role": r, "text": t, "n": n} for r, t, n in plain]}


def pieces(rows: DataFrame, most_rows: int = PIECE_ROWS, most_chars: int = PIECE_CHARS) -> DataFrame:
    """Rows in ranges of conversation and turn -> runs of them, most of them whole conversations."""

    def run(batches):
        part = TaskContext.get().partitionId()
        numbers = itertools.count(part << 40)

        def stream():
            for batch in common.slices(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "fault")), strict=True)

        def runs():
            """(conv_id, rows, whether the conversation begins here, whether it ends here)"""
            first = True
            for conv, group in itertools.groupby(stream(), key=lambda r: r[0]):
                held, chars, begins = [], 0, True
                for _, *row in group:
                    if held and (len(held) >= most_rows or chars + len(row[1]) > most_chars):
                        yield conv, held, begins and not first, False
                        held, chars, begins = [], 0, False
                    held.append(tuple(row))
                    chars += len(row[1])
                yield conv, held, begins and not first, True
                first = False

        def numbered():
            before = None
            for now in runs():
                if before:
                    conv, rows, begins, ends = before
                    yield _piece(conv, next(numbers), rows, begins and ends)
                before = now
            if before:  # its conversation may go on in the next range
                yield _piece(before[0], next(numbers), before[1], False)

        for some in itertools.batched(numbered(), 64):
            yield pa.RecordBatch.from_pylist(list(some), schema=_ARROW_PIECE)

    start = lambda c: F.substring(c, 1, 32)  # noqa: E731  # bounds of ranges stay small
    keyed = rows.withColumns({"r": start("role"), "t": start("text")})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "conv_id", "turn", "r", "t").sortWithinPartitions("conv_id", "turn", "r", "t", "role", "text")
    return dealt.select("conv_id", "role", "text", "n", "fault").mapInArrow(run, PIECES)


def _groups(batches, columns: tuple):
    def stream():
        for batch in common.slices(batches, 16):
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    return itertools.groupby(stream(), key=lambda r: r[0])


_JOINED = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, piece bigint, entry int, edits string"
_COUNTED = ("blank", "duplicate", "truncated", "illegal")


def _join(parts: DataFrame) -> DataFrame:
    """A row per piece with its entry and edits; the conversation's counts, cost and audit stand in that of its first piece."""

    def run(batches):
        for conv, group in _groups(batches, ("conv_id", "piece", *_COUNTED, "first", "last", "ways")):
            group = list(group)
            ways = [{e: {w["at"]: (w["cost"], w["audit"]) for w in g[-1] if w["entry"] == e} for e in MOVES} for g in group]
            cost, path = join_pieces(ways)
            totals = {c: sum(g[2 + i] for g in group) for i, c in enumerate(_COUNTED)}
            totals["illegal"] += sum(illegal(a[-2] + b[-3]) for a, b in itertools.pairwise(group))
            whole = totals | {"cost": cost, "audit": "".join(a for _, a in path)}
            for i, (g, (entry, edits)) in enumerate(zip(group, path, strict=True)):
                yield {"conv_id": conv, "piece": g[1], "entry": entry, "edits": edits, **(whole if i == 0 else dict.fromkeys(whole))}

    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTED], ("cost", pa.int64()), ("audit", pa.string()), ("piece", pa.int64()), ("entry", pa.int32()), ("edits", pa.string())])
    dealt = parts.select("conv_id", "piece", *_COUNTED, "first", "last", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return dealt.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist(list(some), schema=schema) for some in itertools.batched(run(batches), 64)), _JOINED)


def _digests(parts: DataFrame, joined: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: pieces are repaired where they are; their texts are streamed in order, none is gathered."""

    def repair(batches):
        for batch in common.slices(batches, 16):
            texts = ["\n".join(repaired([(r["role"], r["text"], r["n"]) for r in rows], edits, entry)) for rows, edits, entry in zip(*(batch.column(c).to_pylist() for c in ("rows", "edits", "entry")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(texts, pa.string())], names=["conv_id", "piece", "text"])

    def digest(batches):
        for conv, group in _groups(batches, ("conv_id", "piece", "text")):
            whole, any_yet = hashlib.sha256(), False
            for *_, text in group:
                if text:  # a line is never empty
                    whole.update((("\n" if any_yet else "") + text).encode())
                    any_yet = True
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([whole.hexdigest()])], names=["conv_id", "repaired_sha256"])

    made = parts.select("conv_id", "piece", "rows").join(joined.select("piece", "entry", "edits"), "piece").select("conv_id", "piece", "rows", "edits", "entry").mapInArrow(repair, "conv_id bigint, piece bigint, text string")
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(digest, "conv_id bigint, repaired_sha256 string")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair(rows: DataFrame, most_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit and repaired_sha256 of rows (conv_id, turn, role, text, n)."""
    scratch = common.Scratch(rows.sparkSession, "repair")
    marked = scratch.keep(faults(rows), "marked")
    known = F.col("turn").isNotNull()
    gaps = marked.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if(known), F.lit(0)).alias("gaps"))
    held = scratch.keep(pieces(marked, most_rows), "pieces")
    wanted = ["conv_id", *_COUNTED, "cost", "audit", "repaired_sha256"]
    parts = held.where(~F.col("whole"))
    joined = scratch.keep(_join(parts), "joined")
    digests = _digests(parts, joined).select(F.col("conv_id").alias("c"), "repaired_sha256")
    long = joined.where("cost IS NOT NULL").join(digests, same(F.col("conv_id"), F.col("c"))).select(wanted)
    done = held.where("whole").select(wanted).unionByName(long)
    gaps = gaps.withColumnRenamed("conv_id", "g")
    return done.join(gaps, same(F.col("conv_id"), F.col("g"))).drop("g")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table after damage: its faults, and the cheapest repair."""
    table = common.table(spark, sf_dir, "conversations")
    done = repair(damaged(table)).withColumnRenamed("conv_id", "c")
    every = table.select(table["conv_id"].cast("bigint").alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return every.join(done, same(F.col("conv_id"), F.col("c")), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", *_COUNTED, "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


#: The same by dynamic programming over rows and states, in SQL; checksums by their table of 256 remainders, made from the polynomial.
SQL = r"""
WITH RECURSIVE poly AS (
    SELECT [list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t
), coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')],
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, poly
), harmed AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded
), convs AS (
    SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
    SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed JOIN convs ON convs.conv_id IS NOT DISTINCT FROM harmed.conv_id
), lines AS (
    SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before
    FROM placed
), faults AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM lines GROUP BY c
), inserts(p, q, price, edits, said) AS (
    SELECT p, p, 0, '', '' FROM unnest([0, 1, 2, 3]) AS x(p) UNION ALL SELECT p, 2, 3, 'I', chr(10) || 'user:' FROM unnest([0, 1, 3]) AS x(p)
    UNION ALL VALUES (2, 3, 3, 'I', chr(10) || 'assistant:') UNION ALL SELECT p, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:' FROM unnest([0, 1, 3]) AS x(p)
), moves(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), steps AS (
    SELECT c, i, p, q, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS price, 'K' AS edit, chr(10) || role || ':' || text AS said FROM lines JOIN moves USING (r) WHERE fault IN ('', 'truncated')
    UNION ALL SELECT c, i, p, q, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || CASE m.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM lines, moves m WHERE fault IN ('', 'truncated') AND m.r <> 's'
    UNION ALL SELECT c, i, p, p, 4, 'D', '' FROM lines, unnest([0, 1, 2, 3]) AS x(p)
), best AS (
    SELECT c, CAST(0 AS BIGINT) AS i, q, printf('%08d', price) || edits AS k, said AS text FROM faults, inserts WHERE p = 0
    UNION ALL
    SELECT c, i, q, min(k), arg_min(text, k) FROM (
        SELECT b.c, s.i, n.q, printf('%08d', CAST(b.k[:8] AS BIGINT) + s.price + n.price) || b.k[9:] || s.edit || n.edits AS k, b.text || s.said || n.said AS text
        FROM best b JOIN steps s ON s.c = b.c AND s.i = b.i + 1 AND s.p = b.q JOIN inserts n ON n.p = s.q) GROUP BY c, i, q
), chosen AS (
    SELECT c, min(k) AS k, arg_min(text, k) AS text FROM best JOIN faults USING (c) WHERE best.i = n AND q IN (0, 3) GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(CAST(k[:8] AS BIGINT), 0) AS cost, coalesce(k[9:], '') AS audit, sha256(coalesce(text[2:], '')) AS repaired_sha256
FROM convs LEFT JOIN faults USING (c) LEFT JOIN chosen USING (c)
"""
