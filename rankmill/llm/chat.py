"""Chat formatting by a finite-state machine over roles.

A declarative ``Template`` gives each role the text before and after its turns and says whether its turns are learned.
The machine walks a conversation's turns in order, checks each role against the state, and emits text segments with a
loss flag. Control strings inside texts are escaped, so the output can be read back: ``parse`` gives the turns and the
learned texts of a formatted conversation. Rows are dealt by conversation and sorted within the partition; a partition
is streamed, and one conversation at a time is held.

Defined cases: a null text is an empty one; a null role is the role ""; a role that the template doesn't have is
formatted like any other, not learned, and makes the conversation invalid; so does a turn out of order or a null turn
(those come first); a null conv_id is a conversation of its own; repeated rows are turns of their own, in the order of
turn, role and text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm import common

MARK = "\\"


@dataclass(frozen=True)
class Template:
    """Turns are ``open`` role ``middle`` text ``close``; inside texts and roles each of ``controls`` is escaped."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    learned: tuple = ("assistant",)
    #: What also counts as control strings, though this template doesn't write them.
    others: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    #: state -> role -> next state; a conversation may end in ``final``.
    moves: dict = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple = ("answered",)

    def controls(self) -> re.Pattern:
        found = {self.open, self.middle, self.close, *self.others}
        return re.compile("|".join(map(re.escape, sorted(found, key=lambda x: (-len(x), x)))) + "|" + re.escape(MARK))

    def escape(self, text: str) -> str:
        """A mark before each control string's first character and after it, and before each mark: no control string is left."""
        return self.controls().sub(lambda m: MARK + MARK if m[0] == MARK else m[0][0] + MARK + "." + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: "" if m[1] == "." else m[1], text, flags=re.S)


@dataclass
class Segment:
    text: str
    loss: bool


def segments(turns: list[tuple[str, str]], template: Template) -> tuple[list[Segment], bool]:
    """What the machine emits for (role, text) turns, and whether their order is one that the template allows."""
    state, valid, out = "start", True, []
    for role, text in turns:
        after = template.moves.get(state, {}).get(role) if valid else None
        valid = after is not None
        state = after or state
        learned = role in template.learned
        out += [Segment(template.open + template.escape(role) + template.middle, False), Segment(template.escape(text), learned), Segment(template.close, False)]
    return out, valid and state in template.final


def parse(formatted: str, template: Template) -> list[tuple[str, str, bool]]:
    """(role, text, learned) of each turn in a formatted conversation."""
    out = []
    for turn in formatted.split(template.open)[1:]:
        role, _, rest = turn.partition(template.middle)
        text, closed, beyond = rest.partition(template.close)
        if not closed or beyond:
            raise ValueError("not a formatted conversation")
        role = template.unescape(role)
        out.append((role, template.unescape(text), role in template.learned))
    return out


FORMATTED = "conv_id bigint, formatted string, valid boolean, segments array<struct<text: string, loss: boolean>>"
_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_conversations(rows: DataFrame, template: Template = Template(), *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its formatted text, its segments, and whether the order of its turns is valid."""

    def run(batches):
        def turns():
            for batch in common.slices(batches, 1024):
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

        def flush(held):
            made = [segments(t, template) for _, t in held]
            texts = ["".join(s.text for s in x) for x, _ in made]
            parts = [[{"text": s.text, "loss": s.loss} for s in x] for x, _ in made]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array(texts, pa.string()), pa.array([v for _, v in made], pa.bool_()), pa.array(parts, _SEGMENT)], names=["conv_id", "formatted", "valid", "segments"])

        held, chars = [], 0
        for conv, group in itertools.groupby(turns(), key=lambda r: r[0]):
            held.append((conv, [(role or "", text or "") for _, role, text in group]))
            chars += sum(len(t) for _, t in held[-1][1])
            if chars > 4_000_000:
                yield flush(held)
                held, chars = [], 0
        if held:
            yield flush(held)

    chosen = rows.select(rows[conv_col].alias("c"), rows[turn_col].alias("t"), rows[role_col].cast("string").alias("r"), rows[text_col].cast("string").alias("x"))
    dealt = chosen.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    return dealt.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of the turns and of the learned text, from the formatted text and the loss mask alone; and whether the order of turns is valid."""

    def run(batches):
        for batch in common.slices(batches):
            rows = []
            for conv, text, parts, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "segments", "valid")), strict=True):
                turns = parse(text, template)
                if "".join(s["text"] for s in parts) != text:
                    raise ValueError("the segments aren't the formatted text")
                learned = "".join(template.unescape(s["text"]) for s in parts if s["loss"])
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in turns).encode()).hexdigest()
                rows.append((conv, len(turns), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text), valid))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "segments", "valid").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    template = Template()
    done = format_conversations(rows.unionByName(extra), template)
    return read_back(done, template)


#: The same in SQL: what is added to a text is counted, and the order of turns is a pattern over roles.
SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
    UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]', CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS t(i)
), counted AS (
    SELECT *, len(regexp_extract_all(role || chr(10) || text, CONTROLS)) AS controls, length(role || text) - length(replace(role || text, chr(92), '')) AS marks FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(FRAME + length(role) + length(text) + 2 * controls + marks) AS BIGINT) AS formatted_chars,
    count(*) = count(turn) AND regexp_full_match(string_agg(role, ' ' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST), '(system )?user assistant( user assistant)*') AS valid
FROM counted GROUP BY conv_id
"""
_controls = {Template.open, Template.middle, Template.close, *Template.others}
SQL = SQL.replace("CONTROLS", "'" + "|".join(map(re.escape, sorted(_controls, key=lambda x: (-len(x), x)))).replace("'", "''") + "'").replace("FRAME", str(len(Template.open + Template.middle + Template.close)))
