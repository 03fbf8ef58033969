"""External programs over rows: a child process for each, with a time limit, another try, and its status kept."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r"^\s*Pocket\s+(\d+)\s*:")
_LINE = re.compile(r"^\s*([A-Za-z][A-Za-z ]*?)\s*:\s*([\d.]+)\s*$")
#: What a section's lines are called, in lower case, and the columns they go to.
FIELDS = {"score": "score", "druggability score": "druggability", "volume": "volume", "hydrophobicity score": "hydrophobicity", "polarity score": "polarity", "number of alpha spheres": "alpha_spheres"}
_POCKET = pa.struct([("pocket_id", pa.int32()), *[(c, pa.int32() if c == "alpha_spheres" else pa.float64()) for c in FIELDS.values()]])
_RAN = pa.schema([("structure", pa.string()), ("status", pa.string()), ("tries", pa.int32()), ("error", pa.string()), ("pockets", pa.list_(_POCKET))])
_RAN_DDL = "structure string, status string, tries int, error string, pockets array<struct<pocket_id:int,score:double,druggability:double,volume:double,hydrophobicity:double,polarity:double,alpha_spheres:int>>"


def sections(lines: Iterable[str]) -> Iterator[dict]:
    """Pockets from the lines of a program's output, one at a time; the first of several equal labels counts, what isn't a number is null."""
    pocket = None
    for line in lines:
        head = _HEAD.match(line)
        if head:
            if pocket:
                yield pocket
            pocket = {"pocket_id": int(head[1])} | dict.fromkeys(FIELDS.values())
            continue
        said = _LINE.match(line)
        column = FIELDS.get(said[1].lower()) if said and pocket else None
        if column and pocket[column] is None:
            try:
                pocket[column] = int(float(said[2])) if column == "alpha_spheres" else float(said[2])
            except ValueError:  # digits and dots that make no number
                pass
    if pocket:
        yield pocket


def ask(command: Sequence[str], body: bytes, seconds: float, tries: int) -> tuple[str, int, str | None, list[dict]]:
    """Status ("ok", "timeout", "failed" or "absent"), how often it was tried, its last words, and the pockets."""
    status, words = "failed", None
    for n in range(1, tries + 1):
        try:
            ran = subprocess.run(command, input=body, capture_output=True, timeout=seconds)
        except subprocess.TimeoutExpired:
            status, words = "timeout", f"over {seconds:g} s"
            continue
        except FileNotFoundError as e:
            return "absent", n, str(e), []
        if ran.returncode == 0:
            return "ok", n, None, list(sections(ran.stdout.decode(errors="replace").splitlines()))
        status, words = "failed", f"exit {ran.returncode}: {ran.stderr.decode(errors='replace')[-200:]}"
    return status, tries, words, []


def run_tool(structures: DataFrame, command: Sequence[str], seconds: float = 120, tries: int = 2) -> DataFrame:
    """(structure, body) -> structure, status, tries, error and its pockets: the program gets the body on its input and prints
    pocket information. It isn't a dependency: where it isn't installed each row says so. A null body is an empty one."""
    command = list(command)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: a program may take minutes
                name, body = batch.column("structure")[i].as_py(), batch.column("body")[i].as_py() or b""
                status, n, words, pockets = ask(command, bytes(body), seconds, tries)
                yield pa.RecordBatch.from_pylist([{"structure": name, "status": status, "tries": n, "error": words, "pockets": pockets}], schema=_RAN)

    return structures.select("structure", F.col("body").cast("binary").alias("body")).mapInArrow(run, _RAN_DDL)


def tool_pockets(ran: DataFrame) -> DataFrame:
    """A row per pocket, as ``read_pockets`` gives them, with the structure in place of a path."""
    return ran.where("status = 'ok'").select("structure", F.inline("pockets"))
