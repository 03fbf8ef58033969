"""Files taken in once, external programs with limits, fields of several kinds."""

import json
import os
import sys
import time

import pytest
from pyspark.sql import functions as F

from rankmill.functions.polymorphic import listed, listed_in, members, parsed, value
from rankmill.sources.acquisition import acquire, write_files_once
from rankmill.sources.snapshots import pocket_sections, still_missing, structure_files
from rankmill.sources.tools import run_tool, sections, tool_pockets


def files(path):
    return {f: (path / f).read_bytes() for f in sorted(os.listdir(path)) if not f.startswith("_")}


def test_files_are_written_once(spark, tmp_path):
    path = tmp_path / "held"
    rows = spark.createDataFrame([(f"{i}.pdb", bytes([i]) * 1000) for i in range(20)] + [("none.pdb", None)], "name string, body binary").repartition(4)
    write_files_once(rows, str(path))
    assert files(path) == {f"{i}.pdb": bytes([i]) * 1000 for i in range(20)}
    before = {f: os.stat(path / f).st_mtime_ns for f in files(path)}
    write_files_once(rows.withColumn("body", F.lit(b"other")), f"file://{path}")
    assert {f: os.stat(path / f).st_mtime_ns for f in files(path) if f != "none.pdb"} == before
    assert not os.listdir(path / "_pending")


def test_a_task_that_dies_leaves_no_half_file(spark, tmp_path):
    path = tmp_path / "held"

    def dying(batches):
        for i, batch in enumerate(batches):
            yield batch
            raise RuntimeError("killed")

    rows = spark.createDataFrame([(f"{i}", b"x" * 5000) for i in range(6)], "name string, body binary").repartition(2)
    with pytest.raises(Exception, match="killed"):
        write_files_once(rows.mapInArrow(dying, "name string, body binary"), str(path))
    assert all(len(b) == 5000 for b in files(path).values()) and not os.listdir(path / "_pending")
    write_files_once(rows, str(path))
    assert len(files(path)) == 6
    for bad in ("../out", "..", "a/b"):
        with pytest.raises(Exception, match="not a file's name"):
            write_files_once(spark.createDataFrame([(bad, b"x")], "name string, body binary"), str(path))


def test_what_is_missing_is_fetched_until_nothing_is(spark, tmp_path):
    store, calls, path = tmp_path / "service", tmp_path / "calls", tmp_path / "held"
    for d in (store, calls, path):
        d.mkdir()
    for name in "ABC":
        (store / name).write_text(f"ATOM {name}")
    wanted = spark.createDataFrame([("A",), ("B",), ("A",), ("D",), (None,)], "structure string")

    def fetch(name):
        (calls / f"{name}-{time.time_ns()}").touch()
        return (store / name).read_bytes()

    missing = lambda: still_missing(wanted, structure_files(spark, str(path)))
    acquire(missing(), fetch, str(path))
    assert files(path) == {"A.pdb": b"ATOM A", "B.pdb": b"ATOM B"}
    assert sorted(c.split("-")[0] for c in os.listdir(calls)) == ["A", "B", "D"]
    (store / "D").write_text("ATOM D")
    acquire(missing(), fetch, str(path))
    assert missing().count() == 0 and sorted(c.split("-")[0] for c in os.listdir(calls)) == ["A", "B", "D", "D"]


INFO = "Pocket 1 :\n\tScore : \t0.5\n\tDruggability Score : \t0.75\n\tNumber of Alpha Spheres : \t40\n\tVolume : \t612.5\n\nPocket 2 :\n\tScore : \t.\n\tPolarity score:\t7\n\tHydrophobicity score : 12.5\n"


def test_sections_are_those_of_the_reader(spark):
    text = spark.createDataFrame([("p", INFO)], "path string, value string")
    read = [r.asDict() for r in pocket_sections(text).drop("path").collect()]
    assert list(sections(INFO.splitlines())) == [{c: r[c] for c in ("pocket_id", "score", "druggability", "volume", "hydrophobicity", "polarity", "alpha_spheres")} for r in read]
    assert list(sections([])) == [] and list(sections(["Score : 1"])) == []


def test_a_program_runs_for_each_row_within_its_limit(spark, tmp_path):
    stub, mark = tmp_path / "stub.py", tmp_path / "tried"
    stub.write_text(f"""import os, sys, time
body = sys.stdin.buffer.read()
if body == b"slow": time.sleep(60)
if body == b"bad": sys.exit("no good")
if body == b"second":
    if not os.path.exists({str(mark)!r}):
        open({str(mark)!r}, "w").close()
        sys.exit(3)
print({INFO!r} if body not in (b"", b"none") else "")
""")
    rows = spark.createDataFrame([(b, None if b is None else b.encode()) for b in ("good", "slow", "bad", "second", "none", None)], "structure string, body binary").repartition(3)
    ran = run_tool(rows, [sys.executable, str(stub)], seconds=4).cache()
    found = {r["structure"]: (r["status"], r["tries"], len(r["pockets"])) for r in ran.collect()}
    assert found == {"good": ("ok", 1, 2), "slow": ("timeout", 2, 0), "bad": ("failed", 2, 0), "second": ("ok", 2, 2), "none": ("ok", 1, 0), None: ("ok", 1, 0)}
    assert "no good" in {r["structure"]: r["error"] for r in ran.collect()}["bad"]
    pockets = {(r["structure"], r["pocket_id"]): r["volume"] for r in tool_pockets(ran).collect()}
    assert pockets == {("good", 1): 612.5, ("good", 2): None, ("second", 1): 612.5, ("second", 2): None}
    assert {r["status"] for r in run_tool(rows, ["no-such-program"]).collect()} == {"absent"}


def test_a_field_is_parsed_once(spark):
    said = ['["a","b"]', "plain", '"quoted"', '{"id":"x","in":["p","q"]}', '[{"id":"x","in":"p"},{"id":"y"}]', "[broken", "", None, "12", "null", "[]"]
    df = parsed(spark.createDataFrame([(t,) for t in said], "t string"), "t")
    out = df.select(listed("t").alias("l"), value("t", "$.id", first=True).alias("v"), listed_in("t", "$.in", True).alias("i"), members("t", "id").alias("m"))

    def plain(t):
        try:
            x = json.loads(t)
        except (TypeError, ValueError):
            x = None
        text = lambda e: None if e is None else e if isinstance(e, str) else json.dumps(e, separators=(",", ":"))
        first = x[0] if isinstance(x, list) and x else x
        inside = first.get("in") if isinstance(first, dict) else None
        started = (t or "").startswith("[")
        many = [text(e) for e in x] if isinstance(x, list) else None if started or t is None else [x if isinstance(x, str) else t]
        ids = [e.get("id") if isinstance(e, dict) else None for e in x] if isinstance(x, list) else None if started else [x.get("id") if isinstance(x, dict) else None]
        return many, first.get("id") if isinstance(first, dict) else None, None if inside is None else inside if isinstance(inside, list) else [inside], ids

    assert [tuple(r) for r in out.collect()] == [plain(t) for t in said]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
