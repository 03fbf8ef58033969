"""Taking in files once: a sink with a commit protocol, and what is left to fetch after it.

``files_once`` writes rows (name, body) as files of one folder. A file is written under a name of its own in ``_pending`` and moved to
its place when it is whole, so no reader ever meets half a file, whatever becomes of the task. A file that is there already is left
alone: a task that runs twice, or the whole job again, writes nothing anew. When the job ends, well or not, what is pending goes. The
folder may be any that pyarrow knows by its address, so tasks need no folder of their own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_NAME = re.compile(r"[^/\\\x00]+")


@dataclass
class Written(WriterCommitMessage):
    written: int = 0
    there: int = 0
    nothing: int = 0


class FilesOnceWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        system, base = fs.FileSystem.from_uri(self.path)
        return system, base, f"{base}/_pending/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base, pending = self._place()
        system.create_dir(pending, recursive=True)
        done = Written()
        for batch in iterator:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if body is None or not name:
                    done.nothing += 1
                    continue
                if not _NAME.fullmatch(name) or name in (".", ".."):
                    raise ValueError(f"not a file's name: {name!r}")
                if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                    done.there += 1
                    continue
                part = f"{pending}/{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(body)
                system.move(part, f"{base}/{name}")
                done.written += 1
        return done

    def _clear(self) -> None:
        system, _, pending = self._place()
        if system.get_file_info(pending).type != fs.FileType.NotFound:
            system.delete_dir(pending)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class FilesOnce(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files_once"

    def writer(self, schema: StructType, overwrite: bool) -> FilesOnceWriter:
        if overwrite:
            raise ValueError("files_once only adds files: use mode append")
        return FilesOnceWriter(self.options["path"])


def write_files_once(files: DataFrame, path: str) -> None:
    """Rows (name string, body binary) as files under ``path``; a row without a body is none."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FilesOnce)
    files.select("name", "body").write.format("files_once").mode("append").option("path", path).save()


def acquire(missing: DataFrame, fetch: Callable[[str], bytes | None], path: str, ending: str = ".pdb") -> None:
    """Fetches what is missing (structure) and keeps it under ``path`` as ``structure`` + ending.

    ``fetch`` is called in the tasks, once for a structure and try; what it has nothing for, or fails on, stays missing:
    ``still_missing`` tells. Each structure is asked for once however often it is named.
    """

    def run(batches):
        for batch in batches:
            names, bodies = [], []
            for one in batch.column("structure").to_pylist():
                try:
                    body = fetch(one)
                except Exception:  # a fetcher may fail in any way; what isn't there is asked for again
                    body = None
                names.append(f"{one}{ending}")
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["name", "body"])

    asked = missing.where("structure IS NOT NULL").select("structure").distinct()
    write_files_once(asked.mapInArrow(run, "name string, body binary"), path)
