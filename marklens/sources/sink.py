"""Files as a sink that no failed or repeated task leaves in pieces.

A task writes each file under a name of its own in one folder of the run beside the destinations, syncs it, and moves it into
place; a move replaces a file as a whole, and a task that runs twice moves equal files twice. When the job ends,
well or not, the run's folder goes, and with it whatever lost tasks left. What became of each row is in the outcomes' folder,
a file of lines of JSON per task, equal for all attempts.

A file that is its own source (by device and inode, so through links too) is never written, nor, unless the sink
overwrites, one that is there with other content. Both are usage errors (2); a write that fails is 30, as nothing is there then.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .inputs import store_of

OUTCOMES = "path string, dest string, outcome string, bytes long, exit_code int"
# Exit codes.
EXIT_USAGE, EXIT_FAILED = 2, 30


@dataclass
class Done(WriterCommitMessage):
    written: int
    refused: int


def same_file(a: str, b: str) -> bool:
    try:
        one, two = os.stat(a), os.stat(b)
    except OSError:
        return False
    return (one.st_dev, one.st_ino) == (two.st_dev, two.st_ino)


def content_of(store, path: str) -> bytes | None:
    from pyarrow import fs

    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as stream:
        return stream.read()


def put(store, temporary: str, dest: str, content: bytes) -> None:
    """The whole content or nothing at dest."""
    from pyarrow import fs

    store.create_dir(dest.rsplit("/", 1)[0])
    with store.open_output_stream(temporary) as stream:
        stream.write(content)
    if isinstance(store, fs.LocalFileSystem):
        handle = os.open(temporary, os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)
        os.replace(temporary, dest)
    else:
        store.move(temporary, dest)


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.outcomes = options["folder"].rstrip("/"), options["outcomes"].rstrip("/")
        self.overwrite, self.run = options.get("overwrite", "false") == "true", options["run"]

    @property
    def own(self) -> str:
        return f"{store_of(self.folder)[1]}/.run-{self.run}"

    def write(self, rows: Iterator) -> Done:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, _ = store_of(self.folder)
        store.create_dir(self.own)
        name = f"{task.partitionId()}-{task.taskAttemptId()}"
        try:
            return self.each(store, task.partitionId(), name, rows)
        finally:  # a task that goes on after the job's end leaves nothing either
            if isinstance(store, fs.LocalFileSystem):
                for remove, left in ((os.remove, f"{self.own}/{name}"), (os.remove, f"{self.own}/{name}.lines"), (os.rmdir, self.own)):
                    try:
                        remove(left)
                    except OSError:  # it is not there, or others still use it
                        pass

    def each(self, store, partition: int, name: str, rows: Iterator) -> Done:
        lines = []
        for row in rows:
            store.create_dir(self.own)  # another task may have ended, and taken the empty folder along
            lines.append(self.one(store, f"{self.own}/{name}", *row))
        out, place = store_of(self.outcomes)
        store.create_dir(self.own)
        put(out, f"{self.own}/{name}.lines" if self.folder.split("://")[0] == self.outcomes.split("://")[0] else f"{place}/.{name}", f"{place}/part-{partition:05d}.json", "".join(json.dumps(x) + "\n" for x in lines).encode())
        written = sum(x["outcome"] == "written" for x in lines)
        return Done(written, len(lines) - written)

    def one(self, store, temporary: str, path: str | None, dest: str, content: bytes) -> dict:
        _, place = store_of(dest)
        said = lambda outcome, size, code: {"path": path, "dest": dest, "outcome": outcome, "bytes": size, "exit_code": code}
        try:
            if path is not None and same_file(store_of(path)[1], place):
                return said("names the input", None, EXIT_USAGE)
            if not self.overwrite and (there := content_of(store, place)) is not None and there != content:
                return said("exists", None, EXIT_USAGE)
            put(store, temporary, place, content)
        except OSError as e:
            return said(f"not written: {e}", None, EXIT_FAILED)
        return said("written", len(content), 0)

    def commit(self, messages: list) -> None:
        self.swept()

    def abort(self, messages: list) -> None:
        self.swept()

    def swept(self) -> None:
        from pyarrow import fs

        store, _ = store_of(self.folder)
        if store.get_file_info(self.own).type != fs.FileType.NotFound:
            store.delete_dir(self.own)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marklens_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter({k.lower(): v for k, v in self.options.items()})


def written(files: DataFrame, folder: str, outcomes: str, overwrite: bool = False) -> DataFrame:
    """files (path, dest, content) with dest below folder -> OUTCOMES, a row per file. path: the source, null if there is none.
    Two rows of one dest are the caller's to avoid (see operators/outputs.py). An empty table writes nothing and gives no rows."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(Files)
    how = {"folder": folder, "outcomes": outcomes, "overwrite": str(overwrite).lower(), "run": uuid.uuid4().hex}
    files.select("path", "dest", "content").write.format("marklens_files").options(**how).mode("append").save()
    return spark.read.schema(OUTCOMES).json(outcomes)
