"""Input arguments as a source: files and folders in the order of the arguments, folders depth first, names by their bytes.

Listing happens once, when the job is planned, with files dealt to partitions by bytes in that order; tasks read the
files. Other than Spark's own file sources this one skips no hidden file and keeps the order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .assets import MOST_BYTES

SCHEMA = "asset_id long, path string, relative string, length long, content binary"
#: Bytes of files in a partition, about, and what opening a file counts as.
PARTITION_BYTES, OPENING_BYTES = 128 * 1024 * 1024, 1024 * 1024


def store_of(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Listed:
    position: int
    path: str
    relative: str | None
    length: int


def below(store, folder: str) -> Iterator[tuple[str, int]]:
    """Files under a folder, its entries by name, a folder's files in its own place."""
    from pyarrow import fs

    entries = store.get_file_info(fs.FileSelector(folder))
    for e in sorted(entries, key=lambda e: e.base_name.encode("utf-8", "surrogateescape")):
        if e.type == fs.FileType.Directory:
            yield from below(store, e.path)
        elif e.type == fs.FileType.File:
            yield e.path, e.size


def listed(paths: list[str]) -> list[Listed]:
    """All files that the arguments stand for. relative: the place below a folder argument, behind the folder's own name if there
    are several; null for a file argument. Raises ValueError for an argument that is neither, and if nothing is left."""
    from pyarrow import fs

    infos = [(p, *(lambda s, i: (s, s.get_file_info(i)))(*store_of(p))) for p in paths]
    folders = sum(info.type == fs.FileType.Directory for *_, info in infos)
    found: list[Listed] = []
    for given, store, info in infos:
        if info.type == fs.FileType.Directory:
            root = info.path.rstrip("/")
            scheme = given[: given.index("://") + 3] if "://" in given else ""
            name = root.rsplit("/", 1)[-1] + "/" if folders > 1 else ""
            for path, size in below(store, root):
                whole = scheme + path if scheme != "file://" else path
                found.append(Listed(len(found), whole, name + path[len(root) :].lstrip("/"), size))
        elif info.type == fs.FileType.File:
            found.append(Listed(len(found), given, None, info.size))
        else:
            raise ValueError(f"{given}: neither a file nor a folder")
    if not found:
        raise ValueError("no input was given")
    return found


def packed(files: list[Listed], most: int) -> list[list[Listed]]:
    """Files in their order, in parts of so many bytes or one file."""
    parts: list[list[Listed]] = []
    size = 0
    for f in files:
        cost = f.length + OPENING_BYTES
        if not parts or size + cost > most:
            parts.append([])
            size = 0
        parts[-1].append(f)
        size += cost
    return parts


@dataclass
class Part(InputPartition):
    files: list[Listed]


class InputReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.most = int(options.get("maxbytes", MOST_BYTES))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Part]:
        return [Part(files) for files in packed(listed(self.paths), self.partition_bytes)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for f in partition.files:
            content = None
            if f.length <= self.most:
                store, path = store_of(f.path)
                with store.open_input_stream(path) as stream:
                    content = stream.read()
            yield f.position, f.path, f.relative, f.length, content


class Inputs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marklens_inputs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InputReader:
        return InputReader({k.lower(): v for k, v in self.options.items()})


def inputs(spark: SparkSession, paths: list[str], most_bytes: int = MOST_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """asset_id (the place in the order), path, relative, length, content: a row per file that the arguments stand for, in their
    order; content is null in files of more than most_bytes."""
    if not any([_has_file(p) for p in paths]):  # an argument that is wrong fails here, not in the job
        raise ValueError("no input was given")
    spark.dataSource.register(Inputs)
    return spark.read.format("marklens_inputs").options(paths=json.dumps(paths), maxBytes=most_bytes, partitionBytes=partition_bytes).load()


def _has_file(path: str) -> bool:
    from pyarrow import fs

    store, inside = store_of(path)
    kind = store.get_file_info(inside).type
    if kind == fs.FileType.NotFound:
        raise ValueError(f"{path}: neither a file nor a folder")
    return kind == fs.FileType.File or next(below(store, inside.rstrip("/")), None) is not None
