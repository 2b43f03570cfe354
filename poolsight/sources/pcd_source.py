"""`spark.read.format("pcd")`: layer files of any size as a table.

    spark.dataSource.register(PcdSource)
    spark.read.format("pcd").option("path", "/logs").load().filter("layer = 30")

Partitions are byte ranges. Equalities on what a path tells (session, config, job, subfolder, layer)
decide which files are opened at all, given `spark.sql.python.filterPushdown.enabled`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from poolsight.sources import pcd

_TEXT, _WHOLE = ("session", "config", "job"), ("subfolder", "layer")


def constants(path: str) -> dict | None:
    """What the path of a layer file says, None for other files."""
    found = re.search(pcd.LAYER_PATH, path)
    if found is None:
        return None
    session, config, job, part, layer = found.groups()
    return {"session": session, "config": config, "job": job, "subfolder": None if part is None else int(part), "layer": int(layer.replace(".", ""))}


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int

    def __init__(self, path: str, begin: int, end: int):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end = path, begin, end


class PcdSource(DataSource):
    """Options: `path`, `range_bytes`. Damaged files give one row with `error`, like in `pcd.decode_files`."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> StructType:
        return pcd.DECODED

    def reader(self, schema: StructType) -> PcdReader:
        return PcdReader(self.options, schema)


class PcdReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.schema = options["path"], schema
        self.range_bytes = int(options.get("range_bytes", pcd.RANGE_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in _TEXT or column in _WHOLE:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Range]:
        """One listing of the tree; no file is opened."""
        root = "/" + self.root[len("file:") :].lstrip("/") if self.root.startswith("file:") else self.root
        prefix = ""
        if "://" in root:
            prefix = root.split("://")[0] + "://"
            store, root = pyarrow.fs.FileSystem.from_uri(root)
        else:
            store = pyarrow.fs.LocalFileSystem()
        out = []
        for info in store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            known = constants(info.path) if info.is_file else None
            if known is not None and all(known[c] in values for c, values in self.wanted.items()):
                path = f"{prefix}{info.path}" if prefix else info.path
                out += [Range(path, at, at + self.range_bytes) for at in range(0, max(info.size, 1), self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        row = _Row(path=partition.path, **constants(partition.path))
        read = lambda: pcd.read_range(partition.path, partition.begin, partition.end)
        yield from pcd._batches(row, read, partition.begin == 0)


class _Row:
    def __init__(self, **values):
        self.__dict__.update(values)
