"""Point-cloud files of a log tree as one session-partitioned dataset."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from poolsight.schema import MEASURES, POINT_CLOUD, STATES

#: Fixed pattern of a layer file below the log root: session, config, job, optional part, layer.
LAYER_PATH = (
    r"session_(\d{4}_\d{2}_\d{2}_\d{2}-\d{2}-\d{2}\.\d+)/"
    r"config_(\d+_[a-f0-9]+)/"
    r"job_(\d+_[a-f0-9]+)/"
    r"sensors/ECAMPCDWriterSink__1/(?:(\d+)/)?"
    r"(?:layer/)?(\d{3}\.\d{3})\.pcd"
)

#: Numeric fields of a file that are not in the schema.
EXTRA = T.StructField("extra", T.MapType(T.StringType(), T.DoubleType()))

#: NumPy type letters of the PCD field types.
PCD_TYPES = {"F": "f", "I": "i", "U": "u"}

BATCH_ROWS = 100_000
#: Without these a file is rejected; other measures and states may be absent and become null.
NEEDED = ("t", "x", "y", "z", "sensor0", "sensor1", "state0")
#: Files up to this size are read whole, larger ones as byte ranges of this size.
RANGE_BYTES = 128 << 20
#: A header must end within this many bytes.
HEADER_BYTES = 1 << 20
#: Most tasks that share the ranges of one ingest.
RANGE_TASKS = 20_000


def path_columns(path: Column) -> dict[str, Column]:
    """session, config, job, subfolder (null without a part number) and layer of a path."""
    group = lambda i: F.regexp_extract(path, LAYER_PATH, i)
    return {
        "session": group(1),
        "config": group(2),
        "job": group(3),
        "subfolder": F.nullif(group(4), F.lit("")).cast("int"),
        "layer": F.replace(group(5), F.lit("."), F.lit("")).cast("int"),
    }


def parse_log_path(paths: DataFrame, column: str = "path") -> DataFrame:
    """Keep the layer files and add what their path says."""
    return paths.filter(F.col(column).rlike(LAYER_PATH)).withColumns(path_columns(F.col(column)))


def tag_constants(points: DataFrame, column: str = "path") -> DataFrame:
    """Add the constants of the path to every point read from it."""
    return parse_log_path(points, column)


CONSTANTS = ["session", "config", "job", "subfolder", "layer"]
DECODED = T.StructType(
    [*POINT_CLOUD.fields, EXTRA, T.StructField("path", T.StringType()), T.StructField("error", T.StringType())]
)


def decode_files(files: DataFrame) -> DataFrame:
    """Decode (path, content) rows: the point cloud plus `extra`, `path` and `error`.

    Each point carries its position in the file as `idx`; numeric fields beyond the schema are
    kept in the map `extra`. A file that cannot be decoded, or comes without content, becomes
    one row with the reason in `error`, a file without points one row without `idx` and error; files
    whose path is no layer file are ignored.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _batches(row, lambda row=row: iter([read_points(_content(row))]))

    return parse_log_path(files).select("path", "content", *CONSTANTS).mapInArrow(decode, DECODED)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[SimpleNamespace]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield SimpleNamespace(**{name: batch.column(name)[i].as_py() for name in batch.schema.names})


def _content(row) -> bytes:
    if row.content is None:
        raise ValueError("file comes without content")
    return row.content


def decode_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Like `decode_files`, for (path, length) rows of files of any size.

    Every file is cut into byte ranges; a task reads the header and the points whose first byte lies in
    its range, some 100,000 at a time. The places of points in an ascii body are known only after all
    lines before them, so such a body is streamed by the task of its first range, once to check it and
    once for its points.
    """
    last = F.greatest(F.col("length") - 1, F.lit(0))
    begins = F.sequence(F.lit(0).cast("long"), F.expr(f"cast({range_bytes} as bigint)") * F.floor(last / range_bytes), F.lit(range_bytes).cast("long"))
    ranges = parse_log_path(files).select("path", "length", *CONSTANTS, F.explode(begins).alias("begin"))
    tasks = ranges.count()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _batches(row, lambda row=row: read_range(row.path, row.begin, row.begin + range_bytes), row.begin == 0)

    return ranges.repartition(max(1, min(tasks, RANGE_TASKS))).mapInArrow(decode, DECODED)


def _batches(row, read, speaks: bool = True) -> Iterator[pa.RecordBatch]:
    """Points of a file or range in pieces, or its error; only the one that speaks for a file tells that it has none."""
    where = {c: getattr(row, c) for c in CONSTANTS} | {"path": row.path}
    shape = to_arrow_schema(DECODED)
    seen = False
    try:
        for points in read():
            for at in range(0, len(points["t"]), BATCH_ROWS):
                seen = True
                yield _batch({c: v[at : at + BATCH_ROWS] for c, v in points.items()}, len(points["t"][at : at + BATCH_ROWS]), where, shape)
        parts = [] if seen or not speaks else [{}]
    except (ValueError, LookupError, TypeError, OverflowError) as error:
        parts = [{"error": [f"{type(error).__name__}: {error}"]}] if speaks else []
    yield from (_batch(part, 1, where, shape) for part in parts)


def _batch(columns: dict, rows: int, where: dict, shape: pa.Schema) -> pa.RecordBatch:
    """Columns in the order of `DECODED`, without a detour over a frame; NaN becomes null."""

    def column(field: pa.Field) -> pa.Array:
        if field.name in where:
            return pa.repeat(pa.scalar(where[field.name], field.type), rows)
        values = columns.get(field.name)
        if values is None:
            return pa.nulls(rows, field.type)
        if field.name == EXTRA.name:
            return pa.array([list(m.items()) for m in values], field.type)
        return pa.array(values, from_pandas=True).cast(field.type)

    return pa.RecordBatch.from_arrays([column(field) for field in shape], schema=shape)


@dataclass
class Header:
    """What the header of a file says; `at` is where its body starts."""

    names: list[str]
    counts: list[int]
    layout: np.dtype
    total: int
    form: str
    at: int

    def columns(self, values: dict[str, np.ndarray], first: int) -> dict[str, np.ndarray]:
        """The schema's columns, `extra` and `idx` of points from position `first` on."""
        rows = len(values["t"])
        out: dict[str, np.ndarray] = {c: values[c].astype(float) for c in MEASURES if c in values}
        out.update({c: _states(values[c].astype(float)) for c in STATES if c in values})
        more = [n for n, c in zip(self.names, self.counts) if c == 1 and n not in (*MEASURES, *STATES)]
        if more:
            pairs = zip(*(values[n].astype(float).tolist() for n in more))
            extra = np.empty(rows, object)
            extra[:] = [dict(zip(more, row)) for row in pairs]
            out["extra"] = extra
        out["idx"] = np.arange(first, first + rows, dtype=np.int64)
        return out

    def ascii(self, words: list[bytes], first: int) -> dict[str, np.ndarray]:
        """Columns of whole points given as words."""
        width = sum(self.counts)
        grid = np.array(words, dtype=float).reshape(-1, width)
        return self.columns({n: grid[:, sum(self.counts[:i])] for i, n in enumerate(self.names)}, first)

    def check(self, length: int) -> None:
        if self.form == "binary" and length - self.at < self.total * self.layout.itemsize:
            raise ValueError("body shorter than POINTS")


def read_header(content: bytes) -> Header:
    """ValueError if the header is malformed or names fields that cannot be used."""
    header: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in header:
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError("no DATA line")
        words = content[at:end].decode("ascii").split()
        if words and not words[0].startswith("#"):
            header[words[0].upper()] = words[1:]
        at = end + 1
    lists = [header.get(key, []) for key in ("FIELDS", "SIZE", "TYPE")]
    names = [n.lower() for n in lists[0]]
    counts = [int(c) for c in header.get("COUNT", ["1"] * len(names))]
    if not names or {len(names)} != {len(counts), *map(len, lists)} or min(counts) < 1:
        raise ValueError("FIELDS, SIZE, TYPE and COUNT do not fit together")
    kinds = [f"<{PCD_TYPES[t]}{s}" for t, s in zip(lists[2], lists[1])]
    total = _number(header, "POINTS") if "POINTS" in header else _number(header, "WIDTH") * _number(header, "HEIGHT")
    layout = np.dtype([(n, k, (c,)) if c > 1 else (n, k) for n, k, c in zip(names, kinds, counts)])
    form = header["DATA"][0].lower() if header["DATA"] else "without a form"
    if form not in ("binary", "ascii"):
        raise ValueError(f"DATA {form} is not supported")
    several = [n for n, c in zip(names, counts) if c > 1 and n in (*MEASURES, *STATES)]
    if several:
        raise ValueError(f"more than one value per point: {', '.join(several)}")
    missing = [c for c in NEEDED if c not in names]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return Header(names, counts, layout, total, form, at)


def read_points(content: bytes) -> dict[str, np.ndarray]:
    """Columns of one PCD file (ascii or binary body), with `idx`; ValueError if malformed."""
    header = read_header(content)
    header.check(len(content))
    if header.form == "binary":
        table = np.frombuffer(content, dtype=header.layout, count=header.total, offset=header.at)
        return header.columns({n: table[n] for n in header.names}, 0)
    words = content[header.at :].split()
    if len(words) < header.total * sum(header.counts):
        raise ValueError("body shorter than POINTS")
    return header.ascii(words[: header.total * sum(header.counts)], 0)


def open_file(path: str) -> BinaryIO:
    """A file as Spark names it, on the local disk or in a store that Arrow reads."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        store, path = pyarrow.fs.FileSystem.from_uri(path)
    else:
        store = pyarrow.fs.LocalFileSystem()
    return store.open_input_file(path)


def read_range(path: str, begin: int, end: int) -> Iterator[dict[str, np.ndarray]]:
    """The points of a file whose first byte lies in [begin, end), in pieces; all of them at `begin` 0 of an ascii file."""
    with open_file(path) as f:
        header = read_header(f.read_at(min(HEADER_BYTES, f.size()), 0))
        header.check(f.size())
        if header.form == "ascii":
            if begin == 0:
                for _ in _ascii_pieces(f, header):  # a damaged body gives no points at all
                    pass
                yield from _ascii_pieces(f, header)
            return
        size = header.layout.itemsize
        first = max(0, -(-(begin - header.at) // size))
        last = min(header.total, max(0, -(-(end - header.at) // size)))
        for at in range(first, last, BATCH_ROWS):
            rows = min(BATCH_ROWS, last - at)
            table = np.frombuffer(f.read_at(rows * size, header.at + at * size), dtype=header.layout, count=rows)
            yield header.columns({n: table[n] for n in header.names}, at)


def _ascii_pieces(f: BinaryIO, header: Header) -> Iterator[dict[str, np.ndarray]]:
    width, done, words, rest = sum(header.counts), 0, [], b""
    f.seek(header.at)
    while done < header.total:
        block = f.read(1 << 22)
        text = rest + block
        if block:  # a word may go on in the next block
            stop = max(text.rfind(c) for c in (b" ", b"\n", b"\t", b"\r")) + 1
            text, rest = text[:stop], text[stop:]
        words += text.split()
        whole = min(len(words) // width, header.total - done)
        if whole:
            yield header.ascii(words[: whole * width], done)
            done, words = done + whole, words[whole * width :]
        if not block:
            break
    if done < header.total:
        raise ValueError("body shorter than POINTS")


def _number(header: dict[str, list[str]], key: str) -> int:
    words = header.get(key, [])
    if len(words) != 1 or not words[0].isdigit():
        raise ValueError(f"{key} holds no number")
    return int(words[0])


def _states(values: np.ndarray) -> np.ndarray:
    """Whole numbers as floats; what is no 32-bit number becomes NaN and, in a frame, null."""
    return np.where(np.abs(values) < 2**31, np.trunc(values), np.nan)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Layer files below `root` as (path, length, content); contents are read only where they are used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").option("recursiveFileLookup", "true")
    return reader.load(root).select("path", "length", "content")


def decode(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Decode (path, length, content) rows; of files above `range_bytes` the content stays unread and ranges are read."""
    small = decode_files(files.filter(F.col("length") <= range_bytes).select("path", "content"))
    large = files.filter(F.col("length") > range_bytes).select("path", "length")
    if large.isEmpty():
        return small
    return small.unionByName(decode_ranges(large, range_bytes))


def layout(decoded: DataFrame) -> DataFrame:
    """Decoded rows with the partition column `file`, the part of the path that names a file in its session."""
    return decoded.withColumn("file", F.sha1(F.regexp_extract("path", LAYER_PATH, 0)))


def ingest(spark: SparkSession, root: str, out: str, range_bytes: int = RANGE_BYTES) -> None:
    """Take in the log tree; every file found replaces what `out` holds of it.

    A second run changes nothing, also after or before `streaming.ingest` on the same `out`: both
    write through `store`. Files that are gone from the tree stay in `out`.
    """
    store(layout(decode(read_files(spark, root), range_bytes)), out)


def store(decoded: DataFrame, out: str) -> None:
    """Write decoded rows; the files among them, points and rejects alike, replace those stored before.

    A file is one partition and always leaves a row, so a run that broke off is mended by repeating it.
    """
    writer = decoded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("session", "file").parquet(out)


def read_cloud(spark: SparkSession, out: str, extra: bool = False) -> DataFrame:
    """The point cloud written by `ingest`, in the fixed schema; with `extra`, also further fields."""
    stored = spark.read.schema(_stored()).parquet(out)
    return stored.filter("idx is not null").select(*POINT_CLOUD.names, *["extra"] * extra)


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    stored = spark.read.schema(_stored()).parquet(out)
    return stored.filter("error is not null").select("path", "error")


def _stored() -> T.StructType:
    return T.StructType([*DECODED.fields, T.StructField("file", T.StringType())])
