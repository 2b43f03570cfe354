"""Token ids in bit- or byte-plane blocks.

Documents are dealt by ranges of doc_id; each range is one shard, its documents in ascending order.
A shard's ids are cut into blocks of `block_ids`. A block is transposed into planes (the k-th byte,
or bit, of every id), each compressed with zstandard: the upper planes of small ids nearly vanish.
Blocks are rows of a Parquet table, so Spark's writers commit them and any store can hold them; the
other columns are the chunk index (shard, block, ids before it, ids in it, and the document pieces
it holds), which can be read without the payloads.

A block's payload: b"IDPL", then little-endian 32-bit numbers: ids, planes (4 or 32) and each
plane's compressed length; then the planes, lowest first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from poolsight.llm.tokens import END_ID, default_tokenizer, encoder
from poolsight.llm.words import byte_arrays
from poolsight.operators.joins import stored_bytes

MAGIC = b"IDPL"
BLOCK_IDS = 1 << 16
SHARD_BYTES = 32 << 20
#: Spark states such a size where it knows none.
UNKNOWN_BYTES = 1 << 60
PIECE = pa.struct([("doc_nr", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
BLOCK_SCHEMA = (
    "shard int, block int, first_id long, n_ids long,"
    " pieces array<struct<doc_nr: long, doc_id: long, offset: long, length: long>>, payload binary"
)


def encode_block(ids: np.ndarray, planes: str = "byte", level: int = 3) -> bytes:
    """One block of ids as planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    table = ids.view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        parts = [np.ascontiguousarray(table[:, k]).tobytes() for k in range(4)]
    elif planes == "bit":
        bits = np.unpackbits(table, axis=1, bitorder="little")
        parts = [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    else:
        raise ValueError("planes must be 'byte' or 'bit'")
    press = zstandard.ZstdCompressor(level=level)
    packed = [press.compress(p) for p in parts]
    return MAGIC + struct.pack(f"<{2 + len(packed)}I", len(ids), len(packed), *map(len, packed)) + b"".join(packed)


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of one block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of ids")
    n, planes = struct.unpack_from("<2I", payload, 4)
    sizes = struct.unpack_from(f"<{planes}I", payload, 12)
    unpress, at, parts = zstandard.ZstdDecompressor(), 12 + 4 * planes, []
    for size in sizes:
        parts.append(np.frombuffer(unpress.decompress(payload[at : at + size], max_output_size=max(1, n)), np.uint8))
        at += size
    if planes == 4:
        return np.ascontiguousarray(np.stack(parts, axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def _blocks(path: str, block_ids: int, planes: str):
    names = ["shard", "block", "first_id", "n_ids", "pieces", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(PIECE), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path).encode, TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        parts, pieces, held, block, nr = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            values = [shard, block, block * block_ids, len(ids), pieces, encode_block(ids, planes)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), byte_arrays(batch.column(1))):
                ids, at = encode(data.tobytes()) + end, 0
                total = len(ids) // 4
                while at < total:
                    n = min(total - at, block_ids - held)
                    parts.append(ids[4 * at : 4 * (at + n)])
                    pieces.append({"doc_nr": nr, "doc_id": doc_id, "offset": held, "length": n})
                    at, held = at + n, held + n
                    if held == block_ids:
                        yield row()
                        parts, pieces, held, block = [], [], 0, block + 1
                nr += 1
        if held:
            yield row()

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    block_ids: int = BLOCK_IDS,
    planes: str = "byte",
    shards: int | None = None,
) -> None:
    """Tokenise whole texts and write their ids below `path`, in ascending doc_id order.

    Null doc_ids come first, rows that repeat a doc_id stand next to each other by text. Null and
    empty texts consist of the end id. An empty table writes an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    if shards is None:
        size = stored_bytes(texts)
        by_size = -(-size // SHARD_BYTES) if size < UNKNOWN_BYTES else 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), by_size)
    blocks = (
        texts.repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_blocks(tokenizer or default_tokenizer(), block_ids, planes), BLOCK_SCHEMA)
    )
    blocks.write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def shard_offsets(blocks: DataFrame) -> DataFrame:
    """(shard, before): ids in all earlier shards; one row per shard, from the chunk index alone."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, lowest power in the highest bit."""
    product, bit = 0, 1 << 31
    while bit:
        if a & bit:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return product


def join_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row, from the CRC-32 of each and the second's length in bytes."""
    shift, power, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return _times(shift, first) ^ second


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shards, blocks, firsts = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for shard, block, first, pieces, payload in zip(shards, blocks, firsts, batch.column(3), batch.column(4)):
            ids = decode_block(payload.as_py())
            for p in pieces.as_py():
                part = ids[p["offset"] : p["offset"] + p["length"]]
                rows.append((shard, p["doc_nr"], p["doc_id"], block, first + p["offset"], p["length"], zlib.crc32(part.tobytes())))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["shard", "doc_nr", "doc_id", "block", "at", "length", "crc"]
        columns = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


@F.pandas_udf(LongType())
def _joined(pieces: pd.Series) -> pd.Series:
    out = []
    for row in pieces:
        crc = row[0]["crc"]
        for p in row[1:]:
            crc = join_crc(crc, p["crc"], 4 * p["length"])
        out.append(crc)
    return pd.Series(out, dtype="int64")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone.

    Every block is decoded where it is read; only the pieces' lengths and checksums are shuffled.
    """
    blocks = read_blocks(spark, path)
    pieces = blocks.select("shard", "block", "first_id", "pieces", "payload").mapInArrow(
        _check, "shard int, doc_nr long, doc_id long, block int, at long, length long, crc long"
    )
    docs = pieces.groupBy("shard", "doc_nr").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("at").alias("at"),
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "crc", "length"))).alias("parts"),
    )
    return docs.join(shard_offsets(blocks), "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", _joined("parts").alias("ids_crc32")
    )
