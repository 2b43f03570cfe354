"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each task tokenises the documents it reads and packs them in groups of about `group_tokens` ids, so
texts are never shuffled and memory stays bounded. A group gets full sequences and, for the rest,
sequences of powers of two, which need no padding. Whole-sequence slices of long documents fill
sequences alone; what remains is taken in descending length, each piece to the sequence with the
lowest cost (linear * n + quadratic * n^2 per piece, as attention stays inside a piece) that has
room. A piece no sequence has room for is cut at the largest room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from poolsight.llm.tokens import END_ID, default_tokenizer, encoder
from poolsight.llm.words import byte_arrays

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1 / 8192
GROUP_TOKENS = 1 << 22
FIELDS = (
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("sequence_tokens", pa.int64()),
)


def sequence_sizes(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then powers of two that add up to the rest."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_group(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple]:
    """(document, start, length, sequence, offset) of each piece; every sequence ends up full."""
    sizes = np.array(sequence_sizes(sum(lengths), capacity), np.int64)
    room, cost, pieces = sizes.copy(), np.zeros(len(sizes)), []

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, at, int(sizes[at] - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    full, tails = 0, []
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            put(doc, k * capacity, capacity, full)
            full += 1
        if n % capacity:
            tails.append((n % capacity, doc, n - n % capacity))
    for n, doc, start in sorted(tails, key=lambda t: (-t[0], t[1])):
        while n:
            fits = room[full:] >= n
            if fits.any():
                at, part = full + int(np.where(fits, cost[full:], np.inf).argmin()), n
            else:
                at = full + int(room[full:].argmax())
                part = int(room[at])
            put(doc, start, part, at)
            start, n = start + part, n - part
    return pieces


def _pack(path: str, capacity: int, linear: float, quadratic: float, group_tokens: int, with_ids: bool):
    fields = [*FIELDS, ("ids", pa.binary())] if with_ids else list(FIELDS)

    def packed(docs: list[tuple], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(ids) // 4 for _, ids in docs]
        sizes = sequence_sizes(sum(lengths), capacity)
        rows = []
        for doc, start, n, at, offset in pack_group(lengths, capacity, linear, quadratic):
            doc_id, ids = docs[doc]
            part = ids[4 * start : 4 * (start + n)]
            rows.append((doc_id, start, n, zlib.crc32(part), lengths[doc], first + at, offset, sizes[at], part)[: len(fields)])
        arrays = [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), fields)]
        return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields]), first + len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        docs, held, first = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), byte_arrays(batch.column(1))):
                ids = encode(data.tobytes()) + end
                docs.append((doc_id, ids))
                held += len(ids) // 4
                if held >= group_tokens:
                    out, first = packed(docs, first)
                    yield out
                    docs, held = [], 0
        if docs:
            yield packed(docs, first)[0]

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    group_tokens: int = GROUP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    `capacity` must be a power of two. Null and empty texts consist of the end id alone; null
    doc_ids and repeated rows are packed like any other row. `with_ids` adds the ids themselves
    (little-endian 32-bit). Sequence ids are unique but not dense. An empty table gives no rows.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = ", ".join(f"{name} long" for name, _ in FIELDS) + (", ids binary" if with_ids else "")
    run = _pack(tokenizer or default_tokenizer(), capacity, linear, quadratic, group_tokens, with_ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
