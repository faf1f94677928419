"""Blocks of documents that ask the whole corpus something, and get an answer back.

Some questions of a document need a table about all documents that is too large
to send to every task: is this window repeated anywhere, how often does this pair of
words occur. Documents are dealt into blocks by a hash of their id. A block
sends what it asks about as sorted numbers, cut by value into parts; the owner of
a part sees what all blocks sent and answers each of them, number by number;
the block gets the answers beside its texts. Nothing grows with the corpus but the
number of blocks, parts and messages: a message holds one block's numbers of one
part, a part the numbers of one range of values, without repeats inside a block.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.expressions import col

# Bytes of text in a block of mean size; a longer document is a block's task alone.
BLOCK_BYTES = 5 << 20

MESSAGE = "part long, block int, payload binary"
ANSWER = "block int, kind int, part long, payload binary"


def text_volume(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0


def block_count(docs: DataFrame, volume: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(volume / BLOCK_BYTES))


def block_of(id_col: str, blocks: int):
    """The block of a document; rows with equal ids share one."""
    return F.expr(f"cast(pmod(xxhash64(`{id_col.replace('`', '``')}`), {blocks}) as int)")


def power_of_two(at_least: float) -> int:
    """The exponent of the smallest power of two that is not below."""
    return max(0, math.ceil(math.log2(max(at_least, 1))))


def id_order(ids: pa.ChunkedArray, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids as integers, null as the smallest, and the order by id, equal ids by text."""
    numbers = ids.combine_chunks().cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    order = np.argsort(numbers, kind="stable")
    ranked = numbers[order]
    if np.any(ranked[1:] == ranked[:-1]):
        values = texts.to_pylist()
        order = np.array(sorted(range(len(numbers)), key=lambda i: (numbers[i], values[i] or "")), dtype=np.int64)
    return numbers, order


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative integers, small where they rise slowly: byte planes, compressed."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<IB", len(values), width) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(payload: bytes) -> np.ndarray:
    count, width = struct.unpack_from("<IB", payload)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[5:]), dtype=np.uint8).reshape(width, count)
    out = np.zeros((count, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def pack_rising(values: np.ndarray) -> bytes:
    """Integers in rising order."""
    return pack_numbers(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_rising(payload: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(payload), dtype=np.uint64)


def pack_all(*payloads: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in payloads)


def unpack_all(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        (size,) = struct.unpack_from("<I", payload, at)
        out.append(payload[at + 4: at + 4 + size])
        at += 4 + size
    return out


def cut_by_part(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, last) for each run of equal values in rising parts."""
    if len(parts) == 0:
        return []
    begin = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1 if parts[0] else parts[0] + 1))
    return list(zip(parts[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(parts)]))


def messages(block: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({
        "part": pa.array([p for p, _ in rows], type=pa.int64()),
        "block": pa.array([block] * len(rows), type=pa.int32()),
        "payload": pa.array([m for _, m in rows], type=pa.binary()),
    })


def answers(kind: int, part: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({
        "block": pa.array([b for b, _ in rows], type=pa.int32()),
        "kind": pa.array([kind] * len(rows), type=pa.int32()),
        "part": pa.array([part] * len(rows), type=pa.int64()),
        "payload": pa.array([m for _, m in rows], type=pa.binary()),
    })


def by_part(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """The answers of one kind to a block, in the order of the parts."""
    rows = zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("payload").to_pylist())
    return sorted((p, m) for k, p, m in rows if k == kind)
