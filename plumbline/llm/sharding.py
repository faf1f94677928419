"""Documents dealt into shards of equal bytes by a histogram sort.

Every row has a 128-bit key: the hash of its text, then one of its id and place. A key boundary (splitter) is wanted at every
shard's share of the bytes. Rows of the key table are sampled as probes, all tasks count the bytes and rows
below each probe exactly, and the interval that holds a splitter shrinks to the two probes around its target; the next
probes come from inside the open intervals only. A splitter is found as soon as a probe is close
enough, or its interval holds so few rows that they can be looked at one by one. Only then are rows moved, once. The sample decides
how fast this ends, never what the counts are; whatever the input, the sizes differ by the tolerance or by one row.

Boundaries between two texts are preferred to those inside a group of equal texts, so copies stay in one shard unless their
group is larger than the tolerance can bear; then it is cut by the second half of the key, as often as needed. A shard is
made up of pieces of bounded bytes, found by the same splitters, so that no task holds a shard.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored

# Fixed value: bytes that a row counts besides its text.
ROW_BYTES = 8

PIECE_BYTES = 1 << 30  # of a piece, in the mean, at most
TOLERANCE = 0.005  # of a mean shard, for a splitter between shards
PIECE_TOLERANCE = 0.25  # of a mean piece, for one inside a shard
PROBES = 16  # sampled rows for each open splitter and round
FEW = 32  # rows of an interval that are looked at one by one
KEY_BYTES = 16
LAST = (1 << 128) - 1


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(KEY_BYTES, b"\0"), "big")


def _array(numbers: list[int]) -> np.ndarray:
    """Keys as fixed byte strings, whose order is that of the numbers."""
    return np.frombuffer(b"".join(n.to_bytes(KEY_BYTES, "big") for n in numbers), dtype=f"S{KEY_BYTES}")


def _keys(high: pa.Array, low: pa.Array) -> np.ndarray:
    out = np.empty((len(high), 2), dtype=">u8")
    out[:, 0] = high.to_numpy(zero_copy_only=False).view(np.uint64)
    out[:, 1] = low.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.ascontiguousarray(out).view(f"S{KEY_BYTES}").reshape(-1)


@dataclass
class Splitter:
    """A boundary on its way: keys below ``low`` hold ``low_size`` bytes, not more than the target; below ``high`` there are not less."""

    target: float
    tolerance: float
    high: int
    high_size: int
    high_rows: int
    low: int = 0
    low_size: int = 0
    low_rows: int = 0
    best: tuple | None = None

    @property
    def key(self) -> int | None:
        return self.best[-1] if self.best else None

    @property
    def rows(self) -> int:
        return self.high_rows - self.low_rows

    def settle(self) -> None:
        """Take an end of the interval that is near enough, one between two texts first; if there is nothing between the ends, the nearer one."""
        ends = [(abs(self.low_size - self.target), self.low), (abs(self.high_size - self.target), self.high)]
        good = [(not between_texts(key), away, key) for away, key in ends if away <= self.tolerance]
        if self.rows == 0 or self.high - self.low <= 1:
            good = good or [min(ends)]
        self.best = min([*good, *([self.best] if self.best else [])], default=None)


def between_texts(key: int) -> bool:
    return key & (1 << 64) - 1 == 0 or key == LAST


def _histogram(keys: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows with keys below each probe; a task sends one row per gap between probes."""
    edges = _array(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1, dtype=np.int64), np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            at = np.searchsorted(edges, _keys(batch.column("high"), batch.column("low")), side="right")
            np.add.at(size, at, batch.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], ["gap", "size", "rows"])

    gaps = keys.select("high", "low", "size").mapInArrow(count, "gap long, size long, rows long")
    table = gaps.groupBy("gap").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toArrow()
    size, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
    gap = table.column("gap").to_numpy()
    size[gap], rows[gap] = table.column("size").to_numpy(), table.column("rows").to_numpy()
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _inside(keys: DataFrame, wanted: list[Splitter], share: float, seed: int) -> list[tuple[int, int]]:
    """(key, size) of a sample, or with a share of 1 of all rows, of the open intervals."""
    bounds = sorted({(s.low, s.high) for s in wanted})
    lows, highs = _array([a for a, _ in bounds]), _array([b for _, b in bounds])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _keys(batch.column("high"), batch.column("low"))
            at = np.searchsorted(lows, own, side="right") - 1
            good = np.flatnonzero((at >= 0) & (own < highs[np.maximum(at, 0)]))
            yield pa.RecordBatch.from_arrays([
                pa.array([own[i].ljust(KEY_BYTES, b"\0") for i in good], pa.binary()), batch.column("size").take(pa.array(good)),
            ], ["key", "size"])

    rows = keys.select("high", "low", "size")
    rows = rows if share >= 1 else rows.sample(share, seed=seed)
    table = rows.mapInArrow(within, "key binary, size long").toArrow()
    return sorted((_number(k), s) for k, s in zip(table.column("key").to_pylist(), table.column("size").to_pylist()))


def _boundaries(sampled: list[int]) -> list[int]:
    """Probes at the sampled rows, behind them, and around their texts."""
    out = {LAST}
    for key in sampled:
        out |= {key, min(key + 1, LAST), key >> 64 << 64, min((key >> 64) + 1 << 64, LAST)}
    return sorted(out)


def find_splitters(keys: DataFrame, volume: int, rows: int, shards: int, pieces: int) -> list[int]:
    """The keys at which the shards times ``pieces`` pieces begin, but for the first one, in rising order."""
    parts = shards * pieces
    splitters = [
        Splitter(volume * i / parts, TOLERANCE * volume / shards if i % pieces == 0 else PIECE_TOLERANCE * volume / parts, LAST, volume, rows)
        for i in range(1, parts)
    ]
    seed = 0
    while wanted := [s for s in splitters if s.key is None and s.rows > FEW]:
        # Neighbours may share an interval; its rows count once.
        inside = sum({s.low: s.rows for s in wanted}.values())
        probes = _boundaries([k for k, _ in _inside(keys, wanted, PROBES * len(wanted) / inside, seed)])
        size, counted = _histogram(keys, probes)
        for s in wanted:
            i = int(np.searchsorted(size, s.target, side="right"))  # the first probe with more bytes below
            if i > 0 and probes[i - 1] > s.low:
                s.low, s.low_size, s.low_rows = probes[i - 1], int(size[i - 1]), int(counted[i - 1])
            if i < len(probes) and probes[i] < s.high:
                s.high, s.high_size, s.high_rows = probes[i], int(size[i]), int(counted[i])
            s.settle()
        seed += 1
    if few := [s for s in splitters if s.key is None]:
        found = _inside(keys, few, 1.0, 0)
        names = [k for k, _ in found]
        for s in few:
            first, last = bisect_left(names, s.low), bisect_left(names, s.high)
            size, ends = s.low_size, [(s.high_size, s.high)]
            for i in range(first, last):
                edge = names[i] >> 64 << 64
                alone = edge >= s.low and (i == first or names[i - 1] < edge)
                ends.append((size, edge if alone else names[i]))
                size += found[i][1]
            near = [(abs(below - s.target), key) for below, key in ends]
            good = [(not between_texts(key), away, key) for away, key in near if away <= s.tolerance]
            s.best = min(good or [(False, *min(near))])
    return sorted(s.key for s in splitters)


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False,
) -> DataFrame:
    """One row per input row: its id, ``size``, ``text_crc32``, ``shard`` from 0 and ``slot``, from 0 and without gaps in its shard.

    ``size`` is the length of the UTF-8 text plus 8; the sizes of the shards are as near to equal as whole rows and the
    tolerance allow. A null text counts as empty. Rows of a shard are in the order of a hash, equal texts side by side. Rows
    that share an id, or have none, are rows of their own. More shards than rows leave some empty; an empty table
    gives no rows. With ``whole_rows`` the input row comes along as the struct ``row``, under whatever column names it has.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    # The last bits tell rows with one id and text apart; written once, so that they stay what they are.
    place = F.xxhash64(F.monotonically_increasing_id())
    mask = (1 << 24) - 1
    keyed = stored(docs.select(
        *([F.struct("*").alias("row")] if whole_rows else []),
        col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("high"),
        F.xxhash64(col(id_col)).bitwiseAND(F.lit(~mask)).bitwiseOR(place.bitwiseAND(F.lit(mask))).alias("low"),
    ))
    rows, volume = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wished = max(math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards), math.ceil(volume / shards / PIECE_BYTES))
    pieces = max(1, min(wished, rows // (shards * FEW)))
    splitters = find_splitters(keyed, volume, rows, shards, pieces) if rows else []
    edges = _array(splitters) if splitters else np.empty(0, dtype=f"S{KEY_BYTES}")
    # Rows before each piece of its shard; one row per piece.
    _, before = _histogram(keyed, splitters) if splitters else (None, np.empty(0, dtype=np.int64))
    starts = np.concatenate([[0], before]).astype(np.int64)
    offsets = starts - starts[np.arange(len(starts)) // pieces * pieces]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _keys(batch.column("high"), batch.column("low"))
            at = np.searchsorted(edges, own, side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.astype(np.int32)), pa.array(offsets[at])], [*batch.schema.names, "piece", "offset"]
            )

    sign = F.lit(-(1 << 63))  # signed longs in the order of unsigned ones
    order = Window.partitionBy("piece").orderBy(F.col("high").bitwiseXOR(sign), F.col("low").bitwiseXOR(sign))
    schema = T.StructType([*keyed.schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("offset", T.LongType())])
    placed = keyed.mapInArrow(part, schema)
    return placed.select(
        *(["row"] if whole_rows else []),
        F.col("id").alias(id_col), "size", "text_crc32", F.floor(F.col("piece") / pieces).cast("int").alias("shard"),
        (F.row_number().over(order) - 1 + F.col("offset")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows with all their columns as struct ``row``, next to ``slot``, in Parquet folders ``shard=0``, ``shard=1``, ..."""
    shard_documents(docs, shards, id_col, text_col, whole_rows=True).select("row", "slot", "shard").write.partitionBy("shard").parquet(path)
