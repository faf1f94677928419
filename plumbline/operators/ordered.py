"""Work on rows in a global order, with one exchange of the rows.

Rows are range-partitioned by the order (Spark draws the ranges from a sample of the keys, balanced by row count; their
number follows from the number of rows) and the layout is written to the checkpoint folder, so that every later pass
sees the same partitions. Passes run inside the partitions, batch by batch, without another exchange. What
crosses a border is small: a row per partition with its length and last known values, and for moving averages the
few rows around each border.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from plumbline.functions.expressions import col, number, numeric_columns
from plumbline.functions.storage import cut_lineage

# Rows per range; each range is one task.
RANGE_ROWS = 500_000
SEED = 42
# Shortest table with a profile, longest period, values reported.
ENOUGH_ROWS, LONGEST_PERIOD, REPORTED = 30, 30, 5


def lay_out(df: DataFrame, order: Sequence[Column], range_rows: int | None = None) -> DataFrame:
    """Rows sorted across partitions; ``__part`` is the number of the partition.

    A random last sort key spreads rows that are equal in the whole order, so
    that no partition has to take all copies.
    """
    ranges = max(1, -(-df.count() // (range_rows or RANGE_ROWS)))
    spread = F.col("__spread").asc()
    return cut_lineage(
        df.withColumn("__spread", F.rand(SEED))
        .repartitionByRange(ranges, *order, spread)
        .sortWithinPartitions(*order, spread)
        .drop("__spread")
        .withColumn("__part", F.spark_partition_id())
    )


def _same(a: tuple, b: tuple) -> bool:
    """Equal keys; nulls are equal to each other, and so are NaNs."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


class _Carry:
    """Last known values of the key that the rows have reached."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str]):
        self.keys, self.columns = list(keys), list(columns)
        self.key: tuple | None = None
        self.last: dict[str, pa.Array] = {}

    def take(self, batch: pa.RecordBatch) -> list[pa.Array]:
        """The batch's columns with nulls replaced; goes on to its last key and values."""
        n = batch.num_rows
        new = np.zeros(n, dtype=bool)
        for k in self.keys:
            code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        first, last = (tuple(batch.column(k)[i].as_py() for k in self.keys) for i in (0, n - 1))
        goes_on = self.key is not None and _same(first, self.key)
        # The place where the key of each row begins; 0 is the value carried so far.
        begin = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0 if goes_on else 1))
        filled = []
        for c in self.columns:
            own = batch.column(c)
            before = self.last[c].cast(own.type) if goes_on else pa.nulls(1, own.type)
            both = pa.concat_arrays([before, own])
            known = np.concatenate([[0], np.where(pc.is_valid(own).to_numpy(zero_copy_only=False), np.arange(1, n + 1), 0)])
            at = np.maximum.accumulate(known)[1:]
            out = both.take(pa.array(at, mask=at < begin))
            filled.append(out)
            self.last[c] = out.slice(n - 1, 1)
        self.key = last
        return filled


def _ends(keys: list[str], columns: list[str]):
    """A row per partition: its number, first and last key, and the last known values of the last key, if the partition has any rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, first, part = _Carry(keys, columns), None, None
        types = {}
        for batch in batches:
            if batch.num_rows:
                types = {f.name: f.type for f in batch.schema}
                part = batch.column("__part")[0].as_py()
                first = first or tuple(batch.column(k).slice(0, 1) for k in keys)
                carry.take(batch)
                last = [batch.column(k).slice(batch.num_rows - 1, 1) for k in keys]
        if part is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], types["__part"]), *first, *last, *[carry.last[c] for c in columns]],
                ["part", *[f"first{i}" for i in range(len(keys))], *[f"last{i}" for i in range(len(keys))], *[f"value{i}" for i in range(len(columns))]],
            )

    return summarise


def _carried(laid: DataFrame, keys: list[str], columns: list[str]) -> dict[int, tuple[tuple, dict[str, pa.Array]]]:
    """For each partition the key that the ones before it have reached, with its last known values. One row per range."""
    field = {f.name: f.dataType for f in laid.schema}
    schema = T.StructType([T.StructField("part", T.IntegerType())] + [
        T.StructField(f"{name}{i}", field[c])
        for name, own in (("first", keys), ("last", keys), ("value", columns)) for i, c in enumerate(own)
    ])
    table = laid.select(*[col(c) for c in dict.fromkeys([*keys, *columns])], "__part").mapInArrow(_ends(keys, columns), schema)
    rows = table.toArrow().combine_chunks().sort_by("part")
    out: dict[int, tuple[tuple, dict[str, pa.Array]]] = {}
    key: tuple | None = None
    known: dict[str, pa.Array] = {}
    for i, part in enumerate(rows.column("part").to_pylist()):
        if key is not None:
            out[part] = (key, dict(known))
        first, last = (tuple(rows.column(f"{name}{j}")[i].as_py() for j in range(len(keys))) for name in ("first", "last"))
        goes_on = key is not None and _same(first, key) and _same(last, key)
        for j, c in enumerate(columns):
            own = rows.column(f"value{j}").combine_chunks().slice(i, 1)
            if not goes_on or own.null_count == 0:
                known[c] = own
        key = last
    return out


def _filled(laid: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The layout with the nulls of the columns replaced by the last value before them."""
    columns, keys = list(columns), list(keys)
    carried = _carried(laid, keys, columns)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if carry is None:
                carry = _Carry(keys, columns)
                carry.key, carry.last = carried.get(batch.column("__part")[0].as_py(), (None, {}))
            filled = dict(zip(columns, carry.take(batch)))
            yield pa.RecordBatch.from_arrays([filled.get(f.name, batch.column(f.name)) for f in batch.schema], schema=batch.schema)

    return laid.mapInArrow(fill, laid.schema)


def forward_fill(
    df: DataFrame, order_by: str, columns: Sequence[str], keys: Sequence[str] = (), range_rows: int | None = None
) -> DataFrame:
    """Replace nulls by the last value before them in the order of ``order_by``.

    Rows without an order value come last. With ``keys`` every key is filled on
    its own; a key that holds much of the table is spread over many tasks.
    """
    order = [col(k).asc_nulls_first() for k in keys] + [col(order_by).asc_nulls_last()]
    # Within equal order values, known values come first.
    ties = [col(c).asc_nulls_last() for c in columns]
    return _filled(lay_out(df, order + ties, range_rows), columns, keys).drop("__part")


def row_series_profile(
    df: DataFrame, date_column: str, column: str | None = None, range_rows: int | None = None
) -> DataFrame:
    """(part, idx, value): the table as one series of rows sorted by date.

    Nulls of the column are filled forwards, then the rows are decomposed with
    period min(30, rows / 2): the last five trend values, the first five
    seasonal values and the sample deviation of the residual. Fewer than 30
    rows give nothing. Equal (date, value) rows are interchangeable.
    """
    column = column or numeric_columns(df)[0]
    rows = df.select(col(date_column).cast("timestamp").alias("ts"), number(column).alias("value"))
    laid = lay_out(rows, [F.col("ts").asc_nulls_last(), F.col("value").asc_nulls_last()], range_rows)
    # One row per range.
    lengths = {r["__part"]: r["count"] for r in laid.groupBy("__part").count().collect()}
    n_rows = sum(lengths.values())
    if n_rows < ENOUGH_ROWS:
        return df.sparkSession.createDataFrame([], "part string, idx int, value double")
    period = min(LONGEST_PERIOD, n_rows // 2)
    starts = dict(zip(sorted(lengths), np.cumsum([0, *[lengths[p] for p in sorted(lengths)]]).tolist()))
    smooth = _moving_average(_filled(laid, ["value"]).select("value", "__part"), starts, n_rows, period)
    return _profile(smooth, n_rows, period, period // 2)


def _trend(values: np.ndarray, period: int) -> np.ndarray:
    """Centred moving averages of the rows that have half a period on both sides; an even one counts its two ends half."""
    half = period // 2
    weights = np.ones(2 * half + 1)
    if period % 2 == 0:
        weights[[0, -1]] = 0.5
    return np.lib.stride_tricks.sliding_window_view(values, 2 * half + 1) @ weights / period


def _moving_average(rows: DataFrame, starts: dict[int, int], n_rows: int, period: int) -> DataFrame:
    """(pos, value, trend) per row. Averages that reach over a border of the layout are made from the rows around it."""
    half = period // 2
    borders = np.array(sorted(s for s in starts.values() if s > 0), dtype=np.int64)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their trend, and copies of the rows near a border with its number; ``own`` if the border is to make the row."""
        held, at = np.empty(0), None  # the last rows of the partition so far, and where they begin
        names = ["pos", "value", "trend", "border", "own"]

        def near(pos: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            first, last = (np.searchsorted(borders, pos + d, side) for d, side in ((-2 * half, "left"), (2 * half, "right")))
            count = last - first
            row = np.repeat(np.arange(len(pos)), count)
            border = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
            # A window from pos - half to pos + half crosses the borders in between; the first of them makes the row.
            maker = np.searchsorted(borders, pos - half, side="right")
            own = (border == maker[row]) & (borders[border] <= pos[row] + half)
            return pa.RecordBatch.from_arrays(
                [pa.array(pos[row]), pa.array(value[row], mask=np.isnan(value[row])), pa.nulls(len(row), pa.float64()), pa.array(border), pa.array(own)], names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if at is None:
                at = starts[batch.column("__part")[0].as_py()]
            value = batch.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False)
            begin = at + len(held)
            yield near(np.arange(begin, begin + len(value)), value)
            held = np.concatenate([held, value])
            if len(held) > 2 * half:
                trend = _trend(held, period)
                pos = np.arange(at + half, at + half + len(trend))
                own = held[half: half + len(trend)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(pos), pa.array(own, mask=np.isnan(own)), pa.array(trend, mask=np.isnan(trend)),
                    pa.nulls(len(pos), pa.int64()), pa.array(np.ones(len(pos), dtype=bool)),
                ], names)
                at += len(trend)
                held = held[len(trend):]

    found = rows.mapInArrow(inside, "pos long, value double, trend double, border long, own boolean")
    window = W.partitionBy("border").orderBy("pos").rowsBetween(-half, half)
    ends = F.lag("value", half).over(W.partitionBy("border").orderBy("pos")) + F.lead("value", half).over(W.partitionBy("border").orderBy("pos"))
    total = F.sum("value").over(window) - (ends / 2 if period % 2 == 0 else F.lit(0.0))
    around = (
        found.filter(F.col("border").isNotNull())
        .withColumn("trend", F.when(F.count("value").over(window) == 2 * half + 1, total / period))
        .filter("own")
    )
    whole = found.filter(F.col("border").isNull()).select("pos", "value", "trend")
    # Rows at the very beginning and end have no trend and play no part in what follows.
    return whole.unionByName(around.select("pos", "value", "trend"))


def _profile(smooth: DataFrame, n_rows: int, period: int, half: int) -> DataFrame:
    """One aggregate per phase of the period; all results follow from those rows."""
    tail = n_rows - half - REPORTED
    detrended = F.col("value") - F.col("trend")
    phases = smooth.groupBy((F.col("pos") % period).alias("phase")).agg(
        F.count(detrended).alias("n"),
        F.avg(detrended).alias("mean"),
        F.var_pop(detrended).alias("spread"),
        *[F.max(F.when(F.col("pos") == tail + i, F.col("trend"))).alias(f"t{i}") for i in range(REPORTED)],
    )
    # At most 30 rows. The residual of a phase is its detrended values less a constant.
    one = phases.agg(
        F.avg("mean").alias("centre"),
        F.sqrt(F.sum(F.col("spread") * F.col("n")) / (F.sum("n") - 1)).alias("deviation"),
        *[F.max(f"t{i}").alias(f"t{i}") for i in range(REPORTED)],
        *[F.max(F.when(F.col("phase") == i, F.col("mean"))).alias(f"s{i}") for i in range(REPORTED)],
    )
    entries = (
        [(("trend", i), F.col(f"t{i}")) for i in range(REPORTED)]
        + [(("seasonal", i), F.col(f"s{i}") - F.col("centre")) for i in range(REPORTED)]
        + [(("residual_std", 0), F.col("deviation"))]
    )
    return one.select(
        F.inline(F.array(*[
            F.struct(F.lit(part).alias("part"), F.lit(i).alias("idx"), value.alias("value"))
            for (part, i), value in entries
        ]))
    )
