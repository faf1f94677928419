"""Exact quantiles by histogram refinement.

Spark's exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer, which cannot hold on very large tables. Here each wanted
order statistic is bracketed instead: a scan counts the rows of every bracket
in a fixed number of bins, the bin that holds the wanted rank becomes the next
bracket, and once a bracket is small its values are ranked directly. Every scan
shuffles at most (columns x brackets x bins) pre-aggregated rows, and the answer
is exact for any distribution, one hot value included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, copysign, floor, log1p

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.expressions import number

BINS = 4096
RANKED_DIRECTLY = 50_000


@dataclass
class _Target:
    """An order statistic (``rank`` counts from 0) known to lie in [lo, hi]."""

    column: str
    rank: int
    lo: float
    hi: float
    below: int
    inside: int


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    extent: dict[str, tuple[int, float, float]] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of every column, nulls left out.

    ``extent`` may pass (non-null count, minimum, maximum) per column when the
    caller has them; otherwise one aggregate finds them.
    """
    columns = list(columns)
    if not columns:
        return {}
    extent = extent or _extent(df, columns)

    wanted: dict[tuple[str, int], _Target] = {}
    for c in columns:
        n, lo, hi = extent[c]
        for p in probabilities if n else ():
            at = p * (n - 1)
            for rank in (floor(at), ceil(at)):
                wanted[c, rank] = _Target(c, rank, lo, hi, 0, n)

    first = True
    while True:
        open_targets = [t for t in wanted.values() if t.lo < t.hi and t.inside > RANKED_DIRECTLY]
        if not open_targets:
            break
        _narrow(df, open_targets, spread_out=first)
        first = False
    _rank_directly(df, [t for t in wanted.values() if t.lo < t.hi])

    result: dict[str, list[float | None]] = {}
    for c in columns:
        n = extent[c][0]
        values: list[float | None] = []
        for p in probabilities:
            if not n:
                values.append(None)
                continue
            at = p * (n - 1)
            left, right = wanted[c, floor(at)].lo, wanted[c, ceil(at)].lo
            values.append(left + (right - left) * (at - floor(at)))
        result[c] = values
    return result


def _extent(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    row = df.agg(
        *[
            e
            for i, c in enumerate(columns)
            for e in (
                F.count(number(c)).alias(f"n{i}"),
                F.min(number(c)).alias(f"lo{i}"),
                F.max(number(c)).alias(f"hi{i}"),
            )
        ]
    ).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def _table(df: DataFrame, names: str, rows: Sequence[tuple]) -> DataFrame:
    """A few rows of numbers as a local table (at most a handful per column of ``df``)."""
    cells = ", ".join("(" + ", ".join(f"{v!r}D" if isinstance(v, float) else f"{v}L" for v in row) + ")" for row in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {cells} AS t({names})")


def _brackets(targets: Sequence[_Target]) -> dict[tuple[str, float, float], list[_Target]]:
    grouped: dict[tuple[str, float, float], list[_Target]] = {}
    for t in targets:
        grouped.setdefault((t.column, t.lo, t.hi), []).append(t)
    return grouped


def _members(df: DataFrame, brackets, scale=float) -> DataFrame:
    """Rows (bracket, value, low, high) of the values that fall into any bracket,
    its ends on the given scale."""
    columns = list(dict.fromkeys(c for c, _, _ in brackets))
    cells = F.array(
        *[F.struct(F.lit(i).cast("bigint").alias("col"), number(c).alias("value")) for i, c in enumerate(columns)]
    )
    known = _table(
        df, "col, bracket, first, last, low, high",
        [(columns.index(c), i, float(lo), float(hi), scale(lo), scale(hi)) for i, (c, lo, hi) in enumerate(brackets)],
    )
    return (
        df.select(F.inline(cells))
        .join(F.broadcast(known), "col")  # at most six brackets per column
        .where(F.col("value").between(F.col("first"), F.col("last")))
        .select("bracket", "value", "low", "high")
    )


def _signed_log(x: float) -> float:
    return copysign(log1p(abs(x)), x)


def _bin(x: Column) -> Column:
    """Bin number of x; halves are compared, so that no difference overflows."""
    low, high = F.col("low"), F.col("high")
    share = F.coalesce(F.try_divide(x / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
    return F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1))


def _narrow(df: DataFrame, targets: Sequence[_Target], spread_out: bool) -> None:
    """Replace every target's bracket by the bin that holds its rank."""
    brackets = _brackets(targets)
    x, scale = F.col("value"), float
    if spread_out:  # the first bins are even in magnitude, so heavy tails do not crowd one bin
        x, scale = F.signum(x) * F.log1p(F.abs(x)), _signed_log
    bins = (
        _members(df, brackets, scale)
        .groupBy("bracket", _bin(x).alias("bin"))
        .agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    # At most BINS rows per bracket, so one window partition per bracket is small.
    order = W.partitionBy("bracket").orderBy("bin")
    found = _holding(bins.withColumn("upto", F.sum("n").over(order)), brackets)
    for i, ts in enumerate(brackets.values()):
        for t in ts:
            row = found[i, t.rank - t.below]
            t.below += row["upto"] - row["n"]
            t.lo, t.hi, t.inside = row["lo"], row["hi"], row["n"]


def _rank_directly(df: DataFrame, targets: Sequence[_Target]) -> None:
    if not targets:
        return
    brackets = _brackets(targets)
    counts = _members(df, brackets).groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    # A bracket holds at most RANKED_DIRECTLY rows here.
    order = W.partitionBy("bracket").orderBy("value")
    found = _holding(counts.withColumn("upto", F.sum("n").over(order)), brackets)
    for i, ts in enumerate(brackets.values()):
        for t in ts:
            t.lo = t.hi = found[i, t.rank - t.below]["value"]


def _holding(cumulated: DataFrame, brackets) -> dict[tuple[int, int], object]:
    """The one row per (bracket, rank) whose cumulated count first exceeds the rank."""
    ranks = [(i, t.rank - t.below) for i, ts in enumerate(brackets.values()) for t in ts]
    wanted = _table(cumulated, "bracket, rank", ranks)
    rows = (
        cumulated.join(F.broadcast(wanted), "bracket")
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        .collect()
    )  # one row per wanted rank
    return {(row["bracket"], row["rank"]): row for row in rows}
