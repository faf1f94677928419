"""What a catalogue entry is: a query on the sample tables and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Load = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Load], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))


def rounded(df: DataFrame, decimals: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, integers as bigint, dates as text: comparable with the check."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns a rounded -0.0 into 0.0.
            out.append((F.round(c, special.get(f.name, decimals)) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(c.cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.append(c.cast("date").cast("string").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def r(expression: str, decimals: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {decimals}) + 0.0"


def union(names: Sequence[str], template: Callable[[int, str], str]) -> str:
    return "\nUNION ALL\n".join(template(i, n) for i, n in enumerate(names))


def values(names: Sequence[str], label: str = "column") -> str:
    """A VALUES table (label, label_pos)."""
    rows = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    return f'(VALUES {rows}) AS names("{label}", "{label}_pos")'


LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def lineitem_with_nulls(load: Load) -> DataFrame:
    """The sample tables hold no nulls: some values are taken out by rule."""
    return load("lineitem").select(
        "l_orderkey",
        "l_quantity",
        F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        F.when(F.col("l_quantity") < 40, F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.lit(7.0).alias("constant"),
        "l_returnflag",
    )


def lineitem_non_finite(load: Load) -> DataFrame:
    """The same table with NaN and infinities in the places of the nulls of its doubles."""
    odd = F.when(F.col("l_orderkey") % 3 == 0, float("nan")).when(F.col("l_orderkey") % 3 == 1, float("inf")).otherwise(float("-inf"))
    table = lineitem_with_nulls(load)
    return table.select(*[
        F.coalesce(f.name, odd).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in table.schema
    ])


LINEITEM_WITH_NULLS = """lineitem_with_nulls AS (
  SELECT l_orderkey, l_quantity, nullif(l_discount, 0.05) AS l_discount,
         CASE WHEN l_quantity < 40 THEN l_tax END AS l_tax,
         CASE WHEN l_linenumber > 1 THEN l_extendedprice END AS l_extendedprice,
         CAST(7.0 AS DOUBLE) AS constant, l_returnflag
  FROM lineitem)"""
NULLED_NUMBERS = ["l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "constant"]


def places(load: Load) -> DataFrame:
    """Customers with their region and derived coordinates, some of them missing."""
    return (
        load("customer")
        .join(load("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "c_acctbal",
            "c_custkey",
            F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") * 7 % 180 - 90.0).alias("latitude"),
            F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") * 13 % 360 - 180.0).alias("longitude"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("country"),
            "c_mktsegment",
        )
    )


PLACES = """places AS (
  SELECT c_acctbal, c_custkey,
         CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey * 7 % 180 AS DOUBLE) - 90.0 END AS latitude,
         CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 13 % 360 AS DOUBLE) - 180.0 END AS longitude,
         r_name AS region, n_name AS country, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
