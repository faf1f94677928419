"""Reading, checking and writing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import Query, rounded
from plumbline.functions.storage import scratch_path
from plumbline.sources.tables import as_json, read_table, validate


def _orders(load):
    """Orders with a missing value in every column but the key."""
    return load("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("day"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Größe \ufffd "), "o_orderstatus")).alias("note"),
    )


ORDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN round(o_totalprice, 6) END AS price,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'Größe ' || chr(65533) || ' ' || o_orderstatus END AS note FROM orders"""


def _through(ending: str, encoding: str = "UTF-8", gap: str = " "):
    """The table written to a file and read by its path."""
    def run(load):
        table = _orders(load).withColumn("note", F.replace("note", F.lit(" "), F.lit(gap)))
        if encoding != "UTF-8":
            table = table.withColumn("note", F.regexp_replace("note", "\ufffd", "é"))
        path = scratch_path(table.sparkSession, ending)
        if ending == ".csv":
            table.write.csv(path, header=True, encoding=encoding)
        else:
            table.write.parquet(path)
        return rounded(read_table(table.sparkSession, path))
    return run


QUERIES = [
    Query("read_csv", _through(".csv"), ORDERS),
    Query("read_csv_lines", _through(".csv", gap="\n"), ORDERS.replace("' '", "chr(10)").replace("'Größe '", "'Größe' || chr(10)")),
    Query("read_csv_latin", _through(".csv", "ISO-8859-1"), ORDERS.replace("chr(65533)", "'é'")),
    Query("read_parquet", _through(".parquet"), ORDERS),
    Query(
        "validate_table",
        lambda load: validate(load("events")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
        "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    ),
    Query(
        "table_as_json",
        lambda load: as_json(load("orders").select("o_orderkey", "o_orderdate", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))),
        """SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_orderdate': strftime(o_orderdate, '%Y-%m-%d'),
  'o_orderstatus': o_orderstatus, 'priority': nullif(o_orderpriority, '5-LOW')}) AS VARCHAR) AS json FROM orders""",
    ),
]
