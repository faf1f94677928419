"""Exact duplicates of texts by sorting the contents.

Rows are range-partitioned by the head of the normalised bytes (sampled
splitters), an external sort inside each partition places equal texts side by
side, and neighbours are compared in full. Ties of the head are ordered by a
hash of the whole text, so that texts with a common beginning spread out too.

A text that very many rows share would fill one range. Such texts show up in a
sample of the hashes; their rows get a salt and so fall into several ranges,
each of which leaves one survivor. The survivors, a few rows per range, meet in a
second round and are grouped by their full text. The sample decides only the
layout, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEAD = 24  # characters that order the ranges before the hash does
RANGES_PER_PARTITION = 4  # a salted range holds a quarter of a mean partition
LEAST_RANGE = 50  # rows
SAMPLED_PER_RANGE = 20  # rows of the sample that fall into a mean range


def normalised(text: Column) -> Column:
    """Null counts as empty; A-Z become a-z, nothing else changes."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", whole_rows: bool = False) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of rows with equal normalised texts the one with the smallest (or
    ``keep="largest"``) id is kept; ids are null only if all are, as null comes
    last. Rows that repeat an id count each for itself and exactly one row of a
    group is kept, which of the equal ids being left open. Null texts are empty
    texts. An empty table gives no rows. With ``whole_rows`` the input row comes
    along as the struct ``row``, under whatever column names it has.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    taken = docs.select(F.struct("*").alias("row")) if whole_rows else docs.select(
        F.struct(col(id_col).alias("id"), col(text_col).alias("text")).alias("row")
    )
    id_, text = (f"row.`{c.replace('`', '``')}`" for c in ((id_col, text_col) if whole_rows else ("id", "text")))
    hashed = taken.select(
        "row",
        F.substring(normalised(F.col(text)), 1, HEAD).alias("head"),
        F.xxhash64(normalised(F.col(text))).alias("hash"),
    )
    rows = docs.count()
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    range_rows = max(LEAST_RANGE, rows // ranges)
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(rows, 1))
    # Only texts with the rows of two ranges or more are listed: half as many as there are ranges.
    seen = docs.select(col(text_col).alias("text")).sample(share, seed=1)
    hot = stored(
        seen.groupBy(F.xxhash64(normalised(F.col("text"))).alias("hash")).count()
        .filter(F.col("count") / share > 2 * range_rows)
        .select("hash", F.ceil(F.col("count") / share / range_rows).alias("salts"))
    )
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    same = (
        Window.partitionBy("head", "hash", "salt", "text").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    laid_out = (
        hashed.join(F.broadcast(hot), "hash", "left")
        .withColumn("salt", F.coalesce(F.expr(f"pmod(xxhash64({id_}), salts)"), F.lit(-1)))
        .drop("salts")
        .repartitionByRange("head", "hash", "salt")
    )
    local = stored(
        laid_out.select("head", "hash", "salt", "row", F.col(id_).alias("id"), normalised(F.col(text)).alias("text"))
        .select(
            "*",
            F.first("id").over(same).alias("local_id"),
            F.count(F.lit(1)).over(same).alias("local_size"),
            F.row_number().over(Window.partitionBy("head", "hash", "salt", "text").orderBy(order)).alias("place"),
        )
        .select(
            *(["row"] if whole_rows else []),
            "id", "local_id", "local_size",
            (F.col("place") == 1).alias("first"),
            F.sha2(F.col("text"), 256).alias("text_sha256"),
            F.when((F.col("salt") >= 0) & (F.col("place") == 1), F.col("text")).alias("survivor"),
        )
    )
    pick = F.min if keep == "smallest" else F.max
    # One row per salted text; those are at most half as many as ranges.
    met = (
        local.filter(F.col("survivor").isNotNull())
        .groupBy("survivor")
        .agg(pick("local_id").alias("met_id"), F.sum("local_size").alias("met_size"))
        .select(F.sha2("survivor", 256).alias("text_sha256"), "met_id", "met_size", F.lit(True).alias("met"))
    )
    whole = local.join(F.broadcast(met), "text_sha256", "left")
    return whole.select(
        *(["row"] if whole_rows else []),
        F.col("id").alias(id_col),
        F.when(F.col("met"), F.col("met_id")).otherwise(F.col("local_id")).alias("keep_id"),
        F.coalesce("met_size", "local_size").alias("group_size"),
        (F.col("first") & (F.col("met").isNull() | F.col("local_id").eqNullSafe(F.col("met_id")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that ``content_groups`` keeps, with all their columns."""
    return content_groups(docs, id_col, text_col, keep, whole_rows=True).filter("kept").select("row.*")
