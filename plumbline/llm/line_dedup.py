"""Repeated lines, found with levelled sorted runs of line hashes.

A ``LineRuns`` store takes batches of documents. The hashes of a batch are
merge-joined against the runs: those that no run holds yet become the batch's
own run, so that a hash stands in one run only; those already held are noted as
repeats with their counts. Runs are sorted by hash and stored in the shared
checkpoint folder. As soon as a level holds ``fanout`` runs they are merged into
one run of the next level, so a batch never meets more than a few runs per level.
Only built-in functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored

# What is stripped from both ends of a line.
STRIPPED = " \u0009\u000a\u000b\u000c\u000d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["h1", "h2"]
BATCHES = 4


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    """One row per line of at least ``min_length`` code points: doc_id, text_hash, place, h1, h2.

    A line's key is stripped and lower-cased (A-Z); 128 bits of hash stand for it.
    ``text_hash`` tells rows with equal ids but different texts apart.
    """
    lines = docs.select(
        col(id_col).alias("doc_id"),
        F.xxhash64(_text(col(text_col))).alias("text_hash"),
        F.posexplode(F.split(F.translate(_text(col(text_col)), UPPER, UPPER.lower()), "\n")).alias("place", "line"),
    ).select("doc_id", "text_hash", "place", F.btrim("line", F.lit(STRIPPED)).alias("key"))
    return lines.filter(F.char_length("key") >= min_length).select(
        "doc_id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2")
    )


class LineRuns:
    """Which line hashes were seen, in how many documents, and the largest id among them."""

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Take a batch of ``keyed_lines``. A document must lie in one batch."""
        counted = stored(
            lines.select("doc_id", *HASH).distinct()
            .groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id"))
        )
        runs = self.runs()
        fresh = counted
        if runs:
            held = reduce(DataFrame.unionByName, runs).select(*HASH)
            fresh = counted.join(held.hint("merge"), HASH, "left_anti")
            self.repeats.append(stored(counted.join(held.hint("merge"), HASH, "left_semi")))
        self._place(self._sorted(fresh), 0)

    @staticmethod
    def _sorted(run: DataFrame) -> DataFrame:
        return stored(run.repartitionByRange(*HASH).sortWithinPartitions(*HASH))

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._sorted(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self._place(merged, level + 1)

    def common(self, min_docs: int) -> DataFrame:
        """Hashes held by at least ``min_docs`` documents, with the largest id."""
        return (
            reduce(DataFrame.unionByName, self.runs() + self.repeats)
            .groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))
            .filter(F.col("n_docs") >= min_docs)
        )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 40, min_docs: int = 5, batches: int = BATCHES,
) -> DataFrame:
    """One row per input row: its id, ``n_lines``, ``n_dropped`` and ``kept_text``.

    Keys of ``min_length`` code points or more that ``min_docs`` documents hold lose
    all their lines, but for those in the document with the largest id. A null or
    empty text is one empty line. Rows with equal ids are one document when
    documents are counted; a null id is an id of its own, smaller than all others.
    A document that holds a line many times counts once. An empty table gives no rows.
    Other columns are not read.
    """
    spread = keyed_lines(docs, id_col, text_col, min_length).withColumn(
        "batch", F.expr(f"cast(pmod(xxhash64(doc_id), {batches}) as int)")
    )
    lines = stored(spread)
    store = LineRuns()
    for i in range(batches):
        store.add(lines.filter(F.col("batch") == i))
    # A stored side lets Spark split the join where one line is in very many documents.
    dropped = (
        lines.join(stored(store.common(min_docs)), HASH)
        .filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        .select("doc_id", "text_hash", "place")
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("place")).alias("places"))
    )
    # 0 for a line that stays and 1 for one that goes; made here so that it is not made again for every line.
    marks = dropped.select(
        F.col("doc_id").alias("marked_id"),
        F.col("text_hash").alias("marked_hash"),
        F.size("places").cast("long").alias("n_dropped"),
        F.split(
            F.array_join(F.expr("transform(places, (p, i) -> repeat('0', p - coalesce(get(places, i - 1), -1) - 1) || '1')"), ""), ""
        ).alias("marks"),
    )
    whole = docs.select(
        col(id_col).alias("doc_id"), _text(col(text_col)).alias("text"), F.xxhash64(_text(col(text_col))).alias("text_hash")
    )
    joined = whole.join(
        marks, F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("text_hash") == F.col("marked_hash")), "left"
    )
    stays = F.filter(F.split("text", "\n"), lambda line, i: F.coalesce(F.get("marks", i), F.lit("0")) != "1")
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
    )
