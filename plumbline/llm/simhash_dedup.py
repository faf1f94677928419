"""SimHash near-duplicates with pivot distance tables.

Fingerprints at most three bits apart agree on at least three of six blocks of
their bits, so every such pair meets under one of twenty keys of three blocks
(a pivot distance alone lets about half of all pairs of random fingerprints pass, too many
to make pairs from). Under a key the pairs are not all compared: a table holds
the Hamming distance of every fingerprint to a number of reference fingerprints.
Fingerprints are sorted by the first distance and only those whose distances
differ by at most the limit go on; a pair whose distances to any reference differ
by more is discarded, as the triangle inequality allows; the survivors are
verified bit by bit.

Equal fingerprints are one row from the start. A key with very many fingerprints
is cut into chunks, and pairs of chunks are compared apart. A task passes on
a star per component it has found, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored
from plumbline.llm.bytesops import ragged, text_bytes, text_groups, words_of
from plumbline.llm.components import connected_components, local_roots

SEED = 42
PIVOTS = 16
CHUNK = 1024  # fingerprints of one key compared with as many others at a time
PAIRS_AT_A_TIME = 4_000_000
TEXT_AT_A_TIME = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def references(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, and spread over all of the space."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, dtype=np.uint64)


def fingerprints(data: np.ndarray, bounds: np.ndarray, shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints of lower-cased texts; a text without words has fingerprint zero."""
    data = _LOWER[data]
    starts, ends, words = words_of(data, bounds)
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    lengths = ends - starts + 1
    joined = np.append(data, np.uint8(32))[ragged(starts, lengths)]
    after = np.cumsum(lengths)
    joined[after - 1] = 32
    count = np.diff(words)
    full = np.flatnonzero(count > 0)
    if len(full) == 0:
        return out
    number = np.maximum(count[full] - shingle + 1, 1)
    first = ragged(words[:-1][full], number)
    last = first + np.repeat(np.minimum(count[full], shingle), number) - 1
    before = after - lengths
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(text[a:b], SEED) for a, b in zip(before[first].tolist(), (after[last] - 1).tolist())], dtype="<u8"
    )
    begin = np.cumsum(number) - number
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > number[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp), one row per input row; the 64 bits are held as a signed integer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for first, last in text_groups(bounds, TEXT_AT_A_TIME):
                made = fingerprints(data[bounds[first]:bounds[last]], bounds[first: last + 1] - bounds[first], shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(made.view(np.int64))], ["doc_id", "fp"]
                )

    picked = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(work, "doc_id long, fp long")


def shared_keys(fp: Column, distance: int) -> Column:
    """Keys of which two fingerprints within ``distance`` bits share one: all choices of
    ``distance`` blocks out of twice as many, with the bits in them and the number of the choice."""
    size = 2 * max(distance, 1)
    cuts = [round(64 * i / size) for i in range(size + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(size)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(masks, size - distance)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def linked_in_groups(groups: np.ndarray, chunk: np.ndarray, low: np.ndarray, high: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group within ``distance`` bits; in a group of two chunks, one row of each.

    ``groups`` rises. The table of distances to the references discards pairs
    before their bits are compared.
    """
    table = np.bitwise_count(fp[:, None] ^ references()[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], groups))
    place = groups[order].astype(np.int64) * 256 + table[order, 0]
    stop = np.searchsorted(place, place + distance, side="right")
    reach = stop - np.arange(len(order)) - 1
    found_a, found_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    begin = 0
    total = np.cumsum(reach)
    while begin < len(order):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + PAIRS_AT_A_TIME, side="right")))
        rows = np.arange(begin, end)
        a = order[np.repeat(rows, reach[begin:end])]
        b = order[ragged(rows + 1, reach[begin:end])]
        apart = (low[a] == high[a]) | (chunk[a] != chunk[b])
        a, b = a[apart], b[apart]
        for k in range(1, table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= distance
            a, b = a[near], b[near]
        same = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        found_a.append(a[same])
        found_b.append(b[same])
        begin = end
    return np.concatenate(found_a), np.concatenate(found_b)


def link_fingerprints(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: their components are those of all pairs within ``distance`` bits."""
    keyed = distinct.select("fp", F.inline(shared_keys(F.col("fp"), distance)))
    shared = keyed.groupBy("choice", "bits").count().filter(F.col("count") > 1)
    spread = (
        keyed.join(shared, ["choice", "bits"])
        .withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
        .withColumn("chunk", F.expr("cast(pmod(xxhash64(fp), chunks) as int)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("choice", "bits", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "fp")
    )
    cell = ["choice", "bits", "low", "high"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            rows = [r for r in (held, batch) if r is not None]
            if not rows:
                return
            table = pa.Table.from_batches(rows).combine_chunks()
            columns = [table.column(c).to_numpy() for c in ("choice", "bits", "low", "high", "chunk", "fp")]
            new = np.ones(len(table), dtype=bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            # The last cell may go on in the next batch.
            cut = len(table) if batch is None else int(np.flatnonzero(new)[-1]) if len(table) else 0
            held = table.slice(cut).combine_chunks().to_batches()[0] if cut < len(table) else None
            if cut == 0:
                continue
            groups = np.cumsum(new[:cut])
            _, _, low, high, chunk, fp = (c[:cut] for c in columns)
            a, b = linked_in_groups(groups, chunk, low, high, fp.view(np.uint64), distance)
            values, index = np.unique(fp, return_inverse=True)
            root = local_roots(len(values), index[a], index[b])
            linked = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked]), pa.array(values[root[linked]])], ["a", "b"])

    return spread.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(work, "a long, b long")


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3,
) -> DataFrame:
    """One row per input row: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Texts are lower-cased (A-Z) and split at ASCII white space; shingles of
    ``shingle`` words, repeats included, vote with their XXH64. A text with fewer
    words is one shingle; null, empty and blank texts have fingerprint zero and are
    linked like any other. ``component_id`` is the smallest id reachable over
    links of at most ``distance`` bits, null if all ids there are null. Rows with
    equal ids count each for itself. An empty table gives no rows. Other columns are not read.
    """
    marked = stored(fingerprint_documents(docs, id_col, text_col, shingle))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = connected_components(link_fingerprints(distinct, distance))
    named = distinct.join(components, distinct["fp"] == components["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = stored(named)
    # Stored sides let Spark split a join where one fingerprint or component holds very many rows.
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")))
    names = stored(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    whole = marked.join(names, "fp")
    return whole.select(
        F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows with the smallest id of their group, with all their columns; a row without an id stays.

    Rows that share this smallest id all stay: equal rows are for exact deduplication.
    """
    groups = near_duplicate_groups(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), shingle=shingle, distance=distance)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col(f"row.`{id_col}`").cast("long") == F.col("gone"), "left_anti").select("row.*")
