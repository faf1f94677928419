"""Near-duplicate vectors with an inverted multi-index.

Each half of the (normalised) vectors has its own codebook; a pair of codes is a
cell of the product grid, and every vector lies in one cell. To look for its
neighbours a vector visits cells in the order of their distance, by a
multi-sequence traversal of the two sorted lists of codes. The distance of a code is
how far the half must at least move to get there, and the traversal stops at a
distance calibrated on a sample: neighbours at the limit of similarity lie in the
cells visited up to there with the target recall. Candidates are verified in double precision.

Codebooks are fitted on a bounded sample; every vector is indexed and every
vector looks for neighbours. Equal vectors are one row with a weight. A cell with very many vectors is cut
into chunks, and so are those that visit it; pairs of chunks are dealt to tasks of their own.
A task passes on counts and a star for each component it has found, no pairs. A link
counts at both ends: the asking end counts it where it asks; if the other end does
not visit the cell of the asking one, and so will not ask itself, it is counted there too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored
from plumbline.llm.components import connected_components, local_roots

SAMPLE = 20_000  # vectors for the codebooks, the first by a hash of their ids
CALIBRATED = 4_000  # of these, for the recall
VECTORS_PER_CELL = 64  # in the mean
LARGEST_CODEBOOK = 4096  # enough for a thousand million different vectors of a label
SLICE = 256  # rows whose distances are computed at a time
CHUNK = 2048
ROUNDS = 10
SEED = 17


def squared_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1), 0)


def same_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances that are the same to the last bit whatever other rows are there."""
    out = np.empty((len(rows), len(centres)))
    for r in range(0, len(rows), SLICE):
        for c in range(0, len(centres), SLICE):
            apart = rows[r: r + SLICE, None, :] - centres[None, c: c + SLICE, :]
            out[r: r + SLICE, c: c + SLICE] = np.einsum("ijk,ijk->ij", apart, apart)
    return out


def nearest_centres(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared_distances(rows[i: i + SLICE], centres).argmin(1) for i in range(0, len(rows), SLICE)])


def fit_codebook(rows: np.ndarray, size: int) -> np.ndarray:
    """k-means centres."""
    random = np.random.default_rng(SEED)
    size = max(1, min(size, len(rows)))
    centres = rows[random.choice(len(rows), size, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = nearest_centres(rows, centres)
        count = np.bincount(nearest, minlength=size)
        for d in range(rows.shape[1]):
            total = np.bincount(nearest, weights=rows[:, d], minlength=size)
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


class MultiIndex:
    """Two codebooks and the distance up to which cells are visited."""

    def __init__(self, sample: np.ndarray, size: int, similarity: float, recall: float):
        self.half = sample.shape[1] // 2
        self.books = [fit_codebook(sample[:, : self.half], size), fit_codebook(sample[:, self.half:], size)]
        self.limit = 0.0
        own = sample[:CALIBRATED]
        random = np.random.default_rng(SEED)
        side = random.normal(size=own.shape)
        side -= (side * own).sum(1)[:, None] * own
        side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
        needed = [self._needed(own, similarity * own + np.sqrt(max(0.0, 1 - similarity**2)) * side)]
        # Real neighbours inside the sample count beside made-up ones.
        for first in range(0, len(own), 500):
            a, b = np.nonzero(own[first: first + 500] @ own.T >= similarity)
            needed.append(self._needed(own[a + first], own[b]))
        self.limit = max((float(np.quantile(n, recall)) for n in needed if len(n)), default=0.0)

    def costs(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each half the squared way to the border of every code's region; zero for the own code."""
        out = []
        for part, book in zip((rows[:, : self.half], rows[:, self.half:]), self.books):
            square = same_distances(part, book)
            own = square.argmin(1)
            nearest = square[np.arange(len(rows)), own][:, None]
            used, at = np.unique(own, return_inverse=True)
            gaps = np.sqrt(np.maximum(same_distances(book[used], book), 1e-12))
            way = np.maximum(square - nearest, 0) / (2 * gaps[at])
            way[np.arange(len(rows)), own] = 0
            out.append(way**2)
        return out

    def cells(self, rows: np.ndarray) -> np.ndarray:
        codes = [same_distances(p, b).argmin(1) for p, b in zip((rows[:, : self.half], rows[:, self.half:]), self.books)]
        return codes[0] * len(self.books[1]) + codes[1]

    def _needed(self, rows: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
        if len(rows) == 0:
            return np.empty(0)
        first, second = self.costs(rows)
        cell = self.cells(neighbours)
        at = np.arange(len(rows))
        return first[at, cell // len(self.books[1])] + second[at, cell % len(self.books[1])]

    def visited(self, rows: np.ndarray, cells: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether row i visits cell j, for each pair (i, j)."""
        first, second = self.costs(rows)
        i, cell = pairs[0], cells[pairs[1]]
        return first[i, cell // len(self.books[1])] + second[i, cell % len(self.books[1])] <= self.limit

    def visits(self, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, cell) for every cell a row visits, nearest first."""
        width = len(self.books[1])
        first, second = self.costs(rows)
        orders = first.argsort(1, kind="stable"), second.argsort(1, kind="stable")
        for r in range(len(rows)):
            i_codes, j_codes = orders[0][r].tolist(), orders[1][r].tolist()
            i_cost, j_cost = first[r][orders[0][r]].tolist(), second[r][orders[1][r]].tolist()
            heap, seen = [(i_cost[0] + j_cost[0], 0, 0)], {(0, 0)}
            while heap:
                cost, i, j = heapq.heappop(heap)
                if cost > self.limit:
                    break
                yield r, i_codes[i] * width + j_codes[j]
                for a, b in ((i + 1, j), (i, j + 1)):
                    if a < len(i_codes) and b < len(j_codes) and (a, b) not in seen:
                        seen.add((a, b))
                        heapq.heappush(heap, (i_cost[a] + j_cost[b], a, b))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, one per row, in double precision; all rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _compared(index: MultiIndex, similarity: float):
    def compare(table: pa.Table) -> pa.Table:
        """Counts and stars of one pair of chunks."""
        table = table.combine_chunks()
        seeks = table.column("seeks").to_numpy(zero_copy_only=False)
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float64).reshape(len(table), -1)
        asking, held = np.flatnonzero(seeks), np.flatnonzero(~seeks)
        near = vectors[asking] @ vectors[held].T >= similarity
        near &= node[asking][:, None] != node[held][None, :]
        counts = near @ weight[held]
        a, b = np.nonzero(near)
        back = np.zeros(len(held), dtype=np.int64)
        if len(a):
            alone = ~index.visited(vectors[held], index.cells(vectors[asking]), (b, a))
            np.add.at(back, b[alone], weight[asking[a[alone]]])
        names, place = np.unique(node, return_inverse=True)
        root = local_roots(len(names), place[asking[a]], place[held[b]])
        linked = np.flatnonzero(root != np.arange(len(names)))
        some, other = np.flatnonzero(counts), np.flatnonzero(back)
        ends = np.concatenate([node[asking[some]], node[held[other]]])
        return pa.table({
            "node": np.concatenate([ends, names[linked]]),
            "root": pa.array(np.concatenate([ends, names[root[linked]]])),
            "links": np.concatenate([counts[some], back[other], np.zeros(len(linked), dtype=np.int64)]).astype(np.int64),
        })

    return compare


def near_vector_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    similarity: float = 0.98, target_recall: float = 0.9999,
) -> DataFrame:
    """One row per input row: its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels are equal and not null, their lengths are equal
    and their cosine is at least ``similarity``. A vector that is null, empty, zero or holds a
    null or non-finite component, a row without a label and a row without an id
    link with nothing and are components of their own (of a null id, if it is
    null). ``n_links`` counts other rows, copies included. Rows that share an id are one
    node of the components. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        col(id_col).cast("long").alias("node"), col(label_col).cast("string").alias("label"),
        col(vector_col).cast("array<double>").alias("vector"),
    )
    usable = F.coalesce(
        F.col("node").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("usable", usable)
    # Equal vectors of a label are one node with a weight, named by their smallest id.
    classes = stored(
        rows.filter("usable").groupBy("label", "vector").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("weight"))
        .withColumn("length", F.size("vector"))
    )
    shapes = classes.groupBy("length").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("label").alias("labels")).collect()
    found = [_found(classes.filter(F.col("length") == s["length"]), s["rows"], s["labels"], similarity, target_recall) for s in shapes]
    if not found:
        none = spark.createDataFrame([], "node long, root long, links long")
        found = [none]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = stored(links)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(links.select("node", "root").distinct(), "node", "root")
    named = (
        classes.join(counts, "node", "left").join(components, "node", "left")
        .select(
            "label", "vector",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = rows.filter("usable").join(named, ["label", "vector"]).select("node", "n_links", "component_id")
    alone = rows.filter(~F.col("usable")).select("node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("node").alias(id_col), "n_links", "component_id", F.coalesce(F.col("node") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def _found(classes: DataFrame, rows: int, labels: int, similarity: float, recall: float) -> DataFrame:
    """(node, root, links): counts of links, and stars, of vectors of one length."""
    sample = classes.select("node", "vector").orderBy(F.xxhash64("node")).limit(SAMPLE).toArrow()
    size = int(min(LARGEST_CODEBOOK, max(1, round((rows / max(labels, 1) / VECTORS_PER_CELL) ** 0.5))))
    index = MultiIndex(_matrix(sample.column("vector").combine_chunks()), size, similarity, recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                unit = _matrix(part.column("vector"))
                pairs = np.array([(r, c) for r, c in index.visits(unit)], dtype=np.int64).reshape(-1, 2)
                held = index.cells(unit)
                row = np.concatenate([np.arange(len(unit)), pairs[:, 0]])
                bytes_ = [v.tobytes() for v in unit]
                yield pa.RecordBatch.from_arrays([
                    part.column("label").take(pa.array(row)), pa.array(np.concatenate([held, pairs[:, 1]])),
                    pa.array(row < 0) if len(row) == 0 else pa.array(np.arange(len(row)) >= len(unit)),
                    part.column("node").take(pa.array(row)), part.column("weight").take(pa.array(row)),
                    pa.array([bytes_[r] for r in row], type=pa.binary()),
                ], ["label", "cell", "seeks", "node", "weight", "vector"])

    placed = classes.select("label", "node", "weight", "vector").mapInArrow(
        visit, "label string, cell long, seeks boolean, node long, weight long, vector binary"
    )
    placed = stored(placed)
    sizes = placed.groupBy("label", "cell").agg(
        F.ceil(F.count(F.when(~F.col("seeks"), 1)) / CHUNK).cast("int").alias("held_chunks"),
        F.ceil(F.count(F.when(F.col("seeks"), 1)) / CHUNK).cast("int").alias("seek_chunks"),
    ).filter("held_chunks > 0")
    # A row has its own chunk on its side and meets all chunks of the other side.
    own = F.expr("cast(pmod(xxhash64(node), if(seeks, seek_chunks, held_chunks)) as int)")
    spread = (
        placed.join(sizes, ["label", "cell"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, greatest(if(seeks, held_chunks, seek_chunks), 1) - 1)")))
        .select(
            "label", "cell", F.expr("if(seeks, own, other)").alias("seek_chunk"), F.expr("if(seeks, other, own)").alias("held_chunk"),
            "seeks", "node", "weight", "vector",
        )
        # Dealt by all four, as otherwise the join's exchange by cell would do for the groups.
        .repartition("label", "cell", "seek_chunk", "held_chunk")
    )
    return spread.groupBy("label", "cell", "seek_chunk", "held_chunk").applyInArrow(_compared(index, similarity), "node long, root long, links long")
