"""k-means for several numbers of clusters at once.

One pass over the rows moves the centres of all k together: a task adds up, for every centre of every k, the rows that are
nearest to it, and Spark adds the tasks' sums, a row per centre. Seeds come from k-means||: in a few passes rows are drawn by their
squared distance from those drawn before (each task keeps its best by weighted random keys, so no pass for the total
is needed), the rows around each drawn one become one weighted point, and k-means++ with restarts on these few points gives the
centres to start from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

# Rows drawn in a pass for each cluster of the largest k, passes that draw, restarts on the drawn points.
OVERSAMPLING, DRAWS, RESTARTS = 2, 4, 20
STEPS, LOCAL_STEPS = 25, 100  # passes over the rows, and over the drawn points, at most
# Rows whose distances from all centres are found at once, so that they stay in the processor's cache.
BLOCK_ROWS = 1 << 10
MOVED = 1e-4  # squared way of all centres of a k together, in units of the columns' variance, below which they stand still


def packed(points: DataFrame) -> DataFrame:
    """(x, size): the rows of a batch as one array, column after column, so that passes do not hand on single values; ``size`` values in all.

    ``points`` holds columns of doubles without nulls.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                yield pa.RecordBatch.from_pydict({"x": [pa.compress(x.tobytes(), "lz4", asbytes=True)], "size": [x.size]})

    return points.mapInArrow(pack, "x binary, size long")


def _blocks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[np.ndarray]:
    """Some rows at a time, each a column of an array."""
    for batch in batches:
        for held, size in zip(batch.column("x"), batch.column("size").to_pylist()):
            x = np.frombuffer(pa.decompress(held.as_buffer(), 8 * size, "lz4")).reshape(columns, -1)
            for at in range(0, x.shape[1], BLOCK_ROWS):
                yield x[:, at:at + BLOCK_ROWS]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, each the same whatever other rows and centres there are."""
    out = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        out += (x[:, d, None] - centres[None, :, d]) ** 2
    return out


def _scores(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of the rows (columns of ``x``) from the centres, less the squares of the rows."""
    scores = (-2 * centres) @ x
    scores += (centres * centres).sum(1)[:, None]
    return scores


def _sums(arrays: DataFrame, centres: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centres the rows, their sums and the cost, by nearest centre. One pass."""
    ends = np.cumsum([0, *map(len, centres)])
    every = np.vstack(centres)
    names = [f"s{i}" for i in range(every.shape[1])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, cost = np.zeros(len(every), dtype=np.int64), np.zeros(every.shape), np.zeros(len(every))
        for x in _blocks(batches, every.shape[1]):
            away, least = _scores(x, every), np.empty((len(centres), x.shape[1]))
            hits = np.empty(away.shape, dtype=bool)
            for a, b, nearest in zip(ends, ends[1:], least):
                away[a:b].min(0, out=nearest)
                np.equal(away[a:b], nearest, out=hits[a:b])
            if np.count_nonzero(hits) > least.size:
                for a, b in zip(ends, ends[1:]):  # of equally near centres the first
                    hits[a:b] &= np.cumsum(hits[a:b], axis=0) == 1
            added = hits.astype(np.float64) @ np.vstack([x, np.ones(x.shape[1])]).T
            total += added[:, :-1]
            count += added[:, -1].astype(np.int64)
            least += (x * x).sum(0)
            cost[ends[:-1]] += np.maximum(least, 0, out=least).sum(1)
        some = np.flatnonzero((count > 0) | (cost > 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(count[some]), pa.array(cost[some]), *[pa.array(total[some, d]) for d in range(total.shape[1])]],
            ["slot", "n", "cost", *names],
        )

    sums = ["n", "cost", *names]
    schema = "slot long, n long, " + ", ".join(f"{s} double" for s in sums[1:])
    table = arrays.mapInArrow(work, schema).groupBy("slot").agg(*[F.sum(s).alias(s) for s in sums]).toArrow()
    slot = table.column("slot").to_numpy()
    count, cost, total = np.zeros(len(every)), np.zeros(len(every)), np.zeros(every.shape)
    count[slot], cost[slot] = table.column("n").to_numpy(), table.column("cost").to_numpy()
    for d, name in enumerate(names):
        total[slot, d] = table.column(name).to_numpy()
    return [(count[a:b], total[a:b], float(cost[a:b].sum())) for a, b in zip(ends, ends[1:])]


def _away(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row (column of ``x``) from the nearest centre; nothing for a row that is one."""
    scores = _scores(x, centres)
    away = ((x - centres.take(scores.argmin(0), axis=0).T) ** 2).sum(0)
    # Where rounding may have chosen another centre than the nearest, all are compared.
    close = np.flatnonzero(away <= 1e-6 * (1 + (x * x).sum(0)))
    if len(close):
        away[close] = _distances(x[:, close].T, centres).min(1)
    return away


def _drawn(arrays: DataFrame, seeds: np.ndarray, wanted: int, seed: int) -> np.ndarray:
    """Rows drawn by their squared distance from the seeds. A task keeps as many as are wanted in all."""
    names = [f"s{i}" for i in range(seeds.shape[1])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        keys, rows = np.empty(0), np.empty((0, len(names)))
        for x in _blocks(batches, len(names)):
            away = _away(x, seeds)
            # The largest of u^(1 / weight) are a weighted sample; by logarithms.
            key = np.where(away > 0, np.log(rng.random(len(away))) / np.maximum(away, 1e-300), -np.inf)
            if len(keys) == wanted:
                better = np.flatnonzero(key > keys[-1])
                key, x = key[better], x[:, better]
            keys, rows = np.concatenate([keys, key]), np.vstack([rows, x.T])
            best = np.argsort(-keys, kind="stable")[:wanted]
            keys, rows = keys[best], rows[best]
        good = np.flatnonzero(np.isfinite(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys[good]), *[pa.array(rows[good, d]) for d in range(len(names))]], ["key", *names])

    schema = "key double, " + ", ".join(f"{n} double" for n in names)
    table = arrays.mapInArrow(work, schema).orderBy(F.desc("key")).limit(wanted).drop("key").toArrow()
    return np.column_stack([table.column(n).to_numpy() for n in names])


def _local(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of a few weighted points: the best of several k-means++ runs."""
    best, least = None, np.inf
    for _ in range(RESTARTS):
        centres = x[[rng.choice(len(x), p=weight / weight.sum())]]
        while len(centres) < k:
            chance = weight * _distances(x, centres).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=chance / chance.sum())] if chance.sum() > 0 else centres[0]])
        for _ in range(LOCAL_STEPS):
            nearest = _distances(x, centres).argmin(1)
            mass = np.bincount(nearest, weights=weight, minlength=k)
            moved = np.column_stack([np.bincount(nearest, weights=weight * x[:, d], minlength=k) for d in range(x.shape[1])])
            moved = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
            still = ((moved - centres) ** 2).sum() < MOVED
            centres = moved
            if still:
                break
        cost = float((weight * _distances(x, centres).min(1)).sum())
        if cost < least * (1 - 1e-12):
            best, least = centres, cost
    return best


def fit(arrays: DataFrame, columns: int, ks: Sequence[int], seed: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """k -> (centres, rows of each, sum of squared distances); ``arrays`` are those of ``packed`` and are read some dozen times.

    Centres are in the order of their coordinates. If the rows have fewer different values than k, some centres repeat and have no rows.
    """
    rng = np.random.default_rng(seed)
    seeds = next(_blocks(iter(arrays.limit(1).toArrow().to_batches()), columns))[:, :1].T
    wanted = OVERSAMPLING * max(ks)
    for draw in range(DRAWS):
        more = _drawn(arrays, seeds, wanted, seed + draw)
        if len(more) == 0:
            break
        seeds = np.unique(np.vstack([seeds, more]), axis=0)
    ((weight, total, _),) = _sums(arrays, [seeds])
    some = weight > 0
    centres = {k: _local(total[some] / weight[some][:, None], weight[some], k, rng) for k in ks}
    found: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    for _ in range(STEPS):
        moving = [k for k in ks if k not in found]
        if not moving:
            break
        for k, (count, total, cost) in zip(moving, _sums(arrays, [centres[k] for k in moving])):
            moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres[k])
            if ((moved - centres[k]) ** 2).sum() < MOVED:
                found[k] = (centres[k], count, cost)
            centres[k] = moved
    late = [k for k in ks if k not in found]
    if late:
        for k, (count, _, cost) in zip(late, _sums(arrays, [centres[k] for k in late])):
            found[k] = (centres[k], count, cost)
    ordered = {}
    for k in ks:
        own, count, cost = found[k]
        order = np.lexsort(np.round(own, 9).T[::-1])
        ordered[k] = (own[order], count[order], cost)
    return ordered
