"""Importance of columns by a forest of regression trees that grow to the end.

Each tree sees every row as often as a Poisson draw says, which is what drawing rows with replacement comes to
on many rows. Rows that agree in all columns stay together in every tree, so a chunk of rows hands them on as one. A node with
more rows than a task should hold is split by Spark: the chunks add up sums by column and interval, the cut with the largest
decrease of variance counts. As soon as a node has few enough rows, they are dealt to one task as packed arrays, which grows the rest of
the tree from all their values and returns only what each column has contributed. The driver sees the splits of large nodes alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.storage import stored

# Rows of a node that one task grows to the end.
TASK_ROWS = 1_000_000
# Cuts tried in a node with more rows than that, at least: quantiles, and the smallest value, so that two values always fall apart.
CUTS = 63
# Rows whose draws are made at once.
CHUNK_ROWS = 1 << 19
HASHED_ROWS = 1 << 15
# Rows of nodes that are handled together, so that their arrays stay in the processor's cache.
BLOCK_ROWS = 1 << 16
# Nodes of a tree with more rows than this are split one by one, from sums by value.
LARGE_ROWS = 1 << 10
# Of the others, nodes of more rows than this grow first, then those of more rows than the next number.
FLOORS = (1 << 8,)
# Columns with so many times more rows in a node than values are added up by value, not sorted.
FEW_VALUES = 4

EQUAL = 1e-9  # relative difference of scores that counts as none

# The chances of at most 0, 1, 2, ... draws of a row (Poisson, mean 1), as parts of UNIT.
UNIT = 1 << 53
DRAWS = np.array([math.ceil(float(c) * UNIT) for c in np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 13)]))], dtype=np.uint64)
# The odd factors of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(v: np.ndarray, bits: int) -> np.ndarray:
    return (v << np.uint64(bits)) | (v >> np.uint64(64 - bits))


def _rows_hashed(row: np.ndarray) -> np.ndarray:
    """The part of a row's hash that is the same for all trees."""
    return _turned(row.astype(np.int64).view(np.uint64) * P2, 31) * P1


def _weights(tree_hash: int, hashed: np.ndarray) -> np.ndarray:
    """How often a tree sees each row: a number drawn by ``xxhash64`` of seed, tree and row."""
    if len(hashed) > HASHED_ROWS:
        return np.concatenate([_weights(tree_hash, hashed[i:i + HASHED_ROWS]) for i in range(0, len(hashed), HASHED_ROWS)])
    start = np.array([tree_hash], dtype=np.int64).view(np.uint64) + P5 + np.uint64(8)
    h = _turned(hashed ^ start, 27) * P1 + P4
    for shift, factor in ((33, P2), (29, P3)):
        h ^= h >> np.uint64(shift)
        h *= factor
    h ^= h >> np.uint64(32)
    h &= np.uint64(UNIT - 1)
    out = np.zeros(len(h), dtype=np.uint8)
    for least in DRAWS:
        out += h >= least
    return out


def _alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The first row of each group of rows with equal columns, and every row's group; None if few rows are equal."""
    h = np.zeros(x.shape[1], dtype=np.uint64)
    for column in x:
        h = (h ^ (column + 0.0).view(np.uint64)) * P1
        h ^= h >> np.uint64(32)
    # Sorting alone is much faster than finding the groups.
    ordered = np.sort(h)
    if 1 + np.count_nonzero(ordered[1:] != ordered[:-1]) > 0.7 * len(h):
        return None
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    if not all(np.array_equal(column[first][group], column) for column in x):
        return None
    return first, group


@dataclass
class Large:
    """A node that is split alone: its rows, and for each column the sums of their weights and weighted targets by value.

    Values are known by numbers, of which ``first`` is the one of a column's first sums. Targets count from ``base``.
    """

    rows: np.ndarray
    first: list[int]
    weights: list[np.ndarray]
    sums: list[np.ndarray]
    base: float


@dataclass
class Nodes:
    """Nodes of a tree that are split at once. The rows themselves stay where they are; ``ranked`` lists them node after node.

    ``x`` holds ranks of values, ``sums`` each row's weight as real and its weighted target as imaginary part, ``ranked`` the rows by
    column inside their nodes: a line for the column ``lead``, then one for each of ``columns``, which are those of many values. ``base`` is
    the mean target of the node above, ``values`` the number of values of each column, ``spread`` the largest square of a target.
    """

    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    ranked: np.ndarray
    columns: list[int]
    sizes: np.ndarray
    base: np.ndarray
    lead: int
    values: np.ndarray
    spread: float

    @property
    def orders(self) -> list[np.ndarray | None]:
        """The rows by column; None for ``lead`` and for columns of few values."""
        return [self.ranked[1 + self.columns.index(c)] if c in self.columns else None for c in range(len(self.x))]

    def part(self, kinds: tuple[int, int], by_column: list[np.ndarray], sizes: np.ndarray, base: np.ndarray) -> Nodes:
        """The children of two kinds, first all of the one, then all of the other."""
        ranked = np.empty((len(self.ranked), sizes.sum()), dtype=np.int64)
        for line, order, own in zip(ranked, self.ranked, by_column if len(sizes) else ()):
            first = order.compress(own == kinds[0])
            line[:len(first)] = first
            line[len(first):] = order.compress(own == kinds[1])
        return replace(self, ranked=ranked, sizes=sizes, base=base)

    def moved(self) -> Nodes:
        """The same nodes with their rows side by side, without those of other nodes."""
        rows = self.ranked[0]
        at = np.empty(len(self.sums), dtype=np.int64)
        at[rows] = np.arange(len(rows))
        low = self.low.take(rows)
        return replace(
            self, x=self.x.take(rows, axis=1), low=low, high=low if self.high is self.low else self.high.take(rows),
            sums=self.sums.take(rows), ranked=at.take(self.ranked))


def _joined(parts: list[Nodes]) -> Nodes:
    begin = np.cumsum([0] + [len(p.sums) for p in parts])
    low = np.concatenate([p.low for p in parts])
    return replace(
        parts[0], x=np.concatenate([p.x for p in parts], axis=1), low=low,
        high=low if all(p.high is p.low for p in parts) else np.concatenate([p.high for p in parts]), sums=np.concatenate([p.sums for p in parts]),
        ranked=np.concatenate([p.ranked + at for p, at in zip(parts, begin)], axis=1),
        sizes=np.concatenate([p.sizes for p in parts]), base=np.concatenate([p.base for p in parts]))


def _ordered(nodes: Nodes, least: int) -> Nodes:
    """The same nodes, whose rows stand side by side, with the order of all columns whose values are not few in a node of more than ``least`` rows."""
    n = len(nodes.sums)
    bits = np.int64(n.bit_length())
    node, row = np.repeat(np.arange(len(nodes.sizes)), nodes.sizes), np.arange(n)
    more = [c for c, k in enumerate(nodes.values) if c not in nodes.columns and c != nodes.lead and k * FEW_VALUES > least]
    lines = [np.sort(((node * nodes.values[c] + nodes.x[c]) << bits) | row) & ((1 << bits) - 1) for c in more]
    return replace(nodes, ranked=np.stack([*nodes.ranked, *lines]), columns=nodes.columns + more)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all rows of some nodes."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1])


def _level(nodes: Nodes, gains: np.ndarray, least: int) -> tuple[Nodes, Nodes]:
    """Split every node once and add up what that brings; the children of more than ``least`` rows and the others that may be split."""
    x, sums, sizes, orders, rows = nodes.x, nodes.sums, nodes.sizes, nodes.orders, nodes.ranked[0]
    orders[nodes.lead] = rows
    n, starts = len(rows), np.cumsum(sizes) - sizes
    ends = starts + sizes - 1
    led = sums.take(rows)
    totals = np.add.reduceat(led, starts)
    total_w, mean = totals.real.copy(), totals.imag / totals.real
    # Targets count from the mean of their node: then the sums of a node end at nothing, and its cuts differ by what they bring alone.
    led.imag -= led.real * np.repeat(mean, sizes)
    sums[rows] = led
    base = nodes.base + mean
    noise = EQUAL * base * base
    best, chosen, cut = np.full(len(sizes), -1.0), np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=x.dtype)
    every_w = np.repeat(total_w, sizes)
    few = np.array([order is None for order in orders])
    if few.any():
        node, parts, codes = np.repeat(np.arange(len(sizes)), sizes), (led.real.copy(), led.imag.copy()), {}
    scores = np.empty(nodes.ranked.shape)
    line_of = np.zeros(len(orders), dtype=np.int64)
    line_of[nodes.columns] = np.arange(1, len(scores))
    rest = np.empty(n)

    def beaten(top: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes with their best cut in this column, and the score that counts as best in them; of equal columns the first."""
        better = np.flatnonzero((top >= 0) & (top > best + np.where(best >= 0, best * EQUAL + noise, 0)))
        best[better], chosen[better] = top[better], c
        return better, np.maximum(top[better] * (1 - EQUAL) - noise[better], 0)

    for c, order in enumerate(orders):
        if few[c]:
            k = nodes.values[c]
            codes[c] = x[c].take(rows)
            key = node * k + codes[c]
            w, s = (np.bincount(key, v, len(sizes) * k).reshape(-1, k) for v in parts)
            upto_w, upto = np.cumsum(w, axis=1), np.cumsum(s, axis=1)
            over = (total_w[:, None] - upto_w) * upto_w
            never = (w == 0) | (over <= 0)
            score = np.where(never, -1.0, upto * upto / np.where(never, 1.0, over))
            better, enough = beaten(score.max(axis=1), c)
            cut[better] = np.argmax(score[better] >= enough[:, None], axis=1)
            continue
        value, run, score = x[c].take(order), led if c == nodes.lead and c == len(orders) - 1 else sums.take(order), scores[line_of[c]]
        run.real[starts[1:]] -= total_w[:-1]  # the weights begin anew in every node
        np.cumsum(run, out=run)
        np.multiply(run.imag, run.imag, out=score)
        np.subtract(every_w, run.real, out=rest)
        rest *= run.real
        rest[ends] = 1.0
        score /= rest
        score[np.flatnonzero(value[:-1] == value[1:])] = -1.0
        score[ends] = -1.0  # behind the last row of a node there is no cut
        beaten(np.maximum.reduceat(score, starts), c)
    # A node of one target is a leaf; the smallest scores may be the rounding of one.
    doubt = np.flatnonzero((best >= 0) & (best <= noise + EQUAL * nodes.spread))
    if len(doubt):
        own, begin = rows.take(_places(starts[doubt], sizes[doubt])), np.cumsum(sizes[doubt]) - sizes[doubt]
        best[doubt[np.minimum.reduceat(nodes.low.take(own), begin) >= np.maximum.reduceat(nodes.high.take(own), begin)]] = -1.0
    split = best >= 0
    gains += np.bincount(chosen[split], best[split] * total_w[split], minlength=len(x))
    # Rows behind the first of equal cuts go to the right.
    place, last, by_order = np.arange(n), ends.copy(), np.flatnonzero(split & ~few[chosen])
    spot = place if len(scores) == 1 else place + np.repeat(line_of[chosen] * n, sizes)
    enough = np.full(len(sizes), np.inf)
    enough[by_order] = np.maximum(best[by_order] * (1 - EQUAL) - noise[by_order], 0)
    hit = np.flatnonzero(scores.ravel().take(spot) >= np.repeat(enough, sizes))
    last[by_order] = hit[np.searchsorted(hit, starts[by_order])]
    to_right, right = place > np.repeat(last, sizes), ends - last
    for c in np.unique(chosen[split & few[chosen]]):
        mine = np.flatnonzero(split & (chosen == c))
        places = _places(starts[mine], sizes[mine])
        to_right[places] = above = codes[c].take(places) > np.repeat(cut[mine], sizes[mine])
        right[mine] = np.add.reduceat(above, np.cumsum(sizes[mine]) - sizes[mine], dtype=np.int64)
    sides = np.stack([np.where(split, sizes - right, 0), right])
    # A single row is a leaf.
    kind = (np.where(sides > least, 0, np.where(sides > 1, 2, 4)) + np.arange(2)[:, None]).astype(np.uint8)
    of_row = np.empty(len(sums), dtype=np.uint8)
    of_row[nodes.ranked.ravel().take(spot)] = np.repeat(kind[0], sizes) + to_right * np.repeat(kind[1] - kind[0], sizes)
    by_column = [of_row.take(order) for order in nodes.ranked]
    children = []
    for first in (0, 2):
        mine = [np.flatnonzero(kind[k] == first + k) for k in (0, 1)]
        children.append(nodes.part(
            (first, first + 1), by_column, np.concatenate([sides[k][i] for k, i in enumerate(mine)]), np.concatenate([base[i] for i in mine])))
    return children[0], children[1].moved()


def _best_cut(node: Large, noise: float) -> tuple[float, int, int]:
    """The score of the best cut of a node, its column and the number of the last value to the left; of equal cuts the first. -1 without any."""
    best, chosen, last = -1.0, 0, 0
    for c, (w, s) in enumerate(zip(node.weights, node.sums)):
        upto = np.cumsum(w)
        # Values without rows at either end are no cuts.
        begin, end = np.searchsorted(upto, 0.0, side="right"), np.searchsorted(upto, upto[-1])
        if begin >= end:
            continue
        over = upto[-1] - upto[begin:end]
        over *= upto[begin:end]
        score = np.cumsum(s)[begin:end]
        score *= score
        score /= over
        top = float(score.max())
        if top > best + (best * EQUAL + noise if best >= 0 else 0):
            best, chosen, last = top, c, node.first[c] + int(begin) + int(np.argmax(score >= max(top * (1 - EQUAL) - noise, 0)))
    return best, chosen, last


def _large_ends(
    ranks: np.ndarray, sums: np.ndarray, low: np.ndarray, high: np.ndarray, values: np.ndarray, spread: float, gains: np.ndarray,
) -> Iterator[tuple[np.ndarray, float]]:
    """Split nodes of more than LARGE_ROWS rows one by one; the rows of each smaller one that may be split, and the mean above it.

    The larger child keeps the sums of its parent, from which those of the other child's rows are taken; only the smaller child adds
    its rows up anew. A cut that takes few rows off thus costs a pass over sums by value, not over sorted rows.
    """
    numbers = ranks.copy()  # of each row's value by column
    weight, target = sums.real.copy(), sums.imag.copy()

    def added(rows: np.ndarray, first: list[int], counts: list[int], base: float) -> Large:
        w = weight.take(rows)
        s = target.take(rows) - w * base
        node = Large(rows, list(first), [], [], base)
        for c, k in enumerate(counts):
            own = numbers[c].take(rows)
            if k > 4 * len(rows):
                found, own = np.unique(own, return_inverse=True)
                numbers[c][rows], node.first[c], k = own, 0, len(found)
            else:
                own = own - first[c]
            node.weights.append(np.bincount(own, w, k))
            node.sums.append(np.bincount(own, s, k))
        return node

    waiting = [added(np.arange(len(weight)), [0] * len(ranks), values.tolist(), 0.0)]
    while waiting:
        node = waiting.pop()
        rows = node.rows
        for c, w in enumerate(node.weights):
            # Values that have lost their rows are left out when they have become many.
            if 4 * len(w) > 5 * len(rows):
                used = w > 0
                numbers[c][rows] = (np.cumsum(used) - 1).take(numbers[c].take(rows) - node.first[c])
                node.first[c], node.weights[c], node.sums[c] = 0, w[used], node.sums[c][used]
        total = node.weights[0].sum()
        mean = node.sums[0].sum() / total
        # Targets count from the mean of their node, as below.
        for w, s in zip(node.weights, node.sums):
            s -= mean * w
        base = node.base + mean
        noise = EQUAL * base * base
        best, chosen, last = _best_cut(node, noise)
        if best < 0 or best <= noise + EQUAL * spread and low.take(rows).min() >= high.take(rows).max():
            continue
        gains[chosen] += best * total
        to_left = numbers[chosen].take(rows) <= last
        sides = [rows.compress(to_left), rows.compress(~to_left)]
        few = int(len(sides[1]) <= len(sides[0]))
        ends = [(0, last + 1 - node.first[chosen]), (last + 1 - node.first[chosen], len(node.weights[chosen]))]
        smaller, larger = sides[few], sides[1 - few]
        if len(smaller) > LARGE_ROWS:
            first, counts = list(node.first), [len(w) for w in node.weights]
            first[chosen], counts[chosen] = first[chosen] + ends[few][0], ends[few][1] - ends[few][0]
        if len(larger) > LARGE_ROWS:
            w = weight.take(smaller)
            s = target.take(smaller) - w * base
            for c in range(len(ranks)):
                if c != chosen:
                    own = numbers[c].take(smaller) - node.first[c]
                    np.subtract.at(node.weights[c], own, w)
                    np.subtract.at(node.sums[c], own, s)
            begin, end = ends[1 - few]
            node.rows, node.base = larger, base
            node.first[chosen] += begin
            node.weights[chosen], node.sums[chosen] = node.weights[chosen][begin:end], node.sums[chosen][begin:end]
            waiting.append(node)
        if len(smaller) > LARGE_ROWS:
            waiting.append(added(smaller, first, counts, base))
        for side in sides:
            if 1 < len(side) <= LARGE_ROWS:
                yield side, base


def _grow(nodes: Nodes, gains: np.ndarray, floors: list[int], held: list[list[Nodes]]) -> None:
    """Grow nodes to the end: those of more than the first floor's rows level by level, smaller ones together from the next floor on."""
    while len(nodes.sizes):
        nodes, small = _level(nodes, gains, floors[0])
        if len(small.sizes):
            held[0].append(small)
        if held and sum(len(p.sums) for p in held[0]) >= BLOCK_ROWS:
            _release(gains, floors, held)


def _release(gains: np.ndarray, floors: list[int], held: list[list[Nodes]]) -> None:
    """Grow the small nodes that have been held back."""
    if held and held[0]:
        nodes = _joined(held[0])
        held[0].clear()
        _grow(_ordered(nodes, floors[1]), gains, floors[1:], held[1:])


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Decrease of the squared error that each column (row of ``x``) brings when a tree is grown until no leaf can be split.

    Nodes of many rows are split one by one, all others of a level at once: every column keeps its rows sorted inside their nodes, but for
    columns of few values, which are added up by value while nodes are large. A row may stand for
    several with equal columns: ``y`` is their mean then, ``low`` and ``high`` are the ends of its range. Weights are whole numbers.
    """
    columns, n = x.shape
    gains = np.zeros(columns)
    if n == 0 or columns == 0:
        return gains
    ranks = np.empty((columns, n), dtype=np.int32)
    for c in range(columns):
        order = np.argsort(x[c])
        value = x[c][order]
        ranks[c][order] = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
    values = ranks.max(axis=1).astype(np.int64) + 1
    lead = int(np.argmax(values))
    centred = y - np.average(y, weights=w)
    sums, spread = w + 1j * (w * centred), float(np.max(centred * centred))
    low = y if low is None else low
    high = low if high is None else high

    def side_by_side(parts: list[tuple[np.ndarray, float]]) -> Nodes:
        """Nodes, each given by its rows and the mean above it."""
        sizes, base = np.array([len(rows) for rows, _ in parts]), np.array([mean for _, mean in parts])
        rows = np.concatenate([rows for rows, _ in parts])
        bits = np.int64(len(rows).bit_length())
        key = np.repeat(np.arange(len(sizes)), sizes) * values[lead] + ranks[lead].take(rows)
        rows = rows.take(np.sort((key << bits) | np.arange(len(rows))) & ((1 << bits) - 1))
        own, lows = sums.take(rows), low.take(rows)
        own.imag -= own.real * np.repeat(base, sizes)
        return Nodes(
            ranks.take(rows, axis=1), lows, lows if high is low else high.take(rows), own, np.arange(len(rows))[None, :], [], sizes, base, lead,
            values, spread)

    least = min(n, LARGE_ROWS)
    floors = [least] + [floor for floor in FLOORS if floor < least] + [1]
    held: list[list[Nodes]] = [[] for _ in floors[1:]]
    parts: list[tuple[np.ndarray, float]] = []
    size = 0
    for part in _large_ends(ranks, sums, low, high, values, spread, gains) if n > LARGE_ROWS else [(np.arange(n), 0.0)]:
        parts.append(part)
        size += len(part[0])
        if size >= BLOCK_ROWS:
            held[0].append(side_by_side(parts))
            parts, size = [], 0
            _release(gains, floors, held)
    if parts:
        held[0].append(side_by_side(parts))
    for k in range(len(held)):
        _release(gains, floors[k:], held[k:])
    return gains


@dataclass
class Top:
    """The splits of a tree's large nodes: a row with a number of an interval above ``cut`` goes to the right."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])  # the right child is the next node
    large: list[int] = field(default_factory=lambda: [0])
    closed: list[int] = field(default_factory=list)

    def split(self, node: int, feature: int, cut: int) -> int:
        """The number of the left child."""
        child = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, child
        for values, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0)):
            values += [empty, empty]
        return child

    def nodes(self, cells: np.ndarray) -> np.ndarray:
        """The node that each row (column of ``cells``) has reached."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(cells.shape[1], dtype=np.int32)
        going = np.arange(len(at)) if feature[0] >= 0 else at[:0]
        while len(going):
            node = at[going]
            at[going] = left[node] + (cells[feature[node], going] > cut[node])
            going = going[feature[at[going]] >= 0]
        return at


@dataclass
class Drawn:
    """Rows of a chunk that a tree sees: their columns, mean target, number of draws, range of the target, and places in the chunk."""

    tree: int
    at: np.ndarray
    y: np.ndarray
    w: np.ndarray
    low: np.ndarray
    high: np.ndarray
    merged: bool


def _draws(x: np.ndarray, y: np.ndarray, row: np.ndarray, tree_hashes: list[int]) -> tuple[np.ndarray, Iterator[Drawn]]:
    """The distinct rows of a chunk, and which of them each tree sees."""
    alike = _alike(x)
    if alike is not None:
        # Rows of a group side by side, by target.
        order = np.lexsort((y, alike[1]))
        y, row, first, starts = y[order], row[order], alike[0], np.searchsorted(alike[1][order], np.arange(len(alike[0])))
    hashed = _rows_hashed(row)

    def trees() -> Iterator[Drawn]:
        for tree, tree_hash in enumerate(tree_hashes):
            w = _weights(tree_hash, hashed)
            if alike is None:
                at = np.flatnonzero(w)
                own = y[at]
                yield Drawn(tree, at, own, w[at].astype(np.int32), own, own, False)
                continue
            seen = np.flatnonzero(w)
            often = w.astype(np.float64)
            many = np.add.reduceat((w > 0).astype(np.int64), starts)
            upto = np.cumsum(many)
            at = np.flatnonzero(many)
            sums = np.add.reduceat(often, starts)[at]
            often *= y
            low, high = y[seen[(upto - many)[at]]], y[seen[upto[at] - 1]]
            yield Drawn(tree, at, np.add.reduceat(often, starts)[at] / sums, sums.astype(np.int32), low, high, True)

    return (x if alike is None else x[:, first]), trees()


def _coded(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column as small numbers and the values they stand for, as whole numbers of four bytes, or as it is; without values in the latter cases."""
    values = np.unique(column)
    if len(values) <= 1 << 8:
        return np.searchsorted(values, column).astype(np.uint8), values
    if np.abs(values).max() < 1 << 31 and (values == np.trunc(values)).all():
        return column.astype(np.int32), values[:0]
    return column, values[:0]


def _written(coded: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> bytes:
    """Some rows of coded columns, column after column: the width of its numbers, that of its values, both."""
    return b"".join(part for codes, values in coded for part in (
        np.array([codes.itemsize, len(values)]).tobytes(), values.tobytes(), codes.take(rows).tobytes()))


def _columns_read(data: pa.Buffer, columns: int, rows: int) -> np.ndarray:
    """The columns of some written rows."""
    x, at = np.empty((columns, rows)), 0
    for own in x:
        width, count = np.frombuffer(data, dtype=np.int64, count=2, offset=at).tolist()
        values = np.frombuffer(data, count=count, offset=at + 16)
        at += 16 + 8 * count
        codes = np.frombuffer(data, dtype={1: np.uint8, 4: np.int32, 8: np.float64}[width], count=rows, offset=at)
        own[:] = values.take(codes) if width == 1 else codes
        at += width * rows
    return x


def _by_chunk(make: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], columns: list[str]):
    """A function for ``mapInArrow`` that hands on columns, target and row numbers of many rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def chunk() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            x = np.stack([table.column(c).to_numpy().astype(np.float64) for c in columns])
            return make(x, table.column("y").to_numpy(), table.column("row").to_numpy())

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield from chunk()
                held, n = [], 0
        if n:
            yield from chunk()

    return run


def _edges(base: DataFrame, columns: list[str], n: int) -> list[np.ndarray]:
    """The values at which each column may be cut in large nodes.

    Intervals hold so few of all rows that a large node meets more than CUTS of them in any column without hot values; a hot
    value has an interval of its own.
    """
    count = math.ceil((CUTS + 1) * max(n / TASK_ROWS, 1))
    fractions = F.array(*[F.lit((i + 1) / count) for i in range(count - 1)])
    found = base.agg(*[F.concat(F.array(F.min(c)), F.percentile_approx(c, fractions, 10 * count)).alias(c) for c in columns]).first()
    edges = []
    for c in columns:
        values, times = np.unique(np.array(found[c], dtype=np.float64), return_counts=True)
        edges.append((values, values[times > 1]))
    # The largest value below each hot one.
    hot = [(f, float(v), float(values[values < v].max())) for f, (values, often) in enumerate(edges) for v in often if (values < v).any()]
    if not hot:
        return [values for values, _ in edges]
    spans = base.sparkSession.createDataFrame(hot, "feature int, value double, above double")  # a row per cut at most
    cells = base.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("feature", "x"))
    below = (
        cells.join(F.broadcast(spans), "feature").filter("x < value and x > above")
        .groupBy("feature", "value").agg(F.max("x").alias("x")).collect()
    )
    return [np.unique(np.concatenate([values, [r["x"] for r in below if r["feature"] == f]])) for f, (values, _) in enumerate(edges)]


def _large_splits(base: DataFrame, columns: list[str], edges: list[np.ndarray], tops: list[Top], tree_hashes: list[int]) -> DataFrame:
    """(tree, node, n, feature, cell, gain, left_n) of every large node, without a feature if it cannot be split; of equal cuts the first."""
    task_rows = TASK_ROWS

    def sums(x: np.ndarray, y: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, draws = _draws(x, y, row, tree_hashes)
        cells = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x)]).astype(np.int32)
        for d in draws:
            top = tops[d.tree]
            if not top.large:
                continue
            slot_of = np.full(len(top.feature), -1)
            slot_of[top.large] = np.arange(len(top.large))
            own = cells[:, d.at]
            slot = slot_of[top.nodes(own)]
            inside = np.flatnonzero(slot >= 0)
            if not len(inside):
                continue
            slot, own, w, s = slot[inside], own[:, inside], d.w[inside], (d.w * d.y)[inside]
            low, high = np.full(len(top.large), np.inf), np.full(len(top.large), -np.inf)
            np.minimum.at(low, slot, d.low[inside])
            np.maximum.at(high, slot, d.high[inside])
            for f, e in enumerate(edges):
                key = slot * (len(e) + 1) + own[f]
                n = np.bincount(key)
                used = np.flatnonzero(n)
                of = used // (len(e) + 1)
                yield pa.RecordBatch.from_pydict({
                    "tree": np.full(len(used), d.tree, dtype=np.int32), "node": np.array(top.large, dtype=np.int32)[of],
                    "feature": np.full(len(used), f, dtype=np.int32), "cell": (used % (len(e) + 1)).astype(np.int32),
                    "n": n[used].astype(np.int64), "w": np.bincount(key, w)[used], "s": np.bincount(key, s)[used],
                    "low": low[of], "high": high[of],
                })

    node = ["tree", "node"]
    added = (
        base.mapInArrow(_by_chunk(sums, columns), "tree int, node int, feature int, cell int, n long, w double, s double, low double, high double")
        .groupBy(*node, "feature", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "w", "s")], F.min("low").alias("low"), F.max("high").alias("high"))
    )
    inside = W.partitionBy(*node, "feature")
    upto = inside.orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    sides = added.select(
        *node, "feature", "cell", *[F.sum(c).over(upto).alias(f"l{c}") for c in ("n", "w", "s")],
        *[F.sum(c).over(inside).alias(f"t{c}") for c in ("n", "w", "s")], F.min("low").over(inside).alias("low"), F.max("high").over(inside).alias("high"),
    )
    square = lambda s, w: s * s / w
    gain = square(F.col("ls"), F.col("lw")) + square(F.col("ts") - F.col("ls"), F.col("tw") - F.col("lw")) - square(F.col("ts"), F.col("tw"))
    cut = F.when(
        (F.col("lw") < F.col("tw")) & (F.col("low") < F.col("high")) & (F.col("tn") > task_rows),
        F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("cell")).alias("c"), F.col("ln").alias("n")))
    return sides.groupBy(*node).agg(F.max("tn").alias("n"), F.max(cut).alias("b")).select(
        *node, "n", (-F.col("b.f")).alias("feature"), (-F.col("b.c")).alias("cell"), F.greatest("b.gain", F.lit(0.0)).alias("gain"), F.col("b.n").alias("left_n"))


def forest_gains(rows: DataFrame, columns: list[str], trees: int, seed: int) -> DataFrame:
    """(tree, feature, gain) summed over the splits of each tree; ``rows`` holds the columns without nulls, and ``y``."""
    spark = rows.sparkSession
    # Written once, so that a row keeps its number and its draws.
    base = stored(rows.select(*columns, "y", F.monotonically_increasing_id().alias("row")))
    n = base.count()
    # Rows with equal columns meet in a chunk; the number of the row splits them where they are many.
    base = base.repartitionByRange(max(math.ceil(n / CHUNK_ROWS), spark.sparkContext.defaultParallelism), *columns, "row")
    hashes = spark.range(trees).select("id", F.xxhash64(F.lit(seed), F.col("id").cast("int")).alias("h")).collect()  # a row per tree
    tree_hashes = [r["h"] for r in sorted(hashes, key=lambda r: r["id"])]
    tops, found = [Top() for _ in range(trees)], []
    edges: list[np.ndarray] = [np.zeros(0)] * len(columns)
    # The number of distinct rows is estimated; if it is this far below, no tree sees more.
    if n > TASK_ROWS and base.agg(F.approx_count_distinct(F.struct(*columns))).first()[0] > 0.85 * TASK_ROWS:
        edges = _edges(base, columns, n)
        while any(top.large for top in tops):
            splits = _large_splits(base, columns, edges, tops, tree_hashes).collect()  # a row per large node
            for top in tops:
                top.large = []
            for r in sorted(splits, key=lambda r: (r["tree"], r["node"])):
                top = tops[r["tree"]]
                if r["feature"] is not None:
                    child = top.split(r["node"], r["feature"], r["cell"])
                    top.large += [node for node, size in ((child, r["left_n"]), (child + 1, r["n"] - r["left_n"])) if size > TASK_ROWS]
                    found.append((r["tree"], r["feature"], r["gain"]))
                elif r["n"] > TASK_ROWS:
                    top.closed.append(r["node"])

    def dealt(x: np.ndarray, y: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, draws = _draws(x, y, row, tree_hashes)
        cells = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x)]).astype(np.int32)
        coded = [_coded(v) for v in x]
        for d in draws:
            top = tops[d.tree]
            at = top.nodes(cells[:, d.at])
            w = d.w.astype(np.uint8) if d.w.max(initial=0) < 1 << 8 else d.w
            order = np.argsort(at, kind="stable")
            nodes, first = np.unique(at[order], return_index=True)
            for node, own in zip(nodes.tolist(), np.split(order, first[1:])):
                if node not in top.closed:
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([d.tree], pa.int32()), "node": pa.array([node], pa.int32()),
                        "x": [_written(coded, d.at[own])], "y": [d.y[own].tobytes()], "w": [w[own].tobytes()],
                        "low": [d.low[own].tobytes() if d.merged else b""], "high": [d.high[own].tobytes() if d.merged else b""],
                    })

    def grow(table: pa.Table) -> pa.Table:
        def read(name: str, kind: type = np.float64) -> list[np.ndarray]:
            return [np.frombuffer(v.as_buffer(), dtype=kind) for v in table.column(name)]

        ys = read("y")
        x = np.concatenate([_columns_read(v.as_buffer(), len(columns), len(own)) for v, own in zip(table.column("x"), ys)], axis=1)
        ws = [np.frombuffer(v, dtype=np.uint8 if len(v) == len(own) else np.int32) for v, own in zip(read("w", np.uint8), ys)]
        y, w = np.concatenate(ys), np.concatenate(ws).astype(np.float64)
        low, high = (np.concatenate([v if len(v) else own for v, own in zip(read(name), ys)]) for name in ("low", "high"))
        alike = _alike(x) if len(ys) > 1 else None
        if alike is not None:
            first, group = alike
            lows, highs = low[first], high[first]
            np.minimum.at(lows, group, low)
            np.maximum.at(highs, group, high)
            sums = np.bincount(group, w)
            x, y, w, low, high = x[:, first], np.bincount(group, w * y) / sums, sums, lows, highs
        return pa.table({
            "tree": pa.array([table.column("tree")[0].as_py()] * len(columns), pa.int32()), "feature": pa.array(range(len(columns)), pa.int32()),
            "gain": grown(x, y, w, low, high),
        })

    packed = base.mapInArrow(_by_chunk(dealt, columns), "tree int, node int, x binary, y binary, w binary, low binary, high binary")
    parts = 2 * sum(1 + (len(top.feature) - 1) // 2 for top in tops)  # twice the nodes
    ends = packed.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(grow, "tree int, feature int, gain double")
    if found:
        ends = ends.unionByName(spark.createDataFrame(found, "tree int, feature int, gain double"))
    return ends.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))


def importances(rows: DataFrame, columns: list[str], trees: int, seed: int) -> DataFrame:
    """(feature, importance): the share of each column in the gains of a tree, in the mean over the trees."""
    gains = forest_gains(rows, columns, trees, seed)
    whole = F.sum("gain").over(W.partitionBy("tree"))  # a row per column
    shares = gains.select("feature", F.when(whole > 0, F.col("gain") / whole).otherwise(0.0).alias("share"))
    return shares.groupBy("feature").agg((F.sum("share") / trees).alias("importance"))
