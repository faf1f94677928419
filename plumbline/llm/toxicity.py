"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

One weight per hashed word is shared by all thresholds: the chance that a text is
of grade k or more is sigmoid(weights * features - threshold k), thresholds rising
with the grade. The expected severity is the sum of these chances. Weights
are found by proximal gradient steps under an elastic net: words that happen to stand in
a few toxic texts get no weight, and the words of a text that was copied many times share a small one.

The labels tell toxic from harmless only. Grades of the toxic ones come from
the labels too: words that are far more frequent in toxic texts are markers, and
the share of markers among the words of a toxic text, cut at its terciles, gives
mild, medium and severe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.llm.bytesops import Hashing, edges, text_bytes, text_groups
from plumbline.llm.training import Sparse, counted, held_out, labelled_sample, row_sums, sigmoid, stacked

FEATURE_BITS = 20
SAMPLE = 12_000  # labelled rows that are learned from, at most
GRADES = 3  # above harmless
# Penalties (of the sum of weights, of their squares) when words are chosen and when the chosen ones are weighed:
# the first keeps rare words out, the second spreads weight over words that always come together. They
# shrink with the size of the sample, by its root and by itself, as chance does.
CHOOSING, WEIGHING = (0.08, 1.2), (0.005, 0.24)
# A word must stand in so many rows of the sample, and in no smaller or larger share of them.
LEAST_ROWS, LEAST_SHARE, LARGEST_SHARE = 3, 5e-4, 0.5
ROUNDS = 400
USUAL_WORDS, SMALL_TEXT = 100, 20
MARKER_ROWS, MARKER_LIFT = 3, 10.0  # toxic texts a marker stands in at least, and how much more often than in others
TEXT_AT_A_TIME = 2 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_features(texts) -> Sparse:
    """Hashed lower-case words of each text with their counts; a word is letters, digits and bytes beyond ASCII."""
    data, bounds = text_bytes(texts)
    parts = []
    for first, last in text_groups(bounds, TEXT_AT_A_TIME):
        own = _LOWER[data[bounds[first]:bounds[last]]]
        limits = bounds[first: last + 1] - bounds[first]
        starts, ends = edges(_WORD[own], limits)
        feature = Hashing(41).words(own, starts, ends) >> np.uint64(64 - FEATURE_BITS)
        parts.append(counted(feature, np.searchsorted(starts, limits)))
    return stacked(parts)


def dampened(features: Sparse) -> Sparse:
    """Counts as 1 + log(count), over the root of the number of words, so that the chance part of a sum of
    weights is as large for long texts as for short ones."""
    words = np.diff(features.bounds)
    share = np.sqrt(USUAL_WORDS / (words + SMALL_TEXT))
    return Sparse(features.index, (1 + np.log(features.value)) * np.repeat(share, words), features.bounds)


def severity_grades(features: Sparse, toxic: np.ndarray) -> np.ndarray:
    """0 for harmless texts, 1 to 3 for toxic ones by their share of marker words."""
    size = 1 << FEATURE_BITS
    row = features.row_of()
    inside = np.bincount(features.index[toxic[row] == 1], minlength=size)
    outside = np.bincount(features.index[toxic[row] == 0], minlength=size)
    n_toxic, n_other = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    lift = (inside / n_toxic) / ((outside + 0.5) / n_other)
    marker = (inside >= max(MARKER_ROWS, n_toxic / 50)) & (lift >= MARKER_LIFT)
    share = row_sums(features.value * marker[features.index], features.bounds) / np.maximum(row_sums(features.value, features.bounds), 1)
    grades = np.zeros(len(toxic), dtype=np.int64)
    some = np.flatnonzero(toxic == 1)
    if len(some):
        cuts = np.quantile(share[some], [1 / 3, 2 / 3])
        grades[some] = 1 + np.searchsorted(cuts, share[some], side="right")
    return grades


class OrdinalModel:
    """Sparse weights and rising thresholds."""

    def __init__(self, features: Sparse, grades: np.ndarray):
        self.index = np.empty(0, dtype=np.int64)
        self.weight = np.empty(0)
        n = len(grades)
        share = np.array([(grades >= k).mean() if n else 0.0 for k in range(1, GRADES + 1)])
        self.threshold = np.log((1 - share + 1e-4) / (share + 1e-4))
        if n and 0 < share[0] < 1:
            self._train(dampened(features), grades)

    def _train(self, features: Sparse, grades: np.ndarray) -> None:
        """Choose words under the strict penalty, then weigh the chosen ones under the mild one."""
        n = len(grades)
        known, index = np.unique(features.index, return_inverse=True)
        row, value = features.row_of(), features.value.astype(np.float64)
        rows = np.bincount(index, minlength=len(known))
        chosen = (rows >= max(LEAST_ROWS, n * LEAST_SHARE)) & (rows <= max(LEAST_ROWS, n * LARGEST_SHARE))
        for penalties in (CHOOSING, WEIGHING):
            kept = chosen[index]
            place = (np.cumsum(chosen) - 1)[index[kept]]
            weight, threshold = _descend(place, value[kept], row[kept], int(chosen.sum()), grades, self.threshold, penalties)
            chosen[np.flatnonzero(chosen)[weight == 0]] = False
        self.index = known[chosen]
        self.weight = weight[weight != 0]
        self.threshold = threshold

    def chances(self, texts) -> np.ndarray:
        """For each text the chances of grade 1 or more, 2 or more, and so on."""
        features = dampened(word_features(texts))
        at = np.minimum(np.searchsorted(self.index, features.index), max(len(self.index) - 1, 0))
        if len(self.index):
            value = np.where(self.index[at] == features.index, self.weight[at], 0) * features.value
        else:
            value = np.zeros(len(features.index))
        return sigmoid(row_sums(value, features.bounds)[:, None] - self.threshold)


def _descend(place, value, row, size: int, grades, threshold, penalties: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient steps over all rows."""
    n = len(grades)
    sparse, ridge = penalties[0] / n**0.5, penalties[1] / n
    if size == 0:
        return np.empty(0), threshold
    bounds = np.searchsorted(row, np.arange(n + 1))
    reached = grades[:, None] >= np.arange(1, GRADES + 1)
    # Features are scaled to one spread, so that one step length suits them all; penalties are of the unscaled weights.
    scale = np.sqrt(np.bincount(place, weights=value**2, minlength=size) / n)
    value = value / scale[place]
    length = 1 / (_curvature(place, value, row, bounds, size, n) + ridge / scale.min() ** 2)
    weight, momentum = np.zeros(size), 1.0
    ahead, ahead_threshold = weight, threshold
    for _ in range(ROUNDS):
        margin = row_sums(value * ahead[place], bounds)
        wrong = sigmoid(margin[:, None] - ahead_threshold) - reached
        gradient = np.bincount(place, weights=value * wrong.sum(1)[row], minlength=size) / n + ridge * ahead / scale**2
        moved = ahead - length * gradient
        after = np.sign(moved) * np.maximum(np.abs(moved) - length * sparse / scale, 0)
        after_threshold = np.maximum.accumulate(ahead_threshold + length * wrong.mean(0))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = after + (momentum - 1) / faster * (after - weight)
        ahead_threshold = after_threshold + (momentum - 1) / faster * (after_threshold - threshold)
        weight, threshold, momentum = after, after_threshold, faster
    return weight / scale, threshold


def _curvature(place, value, row, bounds, size: int, n: int) -> float:
    """The steepest curvature of the loss, by power iteration; a threshold is one more feature."""
    random = np.random.default_rng(3)
    v, steepest = random.normal(size=size + 1), 1.0
    for _ in range(20):
        v /= np.linalg.norm(v)
        rows = row_sums(value * v[:-1][place], bounds) + v[-1]
        v = np.append(np.bincount(place, weights=value * rows[row], minlength=size), rows.sum()) / n
        steepest = np.linalg.norm(v)
    return 0.25 * GRADES * steepest * 1.1


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE) -> OrdinalModel:
    """Learn from at most ``rows`` labelled rows that are not held out; without any nothing is toxic."""
    texts, toxic = labelled_sample(docs, labels, label_col, rows, id_col, text_col)
    features = word_features(texts)
    return OrdinalModel(features, severity_grades(features, toxic))


def grade_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``held_out``, ``severity`` (expected grade, 0 to 3), ``toxic_chance``, ``grade`` and ``toxic``.

    ``grade`` counts the thresholds that are more likely passed than not; ``toxic``
    means grade 1 or more. The grade depends on the whole text alone. Null texts are empty texts, which
    hold no word; null and repeated ids pass through; an empty table gives no
    rows. Other columns are not read.
    """
    handed = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.threshold))

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel.__new__(OrdinalModel)
        own.index, own.weight, own.threshold = handed.value
        for batch in batches:
            chances = own.chances(batch.column("text"))
            passed = (chances >= 0.5).sum(1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "severity": pa.array(chances.sum(1)),
                "toxic_chance": pa.array(chances[:, 0]), "grade": pa.array(passed.astype(np.int32)), "toxic": pa.array(passed > 0),
            })

    picked = docs.select(
        col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    out = picked.mapInArrow(grade, "doc_id long, held_out boolean, severity double, toxic_chance double, grade int, toxic boolean")
    return out.withColumnRenamed("doc_id", id_col)
