"""A quality classifier on supervised subword embeddings.

Words, pairs of neighbouring words and the character 3- and 4-grams of words
(with their borders) are hashed into buckets, each with a learned vector; a pair of equal words
has a bucket of its own, whatever the word. The vectors of a document are
averaged and a softmax layer gives the probability of each class. Vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded sample of
labelled rows; every document is scored, over its whole text.

The layer is linear, so a trained bucket needs only its share of the margin
between the classes when documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.llm.bytesops import IS_SPACE, Hashing, mixed, text_bytes, text_groups, words_of
from plumbline.llm.training import Sparse, counted, held_out, labelled_sample, row_sums, sigmoid

BUCKET_BITS = 18
DIMENSIONS = 16
SAMPLE = 6_000  # labelled rows that are learned from, at most
STEPS = 600  # of the descent, at least; whole epochs
BATCH = 64
RATE = 4.0
GRAMS = (3, 4)
SEED = 5
TEXT_AT_A_TIME = 1 << 20


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_parts(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the texts with the bounds of the texts among them: words, pairs of words, character n-grams."""
    starts, ends, words = words_of(data, bounds)
    hashes = Hashing(31).words(data, starts, ends)
    out = [(_bucket(hashes), words)]
    if len(hashes) > 1:
        pair = mixed(hashes[:-1] * np.uint64(3) + hashes[1:], 7)
        pair[hashes[:-1] == hashes[1:]] = mixed(np.zeros(1, dtype=np.uint64), 8)[0]
        # A pair belongs to the text of its second word; the first word of a text ends none.
        second = np.ones(len(hashes), dtype=bool)
        second[words[:-1][words[:-1] < len(hashes)]] = False
        before = np.concatenate([[0], np.cumsum(second)])
        out.append((_bucket(pair[second[1:]]), before[words]))
    space = IS_SPACE[data]
    letters = np.where(space, np.uint8(32), data).astype(np.uint64)
    spaces = np.concatenate([[0], np.cumsum(space)])
    for n in GRAMS:
        if len(data) < n:
            continue
        value = np.full(len(data) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            value = (value << np.uint64(8)) | letters[k: len(data) - n + 1 + k]
        # White space may stand at either border of a gram, not inside, and a gram lies in one text.
        ok = spaces[n - 1: len(data)] - spaces[1: len(data) - n + 2] == 0
        for edge in range(1, n):
            cut = bounds[1:-1] - edge
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        at = np.flatnonzero(ok)
        out.append((_bucket(mixed(value[at])), np.searchsorted(at, bounds)))
    return out


def document_features(texts) -> list[Sparse]:
    """Distinct buckets of each text with their shares, some texts at a time: together they would be twice as large while they are joined."""
    data, bounds = text_bytes(texts)
    parts = []
    for first, last in text_groups(bounds, TEXT_AT_A_TIME):
        own = bucket_parts(data[bounds[first]:bounds[last]], bounds[first: last + 1] - bounds[first])
        row = np.concatenate([np.repeat(np.arange(last - first), np.diff(b)) for _, b in own])
        feature = np.concatenate([f for f, _ in own])
        order = np.argsort(row, kind="stable")
        found = counted(feature[order], np.searchsorted(row[order], np.arange(last - first + 1)))
        total = row_sums(found.value, found.bounds)
        found.value /= np.repeat(np.maximum(total, 1), np.diff(found.bounds)).astype(np.float32)
        parts.append(found)
    return parts


class SubwordModel:
    """Bucket vectors and a softmax layer over averaged vectors, for two classes."""

    def __init__(self, features: list[Sparse], label: np.ndarray):
        random = np.random.default_rng(SEED)
        size = 1 << BUCKET_BITS
        self.vectors = random.uniform(-1, 1, (size, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        self.layer = np.zeros((DIMENSIONS, 2))
        share = label.mean() if len(label) else 1.0
        self.bias = np.log(np.clip([1 - share, share], 1e-3, 1))
        if 0 < share < 1:
            self._train(features, label, random)
        difference = self.layer[:, 1] - self.layer[:, 0]
        self.margin = (self.vectors @ difference).astype(np.float32)
        self.offset = float(self.bias[1] - self.bias[0]) if len(label) else 60.0

    def _train(self, features: list[Sparse], label: np.ndarray, random: np.random.Generator) -> None:
        n, done, batches = len(label), 0, -(-len(label) // BATCH)
        epochs = -(-STEPS // batches)
        lengths = np.concatenate([np.diff(f.bounds) for f in features])
        places = [(f, slice(a, b)) for f in features for a, b in zip(f.bounds[:-1], f.bounds[1:])]
        target = np.eye(2)[label]
        for _ in range(epochs):
            order = random.permutation(n)
            for first in range(0, n, BATCH):
                rows = order[first: first + BATCH]
                index = np.concatenate([f.index[s] for f, s in map(places.__getitem__, rows)])
                value = np.concatenate([f.value[s] for f, s in map(places.__getitem__, rows)])
                bounds = np.concatenate([[0], np.cumsum(lengths[rows])])
                mean = row_sums(self.vectors[index] * value[:, None], bounds)
                logits = mean @ self.layer + self.bias
                share = np.exp(logits - logits.max(1, keepdims=True))
                wrong = share / share.sum(1, keepdims=True) - target[rows]
                rate = RATE * (1 - done / (epochs * batches))
                # Of two classes the errors are opposite, so the gradients of all buckets point along one
                # direction: by the sum over a bucket's documents of share times error.
                pull = np.bincount(
                    index, weights=value * np.repeat(wrong[:, 1], lengths[rows]), minlength=len(self.vectors)
                )
                touched = np.flatnonzero(pull)
                direction = self.layer[:, 1] - self.layer[:, 0]
                self.vectors[touched] -= (rate * pull[touched, None] * direction).astype(np.float32)
                self.layer -= rate * mean.T @ wrong / len(rows)
                self.bias -= 0.1 * rate * wrong.mean(0)
                done += 1

    def scores(self, texts) -> np.ndarray:
        """Probability of class 1 for each text."""
        data, bounds = text_bytes(texts)
        out = np.empty(len(bounds) - 1)
        for first, last in text_groups(bounds, TEXT_AT_A_TIME):
            total, count = np.zeros(last - first), np.zeros(last - first)
            for feature, own in bucket_parts(data[bounds[first]:bounds[last]], bounds[first: last + 1] - bounds[first]):
                total += row_sums(self.margin[feature], own)
                count += np.diff(own)
            out[first:last] = sigmoid(total / np.maximum(count, 1) + self.offset)
        return out


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE) -> SubwordModel:
    """Learn from at most ``rows`` labelled rows that are not held out; without any every score is one."""
    texts, label = labelled_sample(docs, labels, label_col, rows, id_col, text_col)
    return SubwordModel(document_features(texts), label)


def score_quality(
    docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, whole_rows: bool = False,
) -> DataFrame:
    """One row per input row: its id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The score depends on the text alone. Null texts are empty texts; a text
    without words gets the score that the classes' shares give. Null and repeated
    ids pass through; an empty table gives no rows. With ``whole_rows`` the input
    row comes along as the struct ``row``, under whatever column names it has.
    """
    handed = docs.sparkSession.sparkContext.broadcast((model.margin, model.offset))
    taken = docs.select(
        col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        *([F.struct("*").alias("row")] if whole_rows else []),
    )
    kept = [f for f in taken.schema if f.name != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordModel.__new__(SubwordModel)
        own.margin, own.offset = handed.value
        for batch in batches:
            got = own.scores(batch.column("text"))
            columns = {f.name: batch.column(f.name) for f in kept}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(got), "predicted": pa.array((got >= threshold).astype(np.int32))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return taken.mapInArrow(score, f"{fields}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    return score_quality(docs, model, id_col, text_col, threshold, whole_rows=True).filter("predicted = 1").select("row.*")
