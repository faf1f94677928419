"""Documents scored by the difference of two language models' cross-entropies.

A target model, of the documents labelled good, and a background model, of all
documents, are matched: both are bigram models over one vocabulary (every word of
the corpus), interpolated with the same weights with the same smoothed unigram model.
They differ only in what was counted. A document's score is the difference of
its losses per token; below zero it looks more like the target.

Counts cover all documents and their table grows with the corpus, so it is never
sent anywhere whole. Blocks of documents send their own counts to the owners of
the n-grams, who add them up and answer every block with the totals of the n-grams that it holds; a block sends nothing to
an owner of which it holds no n-gram. The three totals of the corpus are one aggregate. An n-gram is known by 80 bits of hash.
A document is scored by counts without its own, so that no text is likely just because it was counted.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored
from plumbline.llm import blocks as B
from plumbline.llm.bytesops import Hashing, mixed, ragged, text_bytes, words_of
from plumbline.llm.training import row_sums

BIGRAM_WEIGHT = 0.6  # of the bigram model, where its context was seen
SMOOTHING = 0.1  # added to the count of every word
BEGIN, END = np.uint64(1), np.uint64(2)
ANSWER = f"{B.ANSWER}, words long, every long, good long"
TOTALS = 3  # the kind of an answer that is for no block


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of hashes in rising order, and the place of each among them."""
    names, at, back = np.unique(first, return_index=True, return_inverse=True)
    if np.array_equal(second[at][back], second):
        return names, second[at], back
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    back = np.empty(len(a), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return a[new], b[new], back


class Block:
    """The documents of a block as tokens between a begin and an end mark."""

    def __init__(self, table: pa.Table, labels: pa.Table):
        numbers, order = B.id_order(table.column("id"), table.column("text"))
        self.names = table.column("id").take(pa.array(order))
        self.ids = numbers[order]
        good = labels.column("id").to_numpy(zero_copy_only=False) if len(labels) else np.empty(0, dtype=np.int64)
        self.target = np.isin(self.ids, good)
        data, bounds = text_bytes(table.column("text").take(pa.array(order)))
        starts, ends, words = words_of(data, bounds)
        hashes, others = Hashing(51).words(data, starts, ends), Hashing(52).words(data, starts, ends)
        count = np.diff(words)
        n = len(count)
        # Document d has count[d] words and two marks.
        self.lengths = count + 2
        first = np.cumsum(self.lengths) - self.lengths
        tokens, seconds = (np.empty(int(self.lengths.sum()), dtype=np.uint64) for _ in range(2))
        place = ragged(first + 1, count)
        for own, words_hash in ((tokens, hashes), (seconds, others)):
            own[place] = words_hash
            own[first], own[first + count + 1] = BEGIN, END
        self.document = np.repeat(np.arange(n), self.lengths)
        self.scored = np.ones(len(tokens), dtype=bool)
        self.scored[first] = False
        after = np.flatnonzero(self.scored)
        self.pair_document = self.document[after]
        self.unigrams, self.unigram_check, self.unigram_at = distinct(mixed(tokens), _short(mixed(seconds)))
        pairs = (mixed(t[after - 1] * np.uint64(3) + t[after], 9) for t in (tokens, seconds))
        self.bigrams, self.bigram_check, self.bigram_at = distinct(next(pairs), _short(next(pairs)))
        self.begin = self.unigram_at[first[0]] if n else 0
        self.after = after

    def _counts(self, at: np.ndarray, document: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(at, minlength=size), np.bincount(at[self.target[document]], minlength=size)

    def messages(self, part_bits: int) -> list[tuple[int, bytes]]:
        """(part, n-grams with their counts) for the parts of which the block holds any; unigrams have the first parts."""
        parts = 1 << part_bits
        out = []
        for kind, (keys, check, at, document) in enumerate((
            (self.unigrams, self.unigram_check, self.unigram_at, self.document),
            (self.bigrams, self.bigram_check, self.bigram_at, self.pair_document),
        )):
            every, good = self._counts(at, document, len(keys))
            for p, a, b in B.cut_by_part(keys >> np.uint64(64 - part_bits)):
                out.append((kind * parts + p, B.pack_all(
                    B.pack_rising(keys[a:b]), B.pack_numbers(check[a:b]), B.pack_numbers(every[a:b]), B.pack_numbers(good[a:b]))))
        return out

    def losses(self, answers: pa.Table, words: int, sums: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per token of each document under the target and the background model; ``words`` can be predicted, ``sums`` tokens
        are in the background and in the target."""
        totals: list[list[list[np.ndarray]]] = [[[], []], [[], []]]
        for kind in (0, 1):
            for _, payload in B.by_part(answers, kind):
                every, good = B.unpack_all(payload)
                totals[kind][0].append(B.unpack_numbers(every))
                totals[kind][1].append(B.unpack_numbers(good))
        n = len(self.ids)
        own_unigram = _own(self.unigram_at, self.document, len(self.unigrams))
        own_bigram = _own(self.bigram_at, self.pair_document, len(self.bigrams))
        out = []
        for model in (1, 0):
            unigram = np.concatenate(totals[0][model]).astype(np.float64)
            bigram = np.concatenate(totals[1][model]).astype(np.float64)
            # A document's own counts are in the background always, in the target if it is labelled good.
            counted = self.target.astype(np.float64) if model else np.ones(n)
            seen = unigram[self.unigram_at] - own_unigram * counted[self.document]
            pair = bigram[self.bigram_at] - own_bigram * counted[self.pair_document]
            total = float(sums[model]) - unigram[self.begin] - (self.lengths - 1) * counted
            base = (seen[self.after] + SMOOTHING) / (total[self.pair_document] + SMOOTHING * words)
            context = seen[self.after - 1]
            weight = np.where(context > 0, BIGRAM_WEIGHT, 0.0)
            chance = weight * pair / np.maximum(context, 1) + (1 - weight) * base
            bounds = np.concatenate([[0], np.cumsum(self.lengths - 1)])
            out.append(row_sums(-np.log2(chance), bounds) / (self.lengths - 1))
        return out[0], out[1]


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(48)


def _own(at: np.ndarray, document: np.ndarray, size: int) -> np.ndarray:
    """For every place how often its n-gram stands in the same document."""
    _, back, count = np.unique(document.astype(np.int64) * max(size, 1) + at, return_inverse=True, return_counts=True)
    return count[back]


def _totals(part_bits: int):
    def total(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        blocks = table.column("block").to_pylist()
        sent = [[B.unpack_rising(p[0]), *map(B.unpack_numbers, p[1:])] for p in map(B.unpack_all, table.column("payload").to_pylist())]
        first, check, every, good = (np.concatenate([s[i] for s in sent]) for i in range(4))
        keys, _, back = distinct(first, check)
        every = np.bincount(back, weights=every, minlength=len(keys)).astype(np.int64)
        good = np.bincount(back, weights=good, minlength=len(keys)).astype(np.int64)
        out, at = [], 0
        for block, (own, *_) in zip(blocks, sent):
            place = back[at: at + len(own)]
            at += len(own)
            out.append((block, B.pack_all(B.pack_numbers(every[place]), B.pack_numbers(good[place]))))
        kind = part >> part_bits
        rows = B.answers(kind, part, out)
        none = pa.nulls(len(rows), pa.int64())
        for name in ("words", "every", "good"):
            rows = rows.append_column(name, none)
        if kind == 0:
            rows = pa.concat_tables([rows, pa.table({
                "block": pa.array([-1], pa.int32()), "kind": pa.array([TOTALS], pa.int32()), "part": pa.array([part], pa.int64()),
                "payload": pa.array([None], pa.binary()), "words": [len(keys)], "every": [int(every.sum())], "good": [int(good.sum())],
            })])
        return rows

    return total


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """One row per input row: its id, ``n_tokens``, ``target_loss``, ``background_loss`` (bits per token) and their ``difference``.

    Words are runs of bytes other than ASCII white space, unchanged; the end of a text is a
    token too, so an empty or null text has one. The target are the
    documents with a label of 1; rows with equal ids are all in it or none. Without
    any label the target model is the smoothed vocabulary. A null id is never
    labelled. An empty table gives no rows. Other columns are not read.
    """
    volume = B.text_volume(docs, text_col)
    blocks = B.block_count(docs, volume)
    part_bits = max(1, B.power_of_two(blocks))
    blocked = docs.select(
        col(id_col).cast("long").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        B.block_of(id_col, blocks).alias("block"),
    ).groupBy("block")
    good = (
        labels.filter((col(label_col) == 1) & col(id_col).isNotNull())
        .select(col(id_col).cast("long").alias("id"), B.block_of(id_col, blocks).alias("block"))
    )

    def count(table: pa.Table, target: pa.Table) -> pa.Table:
        if len(table) == 0:  # labels without documents
            return B.messages(0, [])
        return B.messages(table.column("block")[0].as_py(), Block(table, target).messages(part_bits))

    counted = blocked.cogroup(good.groupBy("block")).applyInArrow(count, B.MESSAGE)
    # Written once, as both the totals and the answers are read from it.
    answered = stored(counted.groupBy("part").applyInArrow(_totals(part_bits), ANSWER))
    words, every, target = answered.filter(F.col("kind") == TOTALS).agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "every", "good")]
    ).first()
    words -= 1  # the begin mark is never predicted

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        labelled = answers.filter(pa.compute.equal(answers.column("kind"), 2)).select(["part"]).rename_columns(["id"])
        if len(table) == 0:
            return pa.table({"id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "target_loss": pa.array([], pa.float64()), "background_loss": pa.array([], pa.float64())})
        block = Block(table, labelled)
        target_loss, background_loss = block.losses(answers, words, (every, target))
        return pa.table({"id": block.names, "n_tokens": block.lengths - 1, "target_loss": target_loss, "background_loss": background_loss})

    # The labels travel with the answers, as rows of a kind of their own.
    marked = good.select("block", F.lit(2).alias("kind"), F.col("id").alias("part"), F.lit(None).cast("binary").alias("payload"))
    told = answered.filter(F.col("kind") < 2).select("block", "kind", "part", "payload")
    scored = blocked.cogroup(told.unionByName(marked).groupBy("block")).applyInArrow(
        score, "id long, n_tokens long, target_loss double, background_loss double"
    )
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss",
        (F.col("target_loss") - F.col("background_loss")).alias("difference"),
    )
