"""Repeated windows of words, with a count-min sketch before the exact grouping.

First pass: every block of documents sketches its windows. A sketch has several
rows of counters, each addressed by its own hash; a counter only has to tell
"once" from "more often". Sketches are cut into segments, and the owner of a
segment adds up those of all blocks. A merged counter is never below the
number of windows that fell on it.

What is counted for a window is its anchor: of the runs of ``window // 2`` words
inside it, the one with the smallest hash, the leftmost of equals. Equal windows have equal anchors at
different places of the corpus, so the count of the anchor is at least that of
the window, and neighbouring windows mostly share one anchor: the sketch holds a
sixth of what it would hold for the windows themselves.

Second pass: only windows whose anchor is estimated to occur more than once are
grouped exactly, by 96 bits of hash. A block keeps the earliest window of each
group to itself and asks the owner of the hash whether an earlier document has it too,
so a window that a third of all documents share arrives once per block.

Every word that a later window of a group covers is removed.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.llm import blocks as B
from plumbline.llm.bytesops import Hashing, mixed, ragged, run_starts, text_bytes, words_of

ROWS = 3  # of the sketch
CELLS_PER_ANCHOR = 16
BYTES_PER_ANCHOR = 30  # of usual text
# A segment has 2 ** 20 counters until there are 256 of them; from then on they grow up to 2 ** 26.
SEGMENT_BITS, SEGMENTS, LARGEST_SEGMENT_BITS = 20, 8, 26


class Layout:
    """How many counters, segments and ranges of hashes there are."""

    def __init__(self, volume: int, blocks: int, window: int, text_col: str | None):
        self.text_col = text_col  # of the whole rows, if these are there
        self.window, self.gram, self.blocks = window, max(1, window // 2), blocks
        self.cell_bits = max(SEGMENT_BITS, B.power_of_two(CELLS_PER_ANCHOR * volume / BYTES_PER_ANCHOR))
        self.segment_bits = min(LARGEST_SEGMENT_BITS, max(SEGMENT_BITS, self.cell_bits - SEGMENTS))
        self.key_bits = max(1, B.power_of_two(blocks))

    def cells(self, anchors: np.ndarray, row: int) -> np.ndarray:
        return mixed(anchors, row + 1) >> np.uint64(64 - self.cell_bits)

    def segment(self, cells: np.ndarray) -> np.ndarray:
        return (cells >> np.uint64(self.segment_bits)).astype(np.int64)


def _leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of every ``width`` neighbours, the leftmost of equals."""
    place = np.arange(len(values), dtype=np.int64)
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = values[:-step], values[step:]
        better = right < left
        values, place = np.where(better, right, left), np.where(better, place[step:], place[:-step])
        done += step
    return place


class Block:
    """The documents of one block in order, their words and their windows."""

    def __init__(self, table: pa.Table, layout: Layout):
        self.layout = layout
        texts = pc.struct_field(table.column("row"), layout.text_col) if layout.text_col else table.column("text")
        numbers, order = B.id_order(table.column("id"), texts)
        self.order = pa.array(order)
        self.ids = numbers[order]
        self.data, self.bounds = text_bytes(texts.take(self.order))
        self.starts, self.ends, self.word_bounds = words_of(self.data, self.bounds)
        self.words = Hashing(21).words(self.data, self.starts, self.ends)
        self.windows = run_starts(self.word_bounds, layout.window)
        if len(self.windows):
            grams = Hashing(22).runs(self.words, layout.gram)
            place = _leftmost_minima(grams, layout.window - layout.gram + 1)[self.windows]
            new = np.ones(len(place), dtype=bool)
            new[1:] = place[1:] != place[:-1]
            values = grams[place[new]]
            self.anchors, index, counts = np.unique(values, return_inverse=True, return_counts=True)
            self.repeated_here = counts > 1
            self.anchor_of_window = index[np.cumsum(new) - 1]
        else:
            self.anchors = np.empty(0, dtype=np.uint64)
            self.repeated_here = np.empty(0, dtype=bool)
            self.anchor_of_window = np.empty(0, dtype=np.int64)

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counters of a row that this block adds to, whether twice, and the counter of each anchor."""
        cells, index, counts = np.unique(self.layout.cells(self.anchors, row), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[index[self.repeated_here]] = True
        return cells, twice, index

    def sketch(self) -> list[tuple[int, bytes]]:
        """(part, counters) for every row and segment."""
        layout, out = self.layout, []
        segments = 1 << (layout.cell_bits - layout.segment_bits)
        for row in range(ROWS):
            cells, twice, _ = self.cells(row)
            for segment, a, b in B.cut_by_part(layout.segment(cells)):
                own = cells[a:b] - np.uint64(segment << layout.segment_bits)
                out.append((row * segments + segment, B.pack_all(B.pack_rising(own), np.packbits(twice[a:b]).tobytes())))
        return out

    def candidates(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First windows of each group of this block, by hash, with the two hashes, and its later windows."""
        layout = self.layout
        segments = 1 << (layout.cell_bits - layout.segment_bits)
        bits: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for part, payload in B.by_part(answers, 0):
            (count,) = struct.unpack_from("<I", payload)
            bits[part // segments].append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=4), count=count))
        repeated = np.ones(len(self.anchors), dtype=bool)
        for row in range(ROWS):
            _, _, index = self.cells(row)
            if len(index):
                repeated &= np.concatenate(bits[row]).astype(bool)[index]
        at = self.windows[repeated[self.anchor_of_window]]
        h1 = Hashing(23).runs(self.words, layout.window)[at] if len(at) else np.empty(0, dtype=np.uint64)
        h2 = Hashing(24).runs(self.words, layout.window)[at] >> np.uint64(32) if len(at) else h1
        order = np.lexsort((h2, h1))
        at, h1, h2 = at[order], h1[order], h2[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return at[first], h1[first], h2[first], at[~first]

    def questions(self, answers: pa.Table) -> list[tuple[int, bytes]]:
        """(part, hashes and document ids) of the first windows."""
        at, h1, h2, _ = self.candidates(answers)
        document = np.searchsorted(self.word_bounds, at, side="right") - 1
        least = int(self.ids[0])
        ids = (self.ids[document].astype(np.uint64) - np.uint64(least % (1 << 64)))
        parts = (h1 >> np.uint64(64 - self.layout.key_bits)).astype(np.int64)
        return [
            (part, B.pack_all(B.pack_rising(h1[a:b]), h2[a:b].astype("<u4").tobytes(), B.pack_numbers(ids[a:b]), struct.pack("<q", least)))
            for part, a, b in B.cut_by_part(parts)
        ]

    def kept(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of each document: words, removed words and the words that stay, joined."""
        at, _, _, later = self.candidates(answers)
        elsewhere = [
            np.unpackbits(np.frombuffer(payload, np.uint8, offset=4), count=struct.unpack_from("<I", payload)[0])
            for _, payload in B.by_part(answers, 1)
        ]
        repeated = np.concatenate([later, at[np.concatenate(elsewhere).astype(bool)] if elsewhere else at[:0]])
        cover = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + self.layout.window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_words = np.diff(self.word_bounds)
        n_removed = removed[self.word_bounds[1:]] - removed[self.word_bounds[:-1]]
        starts, lengths = self.starts[~gone], (self.ends - self.starts + 1)[~gone]
        joined = np.append(self.data, np.uint8(32))[ragged(starts, lengths)]
        ends = np.cumsum(lengths)
        joined[ends - 1] = 32
        # The bytes of a document end before the space after its last word.
        before = np.concatenate([[0], ends])
        stay = self.word_bounds - removed[self.word_bounds]
        spans = before[stay]
        whole = joined.tobytes()
        texts = [whole[a: b - 1] if b > a else b"" for a, b in zip(spans[:-1].tolist(), spans[1:].tolist())]
        return n_words, n_removed, texts


def _merge_segment(layout: Layout):
    def merge(table: pa.Table) -> pa.Table:
        counters = np.zeros(1 << layout.segment_bits, dtype=np.uint8)
        blocks, sent = table.column("block").to_pylist(), table.column("payload").to_pylist()
        for payload in sent:
            rising, twice = B.unpack_all(payload)
            cells = B.unpack_rising(rising).astype(np.int64)
            own = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells))
            # Counters stop at two: more is never asked for.
            counters[cells] = np.minimum(counters[cells] + own, 2)
        out = []
        for block, payload in zip(blocks, sent):
            cells = B.unpack_rising(B.unpack_all(payload)[0]).astype(np.int64)
            out.append((block, struct.pack("<I", len(cells)) + np.packbits(counters[cells] > 1).tobytes()))
        return B.answers(0, table.column("part")[0].as_py(), out)

    return merge


def _merge_hashes(table: pa.Table) -> pa.Table:
    blocks, h1, h2, ids = table.column("block").to_pylist(), [], [], []
    for payload in table.column("payload").to_pylist():
        rising, second, numbers, least = B.unpack_all(payload)
        h1.append(B.unpack_rising(rising))
        h2.append(np.frombuffer(second, dtype="<u4"))
        ids.append((B.unpack_numbers(numbers) + np.uint64(struct.unpack("<q", least)[0] % (1 << 64))).astype(np.int64))
    a, b, d = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
    order = np.lexsort((d, b, a))
    later = np.zeros(len(a), dtype=bool)
    later[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    out, at = [], 0
    for block, own in zip(blocks, h1):
        out.append((block, struct.pack("<I", len(own)) + np.packbits(later[at: at + len(own)]).tobytes()))
        at += len(own)
    return B.answers(1, table.column("part")[0].as_py(), out)


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, whole_rows: bool = False,
) -> DataFrame:
    """One row per input row: its id, ``n_words``, ``n_removed`` and ``kept_text``.

    A word is a run of bytes other than ASCII white space. A window's sequence of
    words counts as repeated if it also starts in a document with a smaller id, or
    earlier in the same one. Windows are judged on the input. Null texts have
    no words; a text shorter than the window keeps all. A null id is smaller
    than all others; rows with equal ids are ordered by their texts, a copy of
    the whole row thus losing all that the first one keeps. An empty table gives no
    rows. Kept words are joined by one space. With ``whole_rows`` the input row comes along as the
    struct ``row``, under whatever column names it has.
    """
    volume = B.text_volume(docs, text_col)
    layout = Layout(volume, B.block_count(docs, volume), window, text_col if whole_rows else None)
    taken = docs.select(
        F.struct("*").alias("row") if whole_rows else F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        col(id_col).cast("long").alias("id"),
        B.block_of(id_col, layout.blocks).alias("block"),
    )
    blocked = taken.groupBy("block")

    def sketch(table: pa.Table) -> pa.Table:
        return B.messages(table.column("block")[0].as_py(), Block(table, layout).sketch())

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        return B.messages(table.column("block")[0].as_py(), Block(table, layout).questions(answers))

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, layout)
        n_words, n_removed, texts = block.kept(answers)
        out = {"id": table.column("id").take(block.order), "n_words": n_words, "n_removed": n_removed, "kept_text": pa.array(texts, type=pa.binary()).cast(pa.string())}
        return pa.table(({"row": table.column("row").take(block.order)} if whole_rows else {}) | out)

    counted = blocked.applyInArrow(sketch, B.MESSAGE).groupBy("part").applyInArrow(_merge_segment(layout), B.ANSWER)
    asked = blocked.cogroup(counted.groupBy("block")).applyInArrow(ask, B.MESSAGE)
    answered = counted.unionByName(asked.groupBy("part").applyInArrow(_merge_hashes, B.ANSWER))
    row = f"row {taken.schema['row'].dataType.simpleString()}, " if whole_rows else ""
    kept = blocked.cogroup(answered.groupBy("block")).applyInArrow(
        keep, f"{row}id long, n_words long, n_removed long, kept_text string"
    )
    return kept.withColumnRenamed("id", id_col)
