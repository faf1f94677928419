"""Hierarchical packing of documents into training sequences of several lengths.

Every task packs the documents of its own partition, so that no token leaves
the task that made it and nothing is shuffled. Within a task

1. a document of a whole window or more gives full windows; what is left of it
   is routed to the shortest tier (context size) that holds it;
2. every tier places its pieces, longest first, one piece opening one window;
3. the gap of a long window is filled from the shorter tiers: with whole pieces
   that fit, and at last with a part cut from a piece, so that the window is full;
4. what cannot fill a window any more is cut into windows of shorter tiers;
   the tiers are powers of two, so only the last window of a partition can
   hold padding, and less than the shortest tier;
5. windows are dealt to step groups of ``group_tokens`` tokens each, windows of
   equal length side by side, so that steps of a training run cost the same. Groups are formed
   inside an input partition; the last one of a partition may be smaller than the others.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.llm.bytesops import IS_SPACE, edges, ragged, text_bytes, text_groups
from plumbline.llm.pieces import PieceMemo

TIERS = (2048, 1024, 512, 256, 128, 64)
# Rows of all partitions get different sequence ids as long as one partition has fewer sequences than this.
SEQUENCES_PER_PARTITION = 1 << 36
# Bytes of text tokenized at a time.
TEXT_AT_A_TIME = 2 << 20

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.list_(pa.int32())),
])
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long, ids array<int>"
)

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
# ASCII signs that never join with a letter before them; the apostrophe may (as in 's).
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts by a vocabulary of the ``tokenizers`` library that drops white space.

    The library's pre-tokenizer never joins what white space separates, nor a
    letter and a sign after it, so every such piece has its ids once and for
    all, and only new pieces reach the library.
    """

    _loaded: dict[str, "WordTokenizer"] = {}

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.memo = PieceMemo(self._piece)

    def _piece(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "Ā":
            # Latin letters are one pre-token; no normal form changes them but the lower case.
            lowered = text.lower()
            shown = lowered if lowered.isascii() else lowered.encode().decode("latin-1").translate(self.letters)
            return [t.id for t in self.tokenizer.model.tokenize(shown)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the bounds of the texts among them."""
        solid = ~IS_SPACE[data]
        cuts = None
        if b"<|" not in data.tobytes():  # a special token's own text must stay whole
            letter = _ASCII_LETTER[data]
            # Two bytes 0xC3 0x80-0xBF are a Latin letter, but for the times and division signs.
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cuts = np.flatnonzero(letter[:-1] & _SIGN[data[1:]]) + 1
        starts, ends = edges(solid, bounds, cuts)
        ids, before = self.memo.ids(data, starts, ends)
        return ids, before[np.searchsorted(starts, bounds)]


@dataclass
class _Window:
    size: int
    pieces: list = field(default_factory=list)  # (document, start, length)
    used: int = 0

    def put(self, document: int, start: int, length: int) -> None:
        self.pieces.append((document, start, length))
        self.used += length


class _Shelf:
    """Pieces waiting to be placed, by length."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = sorted((length, document, start) for document, start, length in pieces)

    def __len__(self) -> int:
        return len(self.pieces)

    def longest(self) -> tuple[int, int, int]:
        length, document, start = self.pieces.pop()
        return document, start, length

    def fitting(self, gap: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``gap``."""
        i = bisect.bisect_right(self.pieces, (gap, 1 << 62, 1 << 62)) - 1
        if i < 0:
            return None
        length, document, start = self.pieces.pop(i)
        return document, start, length

    def back(self, document: int, start: int, length: int) -> None:
        bisect.insort(self.pieces, (length, document, start))


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[_Window]:
    """Windows that hold every token of documents of these lengths exactly once."""
    tiers = tuple(sorted(tiers, reverse=True))
    window, windows = tiers[0], []
    routed: dict[int, list] = {t: [] for t in tiers}
    for document, length in enumerate(lengths):
        whole = length // window
        for k in range(whole):
            windows.append(_Window(window))
            windows[-1].put(document, k * window, window)
        rest = length - whole * window
        if rest:
            tier = next(t for t in reversed(tiers) if rest <= t)
            routed[tier].append((document, whole * window, rest))
    shelves = {t: _Shelf(pieces) for t, pieces in routed.items()}
    for i, tier in enumerate(tiers):
        own, shorter = shelves[tier], [shelves[t] for t in tiers[i + 1:]]
        while len(own):
            opened = _Window(tier)
            opened.put(*own.longest())
            # Fill the gap with whole pieces of the shorter tiers, then with a part of one.
            for shelf in [*shorter, own]:
                while opened.used < tier and (piece := shelf.fitting(tier - opened.used)):
                    opened.put(*piece)
            gap = tier - opened.used
            donor = next((s for s in [own, *shorter] if len(s)), None) if gap else None
            if donor is not None:
                document, start, length = donor.longest()
                if length > gap:
                    opened.put(document, start, gap)
                    rest = (document, start + gap, length - gap)
                    shelves[next(t for t in reversed(tiers) if rest[2] <= t)].back(*rest)
                else:
                    donor.back(document, start, length)
            if opened.used == tier:
                windows.append(opened)
                continue
            # Nothing is left that could fill this window: its pieces go to shorter tiers.
            windows += _shortened(opened, tiers)
            break
    return windows


def _shortened(opened: _Window, tiers: tuple[int, ...]) -> list[_Window]:
    """The tokens of a window that stays open, in full windows of shorter tiers and one last padded window."""
    out, left = [], opened.used
    pieces = list(reversed(opened.pieces))
    while left:
        size = next((t for t in tiers if t <= left), tiers[-1])
        target = _Window(size)
        while target.used < size and pieces:
            document, start, length = pieces.pop()
            taken = min(length, size - target.used)
            target.put(document, start, taken)
            if taken < length:
                pieces.append((document, start + taken, length - taken))
        left -= target.used
        out.append(target)
    return out


def step_groups(sizes: list[int], group_tokens: int) -> list[int]:
    """A group for each window: windows of one length side by side, ``group_tokens`` tokens a group."""
    out = [0] * len(sizes)
    filled = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = filled // group_tokens
        filled += sizes[i]
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = 8 * 2048,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``sequence_id`` and ``step_group`` are unique over all partitions. A null
    text is an empty text: its document holds the end id alone. Rows with
    equal ids are packed each on its own; a null id stays null; an empty table
    gives no rows. Texts are never cut before they are tokenized; a text of any
    length is one document. Other columns are not read. ``with_ids=False``
    leaves the ids of the pieces null.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(tokenizer_path)
        names: list = []
        ids, lengths = [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            data, bounds = text_bytes(batch.column(1))
            for first, last in text_groups(bounds, TEXT_AT_A_TIME):
                got, at = tokenizer.ids(data[bounds[first]:bounds[last]], bounds[first: last + 1] - bounds[first])
                count = np.diff(at)
                # The end id follows the ids of each document.
                out = np.full(len(got) + len(count), end_id, dtype="<i4")
                out[ragged(at[:-1] + np.arange(len(count)), count)] = got
                ids.append(out)
                lengths += (count + 1).tolist()
        if not names:
            return
        flat = np.concatenate(ids)
        begin = np.cumsum([0, *lengths])
        windows = plan_windows(lengths, tiers)
        groups = step_groups([w.size for w in windows], group_tokens)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) * SEQUENCES_PER_PARTITION
        rows: list[tuple] = []
        for number, (w, group) in enumerate(zip(windows, groups)):
            offset = 0
            for document, start, length in w.pieces:
                own = flat[begin[document] + start: begin[document] + start + length]
                rows.append((
                    names[document], start, length, zlib.crc32(own.tobytes()), lengths[document],
                    base + number, offset, w.size, base + group, own if with_ids else None,
                ))
                offset += length
            if len(rows) >= 20_000:
                yield _piece_batch(rows)
                rows = []
        if rows:
            yield _piece_batch(rows)

    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(pack, SCHEMA)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
