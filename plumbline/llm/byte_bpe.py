"""Byte-level BPE: exact merges in linear time, and back to bytes.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over
strings can hold the vocabulary. For a piece of text the automaton gives the
longest token at every position in one pass. The encoder takes longest tokens
from left to right, shortens a token that cannot stand beside the one before, and
steps back when no token is left; a position found to be dead is never tried
again. Whether two tokens can stand side by side depends on nothing but the two
and is remembered: it holds when undoing their merges, latest first, shows no
pair across the border that would have been merged earlier.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.expressions import col
from plumbline.llm.bytesops import IS_SPACE, ragged, text_bytes, text_groups
from plumbline.llm.pieces import PieceMemo

TEXT_AT_A_TIME = 2 << 20
# The pattern whose matches are encoded one by one.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Remembered pairs of tokens; the memory starts anew beyond.
PAIRS = 2_000_000

_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[:128] = _SIGN
_KIND[IS_SPACE] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT


class BytePairs:
    """A vocabulary of byte strings by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.token: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = [len(t) for t in self.token]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self.left = list(range(size))
        self.right = list(range(size))
        # A token's last merge, found in the order of the ranks, as it needs those of its parts only.
        for rank, token in enumerate(self.token):
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._undone(a, b, rank):
                    self.left[rank], self.right[rank] = a, b
                    break
        self.shorter = [
            next((r for n in range(len(t) - 1, 0, -1) if (r := ranks.get(t[:n])) is not None), None) for t in self.token
        ]

    def _undone(self, a: int, b: int, limit: int) -> bool:
        """Whether no pair across the border of a and b merges before ``limit`` while both are taken apart."""
        ranks, token, left, right = self.ranks, self.token, self.left, self.right
        while True:
            across = ranks.get(token[a] + token[b])
            if across is not None and across < limit:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            # The later of the two last merges is undone; of equal merges the left one came first.
            if not whole_a and (whole_b or a > b):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def fit(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is a, b."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            known = self._fits[a, b] = self._undone(a, b, 1 << 62)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        length, fit, shorter = self.length, self.fit, self.shorter
        longest: list[int | None] = [None] * len(piece)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length[rank]
            if longest[start] is None or length[longest[start]] < length[rank]:
                longest[start] = rank
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + length[token]
            if not dead[end] and (not out or fit(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else None
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def plain_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's matches in texts of ASCII and Latin letters; bounds as in ``text_bytes``."""
    if len(data) == 0:
        none = np.empty(0, dtype=np.int64)
        return none, none
    kind = _KIND[data]
    kind[kind == _OTHER] = _LETTER
    begins = np.ones(len(data), dtype=bool)
    begins[1:] = kind[1:] != kind[:-1]
    text_start = np.zeros(len(data) + 1, dtype=bool)
    text_start[bounds] = True
    begins |= text_start[:-1]
    # The last character of white space before a word: a space joins the word, others stand alone.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~text_start[1:-1])
    begins[last] = True
    joined = last[data[last] == 32] + 1
    begins[joined] = False
    # A sign run that is one apostrophe with no space joined to it may open a contraction.
    quote = np.flatnonzero((data[:-1] == 39) & begins[:-1] & (kind[1:] == _LETTER) & begins[1:] & ~text_start[1:-1])
    if len(quote):
        limit = np.append(bounds, len(data))
        stop = limit[np.searchsorted(limit, quote, side="right")]
        for q, s in zip(quote.tolist(), stop.tolist()):
            after = data[q + 1: min(q + 3, s)].tobytes().decode("latin-1")
            ending = next((c for c in CONTRACTIONS if after.startswith(c)), None)
            if ending:
                begins[q + 1] = False
                if q + 1 + len(ending) < len(data):
                    begins[q + 1 + len(ending)] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], len(data))


class ByteTokenizer:
    """Encodes and decodes whole texts; one for each vocabulary file and worker."""

    _loaded: dict[tuple[str, str], "ByteTokenizer"] = {}

    @classmethod
    def load(cls, path: str, pattern: str = PATTERN) -> "ByteTokenizer":
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(load_ranks(path), pattern)
        return cls._loaded[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pairs = BytePairs(ranks)
        self.pattern = regex.compile(pattern)
        self.plain = pattern == PATTERN
        self.memo = PieceMemo(self.pairs.encode_piece)
        lengths = np.array(self.pairs.length, dtype=np.int64)
        self.token_lengths = lengths
        self.token_starts = np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.pairs.token), dtype=np.uint8)

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _KIND[data]
        lead = np.zeros(len(data), dtype=bool)
        # Two bytes 0xC3 0x80-0xBF are a Latin letter, but for the times and division signs.
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        odd = kind == _OTHER
        odd &= ~lead
        odd[1:] &= ~lead[:-1]
        # ASCII control characters are left to the pattern as well.
        odd |= (data < 32) & ~IS_SPACE[data]
        where = np.flatnonzero(odd)
        if len(where) == 0 and self.plain:
            return plain_pieces(data, bounds)
        texts = np.unique(np.searchsorted(bounds, where, side="right") - 1) if self.plain else np.arange(len(bounds) - 1)
        strange = np.zeros(len(bounds) - 1, dtype=bool)
        strange[texts] = True
        starts, ends = [], []
        # Runs of plain texts together, every other text by the pattern itself.
        i = 0
        while i < len(strange):
            j = i
            while j < len(strange) and not strange[j]:
                j += 1
            if j > i:
                a, b = plain_pieces(data[bounds[i]:bounds[j]], bounds[i: j + 1] - bounds[i])
                starts.append(a + bounds[i])
                ends.append(b + bounds[i])
                i = j
                continue
            at, own = int(bounds[i]), []
            for m in self.pattern.findall(data[bounds[i]:bounds[i + 1]].tobytes().decode()):
                own.append(len(m.encode()))
            lengths = np.array(own, dtype=np.int64)
            ends.append(at + np.cumsum(lengths))
            starts.append(ends[-1] - lengths)
            i += 1
        return np.concatenate(starts), np.concatenate(ends)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the bounds of the texts among them."""
        starts, ends = self._pieces(data, bounds)
        ids, before = self.memo.ids(data, starts, ends)
        return ids, before[np.searchsorted(starts, bounds)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        return self.token_bytes[ragged(self.token_starts[ids], self.token_lengths[ids])]


def encode_documents(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, digests: bool = False,
) -> DataFrame:
    """Ids of every whole text: doc_id, n_tokens, ids (array of int), one row per input row.

    A null text is an empty text and has no ids. Nulls and repeats in the id
    column pass through, other columns are not read, an empty table gives no
    rows. Every match of ``pattern`` is encoded by itself and special tokens are
    ordinary text. With ``digests`` the ids are decoded again, and the rows hold
    ids_sha256 and decoded_sha256 (lower-case hex) in place of the ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer.load(ranks_path, pattern)
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for first, last in text_groups(bounds, TEXT_AT_A_TIME):
                ids, at = tokenizer.encode(data[bounds[first]:bounds[last]], bounds[first: last + 1] - bounds[first])
                names, counts = batch.column(0).slice(first, last - first), pa.array(np.diff(at))
                if not digests:
                    lists = pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(ids, type=pa.int32()))
                    yield pa.RecordBatch.from_arrays([names, counts, lists], ["doc_id", "n_tokens", "ids"])
                    continue
                plain = ids.astype("<u4")
                text = tokenizer.decode(ids)
                spans = np.concatenate([[0], np.cumsum(tokenizer.token_lengths[ids])])[at]
                yield pa.RecordBatch.from_arrays([
                    names, counts,
                    pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], type=pa.string()),
                    pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(spans[:-1], spans[1:])], type=pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    picked = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(encode, f"doc_id long, n_tokens long, {rest}")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of arrays of ids: doc_id and decoded (binary); null ids give null, an empty array no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteTokenizer.load(ranks_path)
        for batch in batches:
            texts = [None if ids is None else tokenizer.decode(np.array(ids, dtype=np.int64)).tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.binary())], ["doc_id", "decoded"])

    return encoded.select(col(id_col).cast("long").alias("doc_id"), col(ids_col).alias("ids")).mapInArrow(
        decode, "doc_id long, decoded binary"
    )
