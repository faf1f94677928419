"""Frequent phrases and collocations, found by Rabin-Karp fingerprints of word n-grams.

Documents become blocks: the words of some texts of one language, as numbers into the block's own vocabulary, with a
mark between pieces. A block is written once and never changes, so (block, place) points to an occurrence for good.
Prefix polynomials give the fingerprints of all n-grams of a block; a block passes on each distinct one once, with its
count, the place of one occurrence and 32 bits of a second polynomial over other word hashes, after comparing the words of all its
occurrences with those at that place. Spark adds up the counts by fingerprint. Different phrases with one fingerprint only
raise a total, so no frequent phrase is lost; they are told by the second polynomial, and then all their blocks write their phrase
out and counts by the text itself are final. Any other frequent phrase is written out once, by the block that its pointer names.

A phrase cannot be more frequent than its parts. So the words are counted first, then pairs of frequent words, then
longer runs of frequent pairs, and only a small part of all n-grams is ever sent. Nothing is broadcast or collected:
a task holds one block and the rows about it, or rows sorted by fingerprint, of which each block sends one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored
from plumbline.llm.blocks import pack_numbers, unpack_numbers
from plumbline.llm.bytesops import Hashing, edges, mixed, ragged, text_bytes

# The bytes that end a piece, those that stand between words, the language of a null.
PIECE_ENDS, BLANKS, NO_LANGUAGE = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09", "und"

# Bytes of text in a block; a longer document is a block alone.
BLOCK_BYTES = 5 << 20
COMPARED = 1 << 18  # words compared at a time
PARTS = 64  # of a language when its phrases are ranked

BLOCK = "block long, lang string, words long, vocabulary binary, stream binary"
# ``mark`` holds the 32 bits of the second polynomial above the place of the occurrence.
FOUND = "fingerprint long, mark long, size int, n long, block long"
NO_ROWS = {"fingerprint": pa.int64(), "mark": pa.int64(), "size": pa.int32(), "n": pa.int64(), "block": pa.int64()}
FINGERPRINT_BITS = 64

ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[list(PIECE_ENDS)] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[list(BLANKS)] = False
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


@cache
def _hashing(seed: int = 71) -> Hashing:
    return Hashing(seed)


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether word i reads the same as word others[i]."""
    lengths = ends - starts
    same = lengths == lengths[others]
    for first in range(0, len(starts), COMPARED):
        some = slice(first, first + COMPARED)
        at = np.flatnonzero(same[some]) + first
        size = lengths[at]
        differ = data[ragged(starts[at], size)] != data[ragged(starts[others[at]], size)]
        bounds = np.concatenate([[0], np.cumsum(size)])
        wrong = np.searchsorted(bounds, np.flatnonzero(differ), side="right") - 1
        same[at[wrong]] = False
    return same


def _block(number: int, lang: str, texts: list[tuple[np.ndarray, np.ndarray]]) -> dict | None:
    """A block row of texts given as bytes and bounds."""
    data = LOWERED[np.concatenate([d for d, _ in texts])]
    shifts = np.cumsum([0, *[len(d) for d, _ in texts]])
    bounds = np.concatenate([[0], *[b[1:] + s for (_, b), s in zip(texts, shifts)]]).astype(np.int64)
    starts, ends = edges(IN_WORD[data], bounds)
    if len(starts) == 0:
        return None
    hashes = _hashing().words(data, starts, ends)
    names, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    # Another word with the hash of the first one gets a number of its own.
    odd: dict[bytes, int] = {}
    for i in np.flatnonzero(~_same_bytes(data, starts, ends, first[ids])):
        ids[i] = odd.setdefault(data[starts[i]: ends[i]].tobytes(), len(names) + len(odd))
    vocabulary = [data[starts[i]: ends[i]].tobytes() for i in first] + list(odd)
    # Frequent words get small numbers, which compress well; 0 is the mark between pieces.
    count = np.bincount(ids, minlength=len(vocabulary))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    # A piece ends between two words if a byte that ends pieces or the end of a text lies there.
    ended = np.searchsorted(np.flatnonzero(ENDS_PIECE[data]), starts)
    text = np.searchsorted(bounds, starts, side="right")
    cut = np.zeros(len(starts), dtype=bool)
    cut[1:] = (ended[1:] != ended[:-1]) | (text[1:] != text[:-1])
    stream = np.zeros(len(starts) + int(cut.sum()), dtype=np.uint32)
    stream[np.arange(len(starts)) + np.cumsum(cut)] = rank[ids]
    return {
        "block": number, "lang": lang, "words": len(starts),
        "vocabulary": b" ".join(vocabulary[i] for i in order), "stream": pack_numbers(stream),
    }


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Texts gathered by language, up to a block's size each."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}
    made = 0
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("vocabulary", pa.binary()), ("stream", pa.binary())])

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal made
        row = _block((TaskContext.get().partitionId() << 32) + made, lang, held.pop(lang))
        sizes.pop(lang)
        made += 1
        if row is not None:
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        codes = batch.column("lang").dictionary_encode()
        index = codes.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(codes.dictionary.to_pylist()):
            data, bounds = text_bytes(batch.column("text").take(pa.array(np.flatnonzero(index == code))))
            first = 0
            while first < len(bounds) - 1:
                room = block_bytes - sizes.get(lang, 0)
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + room, side="right")) - 1)
                held.setdefault(lang, []).append((data[bounds[first]: bounds[last]], bounds[first: last + 1] - bounds[first]))
                sizes[lang] = sizes.get(lang, 0) + int(bounds[last] - bounds[first])
                first = last
                if sizes[lang] >= block_bytes or first < len(bounds) - 1:
                    yield from flush(lang)
    for lang in list(held):
        yield from flush(lang)


class Words:
    """A block read again."""

    def __init__(self, row: dict):
        self.block, self.lang = row["block"], row["lang"]
        self.names = row["vocabulary"].split(b" ")
        self.stream = unpack_numbers(row["stream"]).astype(np.int64)

    def hashes(self) -> list[np.ndarray]:
        """Two hashes of the word at each place; of the marks too, but those are never used."""
        lengths = np.array([len(n) for n in self.names], dtype=np.int64)
        data = np.frombuffer(b"".join(self.names), dtype=np.uint8)
        ends = np.cumsum(lengths)
        own = [_hashing(seed).words(data, ends - lengths, ends) for seed in (71, 72)]
        return [np.concatenate([np.zeros(1, dtype=np.uint64), h])[self.stream] for h in own]

    def counted(self, hashes: list[np.ndarray], size: int, places: np.ndarray, bits: int) -> pa.Table:
        """The distinct n-grams at these places: fingerprint, proof, count, and the first place."""
        salt = xxhash.xxh64_intdigest(self.lang.encode(), size)
        prints = mixed(_hashing(71).runs(hashes[0], size)[places], salt) >> np.uint64(64 - bits)
        names, first, back, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        at = places[first]
        # The words of every occurrence are compared with those at the first place.
        differ = np.zeros(len(places), dtype=bool)
        for k in range(size):
            differ |= self.stream[places + k] != self.stream[at[back] + k]
        if differ.any():
            n = np.bincount(back[~differ], minlength=len(names))
            others: dict[tuple, list] = {}
            for i in np.flatnonzero(differ):
                key = tuple(self.stream[places[i]: places[i] + size].tolist())
                others.setdefault(key, [prints[i], 0, places[i]])[1] += 1
            more = list(others.values())
            names = np.concatenate([names, np.array([m[0] for m in more], dtype=np.uint64)])
            n = np.concatenate([n, [m[1] for m in more]])
            at = np.concatenate([at, [m[2] for m in more]])
        proof = _hashing(72).runs(hashes[1], size)[at] >> np.uint64(32) << np.uint64(32)
        return pa.table({
            "fingerprint": names.view(np.int64), "mark": (proof | at.astype(np.uint64)).view(np.int64),
            "size": pa.array(np.full(len(names), size, dtype=np.int32)),
            "n": n.astype(np.int64), "block": np.full(len(names), self.block, dtype=np.int64),
        })


def _single_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words = Words(row)
            yield from words.counted(words.hashes(), 1, np.flatnonzero(words.stream), bits).to_batches()


def _longer(sizes: range, bits: int):
    """N-grams of these sizes whose parts of one word (for pairs) or two words (for longer ones) are all frequent."""

    def find(blocks: pa.Table, frequent: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in NO_ROWS.items()})
        if len(blocks) == 0 or len(frequent) == 0:
            return empty
        words = Words(blocks.to_pylist()[0])
        at = frequent.column("at").to_numpy().astype(np.int64)
        if sizes[0] == 2:
            good = np.zeros(len(words.names) + 1, dtype=bool)
            good[words.stream[at]] = True
            fits = good[words.stream]
        else:
            base = len(words.names) + 1
            pairs = words.stream[:-1] * base + words.stream[1:]
            fits = np.isin(pairs, pairs[at])
        hashes = words.hashes()
        found = []
        run = fits
        for size in sizes:
            # Of the run one shorter, at this place and at the next one.
            run = run[:-1] & run[1:]
            found.append(words.counted(hashes, size, np.flatnonzero(run), bits))
        return pa.concat_tables([empty, *found])

    return find


def _written(blocks: pa.Table, named: pa.Table) -> pa.Table:
    """The phrases at the places of a block, with their counts."""
    if len(blocks) == 0 or len(named) == 0:
        return pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "size": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    words = Words(blocks.to_pylist()[0])
    phrases = [
        b" ".join([words.names[i - 1] for i in words.stream[at: at + size].tolist()]).decode()
        for size, at in zip(named.column("size").to_pylist(), named.column("at").to_pylist())
    ]
    return pa.table({
        "lang": pa.array([words.lang] * len(phrases)), "phrase": pa.array(phrases, pa.string()),
        "size": named.column("size"), "n": named.column("n"),
    })


def _frequent(found: DataFrame, least: int) -> DataFrame:
    """(block, at, size, n, named) of the fingerprints that reach the count in all blocks together; of each, every block has sent a row.

    ``named`` rows are to be written out: one for each fingerprint with the total as ``n``, any row by a hash; or
    all of a fingerprint with several phrases, each with its own count.
    """
    own = Window.partitionBy("fingerprint")
    proof = F.shiftright("mark", 32)
    # Dealt out first, so that what is worked out for the window does not travel.
    dealt = found.repartition("fingerprint").select("*", F.xxhash64("fingerprint", "block", "mark").alias("lot"))
    return stored(
        dealt.select(
            "*", F.sum("n").over(own).alias("total"), (F.min(proof).over(own) != F.max(proof).over(own)).alias("mixed"),
            (F.min("lot").over(own) == F.col("lot")).alias("first"),
        )
        .filter(F.col("total") >= least)
        .select(
            "block", F.col("mark").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"), "size",
            F.expr("if(mixed, n, total)").alias("n"), F.expr("mixed OR first").alias("named"),
        )
    )


def phrase_blocks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents as blocks of one language, written to the shared folder."""
    rows = docs.select(
        F.coalesce(col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return stored(rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), BLOCK))


def frequent_phrases(blocks: DataFrame, least: int = 100, longest: int = 5, fingerprint_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(lang, phrase, size, f): all phrases of up to ``longest`` words that occur at least ``least`` times, single words too.

    The counts are exact whatever the fingerprints; fewer bits of them make more work, not other results.
    """
    bits = fingerprint_bits
    by_block = blocks.groupBy("block")

    def about(frequent: DataFrame, function, schema: str) -> DataFrame:
        return by_block.cogroup(frequent.groupBy("block")).applyInArrow(function, schema)

    levels = [_frequent(blocks.mapInArrow(lambda batches: _single_words(batches, bits), FOUND), least)]
    if longest >= 2:
        levels.append(_frequent(about(levels[0].select("block", "at"), _longer(range(2, 3), bits), FOUND), least))
    if longest >= 3:
        levels.append(_frequent(about(levels[1].select("block", "at"), _longer(range(3, longest + 1), bits), FOUND), least))
    named = reduce(DataFrame.unionByName, levels).filter("named").select("block", "at", "size", "n")
    written = about(named, _written, "lang string, phrase string, size int, n long")
    counted = written.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("f"))
    return stored(counted.filter(F.col("f") >= least))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, scale: int = 1000,
    covered: int = 100, top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z) and split into pieces and words; a null text is empty, a null language is ``und``. n counts all words of
    the language, a the phrase, l and r the parts of its weakest cut, that of the smallest ``scale`` * a * n / (l * r), rounded
    down (of equal ones the earliest); whole numbers of 38 digits, beyond which Spark ends with an error. A phrase inside a
    longer frequent one that occurs ``covered`` per cent as often or more is left out. Higher scores come first, then
    larger a, then the phrase in byte order. Documents that share an id, or repeat, all count. An empty table, or one without
    frequent phrases, gives no rows. Other columns are not read.
    """
    blocks = phrase_blocks(docs, lang_col, text_col)
    known = frequent_phrases(blocks, least, longest)
    sizes = stored(blocks.groupBy("lang").agg(F.sum("words").alias("n")))
    candidates = known.filter("size >= 2").withColumnRenamed("f", "a")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail")
    )
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    scored = (
        cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(sizes, "lang")
        .withColumn("above", wide("a") * wide("n") * F.lit(scale).cast("decimal(38,0)"))
        .withColumn("below", wide("l") * wide("r"))
        .withColumn("score", F.expr("above div below"))
    )
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (
        candidates.filter("size >= 3")
        .select("lang", F.split("phrase", " ").alias("words"), "size", F.col("a").alias("f"))
        .select("lang", "words", "f", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("length"))
        .select("lang", "words", "f", "length", F.explode(F.expr("sequence(1, size - length + 1)")).alias("start"))
        .select("lang", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    kept = (
        weakest.join(inner, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
        .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    )
    # The best of each part of a language first, so that the last ranking of a language sees a bounded number of rows.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    ahead = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))
    parts = kept.select("*", part).repartition("lang", "part").withColumn("ahead", ahead).filter(F.col("ahead") <= top)
    return (
        parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
