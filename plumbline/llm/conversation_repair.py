"""Conversations whose roles do not follow the grammar, repaired by a generalised LR parser.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials: an optional system turn, then pairs of
user and assistant turns. The grammar is turned into LR tables. The parser's stacks are a graph of shared nodes:
every row offers weighted actions (keep, rerole, delete, and inserting a turn before it), all of them are followed
side by side, and where two stacks end in the same state the one with the smaller (cost, audit) stays. That loses
nothing: what may follow depends on the state alone here, costs add up, and of two audits of equal cost over the
same rows neither begins the other, as another insertion costs.

Repeated rows are counted and the first use of a text is found by grouping, spread over all tasks. A conversation's rows
then pass through one task in order, as a stream: the part of the audit on which all stacks agree is settled, its
turns are passed on, and no more is held than the few turns that are still open. So a conversation of any length
takes bounded memory (but for the audit of the report, a letter a row); its digest, one hash over all its text, cannot be computed in parts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import col
from plumbline.functions.storage import stored

# The costs of the edits, what ends a sentence, what counts as blank.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
STOPS, SPACES = ".!?", " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}

# C is a conversation, T its turns, P a pair; "$" is the end.
START = "C"
GRAMMAR = [("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("P",)), ("T", ("T", "P")), ("P", ("u", "a"))]
END = "$"

# From any stack two insertions and the deletion of a system turn lead to whatever another stack can still lead to, so
# a stack that is further behind the cheapest is never the cheapest in the end.
FURTHEST = 2 * INSERT + DELETE

OPEN_LETTERS = 64  # letters of an audit after which the settled part is passed on
EVENTS_PER_BATCH = 2000


class Tables:
    """LR tables of a grammar: item sets, and for each state and next symbol all shifts and reductions."""

    def __init__(self, grammar: list[tuple[str, tuple[str, ...]]], start: str):
        self.grammar = [("", (start,)), *grammar]
        self.names = {left for left, _ in self.grammar}
        follow = self._follow()
        first = self._closed(frozenset({(0, 0)}))
        states, self.go = {first: 0}, {}
        queue = [first]
        for items in queue:
            for symbol in sorted({r[at] for rule, at in items if at < len(r := self.grammar[rule][1])}):
                moved = self._closed(frozenset((rule, at + 1) for rule, at in items if self.grammar[rule][1][at: at + 1] == (symbol,)))
                if moved not in states:
                    states[moved] = len(states)
                    queue.append(moved)
                self.go[states[items], symbol] = states[moved]
        self.accepting = {n for items, n in states.items() if (0, 1) in items}
        self.reductions: dict[tuple[int, str], list[int]] = {}
        for items, n in states.items():
            for rule, at in items:
                left, right = self.grammar[rule]
                if rule and at == len(right):
                    for symbol in follow[left]:
                        self.reductions.setdefault((n, symbol), []).append(rule)

    def _closed(self, items: frozenset) -> frozenset:
        found, queue = set(items), list(items)
        for rule, at in queue:
            wanted = self.grammar[rule][1][at: at + 1]
            new = {(i, 0) for i, (left, _) in enumerate(self.grammar) if (left,) == wanted} - found
            found |= new
            queue += new
        return frozenset(found)

    def _follow(self) -> dict[str, set[str]]:
        """What may stand after each name. Only the start symbol may be empty and it stands inside no rule."""
        first = {n: set() for n in self.names}
        follow = {n: {END} if n == "" else set() for n in self.names}
        for _ in range(len(self.grammar) + 1):
            for left, right in self.grammar:
                if right:
                    first[left] |= first.get(right[0], {right[0]})
                for here, after in zip(right, [*right[1:], None]):
                    if here in self.names:
                        follow[here] |= follow[left] if after is None else first.get(after, {after})
        return follow


@dataclass(eq=False)
class Stack:
    """A node of the stack graph: a state on top of another node. Equal nodes are one object."""

    state: int
    below: "Stack | None"
    above: dict[int, "Stack"] = field(default_factory=dict)
    moves: dict[str, list["Stack"]] = field(default_factory=dict)

    def push(self, state: int) -> "Stack":
        if state not in self.above:
            self.above[state] = Stack(state, self)
        return self.above[state]


class Parser:
    """Weighted edits on top of the tables."""

    def __init__(self) -> None:
        self.tables = Tables(GRAMMAR, START)
        self.terminals = {symbol for _, right in GRAMMAR for symbol in right} - self.tables.names
        self.bottom = Stack(0, None)

    def after(self, top: Stack, symbol: str) -> list[Stack]:
        """The stacks after all reductions that the symbol allows and its shift; at the end, the accepting ones."""
        if symbol not in top.moves:
            found = [top] if symbol == END and top.state in self.tables.accepting else []
            shifted = self.tables.go.get((top.state, symbol))
            if shifted is not None:
                found.append(top.push(shifted))
            for rule in self.tables.reductions.get((top.state, symbol), ()):
                left, right = self.tables.grammar[rule]
                base = top
                for _ in right:
                    base = base.below
                found += self.after(base.push(self.tables.go[base.state, left]), symbol)
            top.moves[symbol] = found
        return top.moves[symbol]


@cache
def _parser() -> Parser:
    return Parser()


class Repair:
    """The open repairs of one conversation: for each state on top of a stack the least (cost, audit)."""

    def __init__(self) -> None:
        self.parser = _parser()
        self.tops: dict[int, tuple[int, str, Stack]] = {0: (0, "", self.parser.bottom)}

    @staticmethod
    def _offer(tops: dict, cost: int, audit: str, stack: Stack) -> bool:
        best = tops.get(stack.state)
        if best is None or (cost, audit) < best[:2]:
            tops[stack.state] = (cost, audit, stack)
            return True
        return False

    def _with_insertions(self) -> dict[int, tuple[int, str, Stack]]:
        tops = dict(self.tops)
        queue = list(tops.values())
        for cost, audit, stack in queue:
            for symbol in ROLES:
                for after in self.parser.after(stack, symbol):
                    if self._offer(tops, cost + INSERT, audit + "I", after):
                        queue.append(tops[after.state])
        return tops

    def row(self, initial: str, must_go: bool, cut_short: bool) -> None:
        new: dict[int, tuple[int, str, Stack]] = {}
        extra = CUT_SHORT if cut_short else 0
        for cost, audit, stack in self._with_insertions().values():
            self._offer(new, cost + DELETE, audit + "D", stack)
            if must_go:
                continue
            if initial in self.parser.terminals:
                for after in self.parser.after(stack, initial):
                    self._offer(new, cost + extra, audit + "K", after)
            for symbol in ROLES:
                for after in self.parser.after(stack, symbol):
                    self._offer(new, cost + extra + REROLE, audit + "R", after)
        reach = min(cost for cost, _, _ in new.values()) + FURTHEST
        self.tops = {state: top for state, top in new.items() if top[0] <= reach}

    def settled(self) -> str:
        """The beginning on which all audits agree, taken away from them."""
        same = os.path.commonprefix([audit for _, audit, _ in self.tops.values()])
        self.tops = {s: (cost, audit[len(same):], stack) for s, (cost, audit, stack) in self.tops.items()}
        return same

    def open_letters(self) -> int:
        return max(len(audit) for _, audit, _ in self.tops.values())

    def end(self) -> tuple[int, str]:
        """Cost of the cheapest repair and the rest of its audit."""
        return min((cost, audit) for cost, audit, stack in self._with_insertions().values() if self.parser.after(stack, END))


class Conversation:
    """The turns of one conversation in order: what is wrong with them and, turn by turn, their repair."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.waiting: list[tuple[str, str]] = []
        self.last_initial = ""  # of the repaired turns
        self.before: str | None = None  # the initial of the row before
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> list[tuple[str, str, str]]:
        """The edits (letter, role, text) that are settled now."""
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        body = text.rstrip(SPACES)
        blank = not body
        cut_short = not blank and not repeated and body[-1] not in STOPS
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += cut_short
        self.waiting.append((role, text))
        self.repair.row(initial, blank or repeated, cut_short)
        return self._edits(self.repair.settled()) if self.repair.open_letters() > OPEN_LETTERS else []

    def end(self) -> list[tuple[str, str, str]]:
        self.cost, rest = self.repair.end()
        return self._edits(rest)

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns

    def _edits(self, letters: str) -> list[tuple[str, str, str]]:
        out, used = [], 0
        for letter in letters:
            if letter == "I":
                role, text = "", ""
            else:
                role, text = self.waiting[used]
                used += 1
            if letter in "IR":
                role = ROLES["a" if self.last_initial == "u" else "u"]
            if letter != "D":
                self.last_initial = role[0]
            out.append((letter, role, text))
        del self.waiting[:used]
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation id, its Conversation, settled edits, ended) in order, as rows arrive."""
    name, talk = None, None
    for id_, turn, role, text, copies, first in _rows(batches):
        if talk is None or id_ != name:
            if talk is not None:
                yield name, talk, talk.end(), True
            name, talk = id_, Conversation()
        for copy in range(copies):
            edits = talk.add(turn, role, text, repeated=not first or copy > 0)
            if edits:
                yield name, talk, edits, False
    if talk is not None:
        yield name, talk, talk.end(), True


def _in_order(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None) -> DataFrame:
    """The rows of every conversation side by side and in order: equal ones counted, the first use of a text marked."""
    counted = (
        turns.select(
            col(id_col).alias("id"), col(turn_col).cast("long").alias("turn"),
            F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"),
            (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
        )
        .groupBy("id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
        .withColumn("digest", F.sha2("text", 256))
    )
    counted = stored(counted)
    # Nulls come first among the turns.
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = counted.groupBy(
        F.col("id").alias("first_id"), F.col("role").alias("first_role"), F.col("digest").alias("first_digest")
    ).agg(F.min(order)["turn"].alias("first_turn"))
    same = (
        F.col("id").eqNullSafe(F.col("first_id")) & (F.col("role") == F.col("first_role")) & (F.col("digest") == F.col("first_digest"))
    )
    marked = counted.join(firsts, same).select(
        "id", "turn", "role", "text", "copies", F.col("turn").eqNullSafe(F.col("first_turn")).alias("first")
    )
    return marked.repartition("id").sortWithinPartitions(F.col("id"), F.col("turn").asc_nulls_first(), "role", "text")


def repair_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies: Column | None = None,
) -> DataFrame:
    """The repaired turns: (id, place, edit, role, text), places from 0 and without gaps.

    A conversation's rows are taken by turn, nulls first, equal turns by role and text. ``edit`` is K for a kept
    turn, R for one with a new role, I for an inserted, empty one; deleted rows are not returned. Blank rows and
    later rows with a role and text seen before are always deleted. A null role or text counts as one space, an empty
    role has no initial and is never kept. Rows without a conversation id are one conversation. ``copies`` says how
    often a row stands there. An empty table, and a conversation of which nothing is left, give no rows. Other columns are not read.
    """
    rows = _in_order(turns, id_col, turn_col, role_col, text_col, copies)
    kind = turns.select(col(id_col)).schema[0].dataType
    schema = f"id {kind.simpleString()}, place long, edit string, role string, text string"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, shape = [], 0, None
        for name, _, edits, ended in _conversations(_typed(batches, kinds := [])):
            shape = kinds[0]
            for letter, role, text in edits:
                if letter != "D":
                    held.append((name, place, letter, role, text))
                    place += 1
            place = 0 if ended else place
            if len(held) >= EVENTS_PER_BATCH:
                yield _batch(held, ["id", "place", "edit", "role", "text"], shape)
                held = []
        if held:
            yield _batch(held, ["id", "place", "edit", "role", "text"], shape)

    return rows.mapInArrow(emit, schema).withColumnRenamed("id", id_col)


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def conversation_report(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies: Column | None = None,
) -> DataFrame:
    """One row per conversation with any rows: its id, ``gaps`` in the turn numbers, the numbers of ``blank``, ``duplicate``
    and ``truncated`` rows, of ``illegal`` neighbours, ``cost`` and ``audit`` of the repair, and ``repaired_sha256`` over the
    repaired turns as ``role:text``, joined by a line feed. Odd rows as in ``repair_conversations``."""
    rows = _in_order(turns, id_col, turn_col, role_col, text_col, copies)
    kind = turns.select(col(id_col)).schema[0].dataType
    schema = f"id {kind.simpleString()}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string"
    columns = ["id", *REPORT, "audit", "repaired_sha256"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audit, digest, shape = [], [], hashlib.sha256(), None
        separator = ""
        for name, talk, edits, ended in _conversations(_typed(batches, kinds := [])):
            shape = kinds[0]
            audit.append("".join(letter for letter, _, _ in edits))
            for letter, role, text in edits:
                if letter != "D":
                    digest.update(f"{separator}{role}:{text}".encode())
                    separator = "\n"
            if ended:
                held.append((name, *(getattr(talk, c) for c in REPORT), "".join(audit), digest.hexdigest()))
                audit, digest, separator = [], hashlib.sha256(), ""
                if len(held) >= EVENTS_PER_BATCH:
                    yield _batch(held, columns, shape)
                    held = []
        if held:
            yield _batch(held, columns, shape)

    return rows.mapInArrow(emit, schema).withColumnRenamed("id", id_col)


def _typed(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    """The batches; the type of the ids is left in ``kinds``."""
    for batch in batches:
        kinds[:] = [batch.column(0).type]
        yield batch


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"id": id_type, "edit": pa.string(), "role": pa.string(), "text": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=kinds.get(n, pa.int64())) for n, values in zip(names, zip(*rows))], names
    )
