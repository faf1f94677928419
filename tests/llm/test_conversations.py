"""Conversation repair against a search over all edits and a plain dynamic program."""

import heapq
import random
import re
import zlib
from itertools import product

import plain
from plumbline.llm.conversation_repair import GRAMMAR, OPEN_LETTERS, START, Conversation, Tables, conversation_report, repair_conversations
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SOUND = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\v\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by a best-first search over (rows used, what the roles so far allow)."""
    marks = faults(rows)
    # 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, 0, [])], set()
    while heap:
        cost, audit, used, state, out = heapq.heappop(heap)
        if used == len(rows) and state in (0, 3):
            return cost, audit, out
        if (used, state) in done:
            continue
        done.add((used, state))
        for initial, name in names.items():
            if (state, initial) in follow:
                heapq.heappush(heap, (cost + 5, audit + "I", used, follow[state, initial], [*out, (name, "")]))
        if used == len(rows):
            continue
        role, text = rows[used]
        heapq.heappush(heap, (cost + 2, audit + "D", used + 1, state, out))
        if marks[used] in ("blank", "duplicate"):
            continue
        extra = 5 if marks[used] == "truncated" else 0
        if (state, role[:1]) in follow:
            heapq.heappush(heap, (cost + extra, audit + "K", used + 1, follow[state, role[:1]], [*out, (role, text)]))
        for initial, name in names.items():
            if (state, initial) in follow:
                heapq.heappush(heap, (cost + extra + 1, audit + "R", used + 1, follow[state, initial], [*out, (name, text)]))


def report(turns):
    """What the report holds of (turn, role, text) rows."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    rows = [(role, text) for _, role, text in turns]
    numbers = [t for t, _, _ in turns if t is not None]
    marks = faults(rows)
    cost, audit, out = cheapest(rows)
    initials = [role[:1] for role, _ in rows]
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, plain.sha("\n".join(f"{r}:{t}" for r, t in out)),
    )


def streamed(rows):
    talk, seen, edits = Conversation(), set(), []
    for turn, (role, text) in enumerate(rows):
        edits += talk.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    edits += talk.end()
    return talk.cost, "".join(e for e, _, _ in edits), [(r, t) for e, r, t in edits if e != "D"]


def test_tables():
    tables = Tables(GRAMMAR, START)
    assert all(len(rules) == 1 for rules in tables.reductions.values()) and len(tables.accepting) == 1


def test_every_short_conversation():
    kinds = [("system", "Be kind."), ("user", "Why?"), ("assistant", "So."), ("user", "Why"), ("assistant", " "), ("", "x.")]
    for n in range(5):
        for chosen in product(range(len(kinds)), repeat=n):
            # Numbers keep the texts apart, but for the third kind, which repeats itself.
            rows = [(kinds[k][0], f"{i}{kinds[k][1]}" if k in (0, 1, 3, 5) else kinds[k][1]) for i, k in enumerate(chosen)]
            cost, audit, out = cheapest(rows)
            assert streamed(rows) == (cost, audit, out)
            assert SOUND.fullmatch("".join(r[0] for r, _ in out))


def test_long_conversations_are_settled_on_the_way():
    random.seed(4)
    for _ in range(30):
        rows = [(random.choice(["system", "user", "assistant", "tool", "C", "$"]), random.choice(["Yes.", f"No {i}", "", f"Well {i}!"])) for i in range(400)]
        assert streamed(rows) == cheapest(rows)
    talk = Conversation()
    for i in range(20_000):
        talk.add(i, "user" if i % 2 else "assistant", f"Text {i}.", False)
        assert len(talk.waiting) <= 2 * OPEN_LETTERS


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 5, "user", "Why?"), (1, None, "user", "Early."),
    (2, 0, "assistant", "Only."), (3, 0, None, None), (3, 1, "user", None), (None, 0, "user", "Nobody."), (None, 1, "assistant", "Knows"),
    (4, 7, "user", "Same."), (4, 7, "user", "Same."), (4, 7, "user", "Same."), (4, 8, "assistant", "x" * 100_000 + "."),
    (5, None, "user", "Hm."), (5, None, "assistant", "Oh."), (6, -3, "u", "İ ok."), (6, 9, "ass", "日本."), (7, 1, "", "Empty role."),
]


def grouped(rows):
    out = {}
    for id_, turn, role, text in rows:
        out.setdefault(id_, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def test_odd_conversations(spark):
    rows = [(*r, None, "x", i) for i, r in enumerate(ODD)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id long, first string, copies int")
    got = {r[0]: tuple(r[1:]) for r in conversation_report(table).collect()}
    want = {id_: report(turns) for id_, turns in grouped(ODD).items()}
    assert got == want
    repaired = {}
    for r in sorted(repair_conversations(table).collect(), key=lambda r: r.place):
        repaired.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.place == len(repaired[r.conv_id]) - 1 and r.edit in "KRI"
    assert {i: plain.sha("\n".join(repaired.get(i, []))) for i in want} == {i: w[-1] for i, w in want.items()}
    assert conversation_report(table.limit(0)).collect() == [] and repair_conversations(table.limit(0)).collect() == []


def test_many_batches(spark):
    table = spark.range(40_000).selectExpr(
        "'one' AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('Turn ', id, '.') AS text")
    row = conversation_report(table).first()
    assert (row.cost, row.audit) == (0, "K" * 40_000)
    assert repair_conversations(table).count() == 40_000


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for id_, turn, role, text in rows:
        fault = zlib.crc32(f"{id_}:{turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            damaged += [(id_, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    want = {id_: report(turns) for id_, turns in grouped(damaged).items()}
    none = (0, 0, 0, 0, 0, 0, "", plain.sha(""))
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_conversation_repair"](spark, FOLDER).collect()}
    assert got == {id_: want.get(id_, none) for id_ in {r[0] for r in rows}}
