"""Repair of the turns of conversations by least edits.

A repaired conversation is one system turn or none, then user and assistant in
turn, both as often. Reading turns, an automaton of four states tells what may come next:
nothing yet, after a system turn, after a user turn, after an assistant turn. Each
turn is kept, given the other role or deleted, and empty turns may be put before
it; the edits' initials, in order, are the audit, and of the cheapest audits the
ASCII-least is taken.

The search is divide and conquer. Up to a place in the middle, a vector of four gives each
state's least cost from the start, and the rank of its least audit; from the
end, another gives each state's least cost to the end. They meet: the states where
their sum is least are the optimal crossings, and the one of least rank is
the least audit's. (Put turns belong to the turn after them, so no audit of a half is the
beginning of another, and ranks decide.) Then either half is searched alone, from
state to state, with the turns themselves as the only memory.

A conversation may hold any share of all turns. Turns are sorted by range without
their texts and cut to chunks; a chunk sends its least costs and ranks from state to
state, vectors over the chunks of a conversation meet at every boundary, and
each chunk is searched by itself. Only the texts of a conversation pass through
one task at the end, one turn at a time.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runaudit.llm.common import stored, table

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs
DELETED, CUT, BLANK = 4, 8, 16  # bits of a turn's kind, beside the code of its role's initial
FAR = 1 << 40  # no way
APART = 16  # a state that costs more than another by this is on no cheapest path: 12 would do to follow it
CHUNK = 1 << 16  # turns searched in one task at once
_WORD = r"[^\x20\x09-\x0D]"

Vector = tuple[tuple[int, int], ...]  # cost and rank of each state


@cache
def put(state: int) -> tuple[tuple[int, int], ...]:
    """(turns put, state then): empty turns before a turn, or at the end."""
    after = (USER, USER, ASSISTANT, USER)
    return (0, state), (1, after[state]), (2, after[after[state]])


CLOSING = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # turns put at the end


@cache
def moves(kind: int, state: int) -> tuple[tuple[int, str, int], ...]:
    """(cost, audit, state then) of all ways past a turn of this kind, the best for each state."""
    out: dict[int, tuple[int, str]] = {}
    for k, at in put(state):
        ways = [(DELETE, "D", at)]
        if not kind & DELETED:
            extra, nxt = TRUNCATED * bool(kind & CUT), put(at)[1][1]
            own = kind & 3
            if own == nxt or own == SYSTEM and at == NONE:
                ways.append((extra, "K", own))
            ways.append((REROLE + extra, "R", nxt))
        for cost, letter, then in ways:
            new = INSERT * k + cost, "I" * k + letter
            out[then] = min(out.get(then, new), new)
    return tuple((cost, audit, then) for then, (cost, audit) in out.items())


@cache
def begin(state: int) -> Vector:
    return tuple((0, 0) if q == state else (FAR, 0) for q in range(4))


@cache
def onward(vector: Vector, kind: int) -> tuple[Vector, int]:
    """Costs and ranks after one more turn, and by how much the least cost grew."""
    best: dict[int, tuple[int, int, str]] = {}
    for p, (cost, rank) in enumerate(vector):
        if cost < FAR:
            for more, audit, q in moves(kind, p):
                new = cost + more, rank, audit
                best[q] = min(best.get(q, new), new)
    least = min(c for c, _, _ in best.values())
    order = sorted((rank, audit) for _, rank, audit in best.values())
    return tuple(
        (best[q][0] - least, order.index(best[q][1:])) if q in best and best[q][0] - least <= APART else (FAR, 0) for q in range(4)
    ), least


@cache
def back(costs: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """Costs to the end from before a turn, less the least of them, and that."""
    all_ = [min((c + costs[q] for c, _, q in moves(kind, p)), default=FAR) for p in range(4)]
    least = min(all_)
    return tuple(c - least if c < FAR else FAR for c in all_), least


def forward(kinds: bytes, vector: Vector) -> tuple[Vector, int]:
    total = 0
    for kind in kinds:
        vector, more = onward(vector, kind)
        total += more
    return vector, total


def crossing(ahead: Vector, behind: tuple[int, ...]) -> int:
    """The state of the least audit among the cheapest."""
    return min((cost + behind[q], rank, q) for q, (cost, rank) in enumerate(ahead))[2]


def search(kinds: bytes, start: int, end: int) -> str:
    """The least of the cheapest audits that lead past all turns from state to state."""
    if len(kinds) < 2:
        return min(((c, a) for k in kinds for c, a, q in moves(k, start) if q == end), default=(0, ""))[1]
    half = len(kinds) // 2
    behind = tuple(0 if q == end else FAR for q in range(4))
    for kind in reversed(kinds[half:]):
        behind, _ = back(behind, kind)
    meet = crossing(forward(kinds[:half], begin(start))[0], behind)
    return search(kinds[:half], start, meet) + search(kinds[half:], meet, end)


@lru_cache(1 << 14)
def search_short(kinds: bytes, start: int, end: int) -> str:
    return search(kinds, start, end)


def passage(kinds: bytes) -> tuple[list[int], list[int]]:
    """Costs and ranks of the ways past all turns, 4 states after each state before."""
    costs, ranks = [], []
    for p in range(4):
        vector, total = forward(kinds, begin(p))
        costs += [c + total if c < FAR else FAR for c, _ in vector]
        ranks += [r for _, r in vector]
    return costs, ranks


@lru_cache(1 << 14)
def passage_short(kinds: bytes) -> tuple[list[int], list[int]]:
    return passage(kinds)


def meetings(passages: list[tuple[list[int], list[int]]]) -> tuple[list[int], int]:
    """States before each chunk and after the last, and the cost of all."""
    ahead = [begin(NONE)]
    for costs, ranks in passages:
        best: dict[int, tuple[int, int, int]] = {}
        for p, (cost, rank) in enumerate(ahead[-1]):
            for q in range(4):
                if cost + costs[4 * p + q] < FAR:
                    new = cost + costs[4 * p + q], rank, ranks[4 * p + q]
                    best[q] = min(best.get(q, new), new)
        order = sorted(x[1:] for x in best.values())
        ahead.append(tuple((best[q][0], order.index(best[q][1:])) if q in best else (FAR, 0) for q in range(4)))
    behind = tuple(INSERT * CLOSING[q] for q in range(4))
    states = [crossing(ahead[-1], behind)]
    total = ahead[-1][states[0]][0] + behind[states[0]]
    for (costs, _), vector in zip(reversed(passages), reversed(ahead[:-1]), strict=True):
        behind = tuple(min(costs[4 * p + q] + behind[q] for q in range(4)) for p in range(4))
        states.append(crossing(vector, behind))
    return states[::-1], total


def illegal(kinds: bytes) -> int:
    """Neighbours whose initials may not follow one another."""
    code = np.frombuffer(kinds, np.uint8) & 3
    a, b = code[:-1], code[1:]
    return int(len(a) - ((b == USER) & ((a == SYSTEM) | (a == ASSISTANT)) | (a == USER) & (b == ASSISTANT)).sum())


def keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, h1, h2), nulls of role and text a space; h1 and h2 tell
    apart what is said by whom."""
    said = [F.coalesce(F.col(c), F.lit(" ")) for c in (role, text)]
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said[0].alias("role"), said[1].alias("text"))
    return named.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role")})


def order() -> list[Column]:
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def sorted_turns(rows: DataFrame) -> DataFrame:
    """Turns without texts, equal ones as one with their number, each with its
    kind, sorted by range."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(NONE)
    blank = ~F.col("text").rlike(_WORD)
    cut = F.coalesce(F.regexp_extract("text", rf"({_WORD})[\x20\x09-\x0D]*\z", 1), F.lit("")).rlike(r"[^.!?]")
    said = rows.select("conv", "turn", "role", "h1", "h2", code.alias("code"), blank.alias("blank"), cut.alias("cut"))
    once = said.groupBy("conv", "turn", "role", "h1", "h2").agg(
        F.max("code").alias("code"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.count(F.lit(1)).alias("m")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = (
        once.groupBy("conv", "h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("conv").alias("c"), F.col("h1").alias("a"), F.col("h2").alias("b"), "first")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
    again = ~F.col("blank") & F.coalesce(F.col("first") < place, F.lit(False))
    kind = (
        F.col("code")
        + F.when(F.col("blank") | again, DELETED).otherwise(0)
        + F.when(F.col("cut"), CUT).otherwise(0)
        + F.when(F.col("blank"), BLANK).otherwise(0)
    )
    marked = once.join(firsts, same, "left").select("conv", "turn", "role", "h1", "h2", kind.cast("int").alias("kind"), "m")
    return marked.repartitionByRange(*order()).sortWithinPartitions(*order())


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """One row per chunk of a conversation: its place in the sorted turns (part, no), the
    key of its first turn, the kinds of its turns, and what the ways past it cost."""
    turns = sorted_turns(rows)
    schema = turns.select("conv", "turn", "role", "h1", "h2").schema.add("part", "integer").add("no", "long").add("kinds", "binary")
    for c, kind in (("costs", T.ArrayType(T.LongType())), ("ranks", T.ArrayType(T.LongType())), ("turns", "long"), ("low", "long"), ("high", "long")):
        schema = schema.add(c, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        held: dict = {}
        out: dict[str, list] = {f.name: [] for f in schema}
        kinds = bytearray()

        def close() -> None:
            nonlocal no
            if not kinds:
                return
            raw = bytes(kinds)
            costs, ranks = (passage_short if len(raw) <= 64 else passage)(raw)
            row = {**held, "part": part, "no": no, "kinds": raw, "costs": costs, "ranks": ranks}
            for c, v in row.items():
                out[c].append(v)
            no += 1
            kinds.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in out.items()], names=list(out))
            for v in out.values():
                v.clear()
            return made

        last = object()
        types: dict = {}
        for batch in batches:
            if not types:
                longs, numbers = pa.int64(), pa.list_(pa.int64())
                types = {c: batch.schema.field(c).type for c in ("conv", "turn", "role", "h1", "h2")}
                types |= {"part": pa.int32(), "no": longs, "kinds": pa.binary(), "costs": numbers, "ranks": numbers, "turns": longs, "low": longs, "high": longs}
            for conv, turn, role, h1, h2, kind, m in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if conv != last:
                    close()
                    last = conv
                repeat = kind & ~CUT | DELETED
                for_now = 0
                while for_now < m:
                    if len(kinds) == size:
                        close()
                    if not kinds:
                        held = dict(conv=conv, turn=turn, role=role, h1=h1, h2=h2, turns=0, low=None, high=None)
                    if turn is not None and turn != held["high"]:
                        held["low"] = turn if held["low"] is None else held["low"]
                        held["high"], held["turns"] = turn, held["turns"] + 1
                    if not for_now:
                        kinds.append(kind)
                        for_now = 1
                    more = min(m - for_now, size - len(kinds))
                    kinds.extend(bytes([repeat]) * more)
                    for_now += more
            if len(out["no"]) >= 1024:
                yield flush()
        close()
        if types and out["no"]:
            yield flush()

    return turns.mapInArrow(cut, schema)


def joined(cut: DataFrame) -> DataFrame:
    """Per chunk (part, no) the states before and after it; on the last one of a
    conversation also the turns put at its end and the conversation's numbers."""
    fields = "part int, no long, start int, end int, closing int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def numbers() -> pa.RecordBatch:
            states, total = meetings([(r[3], r[4]) for r in rows])
            faults = np.zeros(3, np.int64)
            wrong, seen, low, high, code = 0, 0, None, None, b""
            for _, _, _, _, _, kinds, turns, a, z in rows:
                k = np.frombuffer(kinds, np.uint8)
                blank = (k & BLANK) > 0
                repeated = ((k & DELETED) > 0) & ~blank
                faults += blank.sum(), repeated.sum(), (((k & CUT) > 0) & ~blank & ~repeated).sum()
                wrong += illegal(kinds) + (illegal(code + kinds[:1]) if code else 0)
                code = kinds[-1:]
                if a is not None:
                    seen += turns - (a == high)
                    low, high = a if low is None else low, z
            gaps = min(high - low + 1 - seen, (1 << 63) - 1) if low is not None else 0
            n = len(rows)
            lastly = lambda v: [0] * (n - 1) + [int(v)]
            values = (CLOSING[states[-1]], gaps, *faults, wrong, total)
            names = ("closing", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            got = {c: pa.array(lastly(v), pa.int32() if c == "closing" else pa.int64()) for c, v in zip(names, values, strict=True)}
            made = {"part": pa.array([r[1] for r in rows], pa.int32()), "no": pa.array([r[2] for r in rows], pa.int64())}
            made |= {"start": pa.array(states[:-1], pa.int32()), "end": pa.array(states[1:], pa.int32())}
            return table(**made, **got)

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if rows and rows[0][0] != row[0]:
                    ready.append(numbers())
                    rows.clear()
                rows.append(row)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready.clear()
        if rows:
            yield numbers()

    narrow = cut.select("conv", "part", "no", "costs", "ranks", "kinds", "turns", "low", "high")
    return narrow.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInArrow(met, fields)


def edited(cut: DataFrame) -> DataFrame:
    """The chunks with the `edits` found for each, and the numbers of `joined`."""
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    keep = ["conv", "turn", "role", "h1", "h2", "part", "no"]
    both = cut.join(joined(cut), ["part", "no"]).select(*keep, *numbers, "kinds", "start", "end", "closing")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = []
            for kinds, start, end, closing in zip(*(batch.column(c).to_pylist() for c in ("kinds", "start", "end", "closing")), strict=True):
                edits.append((search_short if len(kinds) <= 64 else search)(kinds, start, end) + "I" * closing)
            yield table(**{c: batch.column(c) for c in (*keep, *numbers)}, edits=pa.array(edits, pa.string()))

    return both.mapInArrow(searched, both.select(*keep, *numbers).schema.add("edits", "string"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, place, edit, turn, role, text) of what is kept and put. The edits of a chunk come
    before its turns in one order by key, and every turn takes the next one. A
    conversation's rows lie in order in one partition, and pass one by one."""
    keys = ["conv", "turn", "role", "h1", "h2"]
    marks = edits.select(*keys, F.lit(0).alias("is_turn"), "part", "no", F.col("edits").alias("text"))
    lines = rows.select(*keys, F.lit(1).alias("is_turn"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("no"), "text")
    together = marks.unionAll(lines).repartition("conv").sortWithinPartitions(*order(), "is_turn", "part", "no")
    schema = rows.select("conv").schema.add("place", "long").add("edit", "string").add("turn", "long").add("role", "string").add("text", "string")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[Iterator[str]] = deque()
        state, place, conv = NONE, 0, None
        out: dict[str, list] = {f.name: [] for f in schema}
        kind = None

        def emit(edit: str, turn: int | None, role: str, text: str) -> None:
            nonlocal place
            for c, v in zip(out, (conv, place, edit, turn, role, text), strict=True):
                out[c].append(v)
            place += 1

        def following() -> str | None:
            nonlocal state
            while waiting:
                for letter in waiting[0]:
                    if letter != "I":
                        return letter
                    state = put(state)[1][1]
                    emit("I", None, ROLE[state], "")
                waiting.popleft()
            return None

        def flush() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
            for v in out.values():
                v.clear()
            return made

        for batch in batches:
            kind = batch.column(0).type
            columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "is_turn", "text"))
            for key, turn, role, is_turn, text in zip(*columns, strict=True):
                if key != conv:
                    following()  # turns put at the end
                    state, place, conv = NONE, 0, key
                if not is_turn:
                    waiting.append(iter(text))
                    continue
                letter = following()
                if letter == "K":
                    state = SYSTEM if role[0] == "s" else put(state)[1][1]
                    emit("K", turn, role, text)
                elif letter == "R":
                    state = put(state)[1][1]
                    emit("R", turn, ROLE[state], text)
            if out["conv"]:
                yield flush()
        following()
        if out["conv"]:
            yield flush()

    return together.select("conv", "turn", "role", "is_turn", "text").mapInArrow(applied, schema)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """(summary, turns). The summary has a row for each conversation with turns: (conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit). The turns are those of the repaired
    conversations: (conv, place, edit, turn, role, text), edit K, R or I.

    Turns are taken in order of `turn`, nulls first; ties by role and then by a digest of
    what is said, so that the order in the table plays no part. Null roles and texts
    count as one space; a null conversation is one of its own. A turn is blank without
    a character other than white space, duplicate if role and text were there before
    (equal rows too: all but one), truncated if its last such character is none of
    .!?, whichever is first. Blank and duplicate turns are deleted. A role with another initial
    than s, u or a, or none, cannot be kept. A conversation whose every turn is
    deleted has no turns. An empty table gives no rows; other columns are not read.
    """
    said = keyed(rows, conv, turn, role, text)
    edits = stored(edited(stored(chunks(said, chunk), "chunks")), "edits")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = F.array_sort(F.collect_list(F.struct("part", "no", "edits")))
    summary = edits.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in numbers), F.array_join(F.transform(parts, lambda x: x["edits"]), "").alias("audit")
    )
    return summary, repaired(said, edits)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of the `role:text` lines of `repair`'s turns, as they come: in order
    and a conversation in one partition."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, kind = None, None, None
        for batch in batches:
            kind = batch.column(0).type
            keys, sums = [], []
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                line = f"{role}:{text}".encode()
                if state is not None and key == conv:
                    state.update(b"\n" + line)
                    continue
                if state is not None:
                    keys.append(conv)
                    sums.append(state.hexdigest())
                state, conv = hashlib.sha256(line), key
            yield table(conv=pa.array(keys, kind), sha256=pa.array(sums, pa.string()))
        if state is not None:
            yield table(conv=pa.array([conv], kind), sha256=pa.array([state.hexdigest()]))

    return turns.select("conv", "role", "text").mapInArrow(hashed, turns.select("conv").schema.add("sha256", "string"))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults: by the crc32 of `conv_id:turn`, a turn is dropped, emptied,
    robbed of its full stops, repeated or given the role of the user. Nulls are a space each."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    faulty = rows.select("conv_id", "turn", "role", "text", fault.alias("_fault")).where("_fault > 0")
    return faulty.select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")
    ).drop("_copy")
