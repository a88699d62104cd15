"""Repair of the structure of conversations by cheapest edits.

A sound conversation is empty, or pairs of user and assistant turns after at most one system turn: roles ``(s?(ua)+)?``.  Each turn is kept (0),
given the role user or assistant (1) or deleted (2, a must for blank and repeated turns); an empty user or assistant turn is inserted (5) anywhere;
an undeleted turn that breaks off costs 5 more.  Of the cheapest edits the one whose letters D, I, K, R are least in ASCII order is taken.

Nodes of the graph are (turns consumed, state of the pattern), arcs are edits.  Forward costs from the start and backward costs to the end tell the
tight arcs, those on some cheapest path.  A walk keeps the set of nodes that the least letters so far reach: at each step it takes the least letter of
all tight arcs that leave the set.  As each letter but I consumes a turn, the set always lies at one turn: it is a set of the pattern's four states.

Turns of a conversation are ordered over the whole table and cut into chunks of at most ``CHUNK``, so a conversation of any size spreads over tasks.  A
chunk is first a 4 x 4 matrix of costs; the matrices of one conversation (a row for each ``CHUNK`` of its turns) give the forward costs at the
beginning and the backward costs at the end of each chunk.  Chunks then walk from each set of states that can stand at their beginning, and
the walks of one conversation are chained.  Only the final pass meets whole texts: it streams each conversation in order, holding one batch
and the letters, since a SHA-256 over a conversation can't be split (:func:`repaired_turns` streams them likewise and writes the turns).

Defined cases: null roles and texts are one space, null turns come first, a null conversation is one of its own.  Turns with equal number are ordered
by the first 64 characters of the role, then by the SHA-256 of role and text; equal turns are interchangeable.  A role counts by its first letter; other
letters than s, u and a fit nowhere.  An empty table gives no rows.  Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.workspace import Workspace, ship

CHUNK = 4096
#: Costs.
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
_FAR = 1 << 60
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  Where a role leads; None: nowhere.
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_ENDS = (0, 3)
#: The role that an inserted or renamed turn gets in a state, and the state after it.
_NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: A turn's code is 3 * (0 s, 1 u, 2 a, 3 other) + (0 sound, 1 must be deleted, 2 broken off).
FAULT_BLANK, FAULT_REPEATED, FAULT_BROKEN = 1, 2, 3
SPACES = r"\x20\x09-\x0D"


@lru_cache(1 << 12)
def _arcs(code: int) -> tuple[tuple[int, int, int, str], ...]:
    """Arcs that consume a turn of this code: ``(from, to, cost, letter)``."""
    letter, fault = divmod(code, 3)
    out = [(s, s, DELETE, "D") for s in range(4)]
    if fault != 1:
        more = BROKEN if fault == 2 else 0
        if letter < 3:
            out += [(s, t, more, "K") for s, t in enumerate(_AFTER["sua"[letter]]) if t is not None]
        out += [(s, _NEXT[s][0], REROLE + more, "R") for s in range(4)]
    return tuple(out)


def _inserted(costs: list[int]) -> list[int]:
    """Forward costs after any insertions."""
    out = list(costs)
    for _ in range(3):
        for s in range(4):
            t = _NEXT[s][0]
            out[t] = min(out[t], out[s] + INSERT)
    return out


def _inserting(costs: list[int]) -> list[int]:
    """Backward costs before any insertions."""
    out = list(costs)
    for _ in range(3):
        for s in range(4):
            out[s] = min(out[s], out[_NEXT[s][0]] + INSERT)
    return out


END = tuple(_inserting([0 if s in _ENDS else _FAR for s in range(4)]))


def _forward(costs: list[int], code: int) -> list[int]:
    costs, out = _inserted(costs), [_FAR] * 4
    for s, t, cost, _ in _arcs(code):
        out[t] = min(out[t], costs[s] + cost)
    return out


def _backward(costs: list[int], code: int) -> list[int]:
    out = [_FAR] * 4
    for s, t, cost, _ in _arcs(code):
        out[s] = min(out[s], costs[t] + cost)
    return _inserting(out)


@lru_cache(1 << 14)
def matrix(codes: bytes) -> tuple[int, ...]:
    """Least costs from each state before the turns to each state after them, row by row."""
    out = []
    for s in range(4):
        costs = [0 if t == s else _FAR for t in range(4)]
        for code in codes:
            costs = _forward(costs, code)
        out += [min(c, _FAR) for c in costs]
    return tuple(out)


def step_costs(costs: tuple[int, ...], m: tuple[int, ...], back: bool = False) -> tuple[int, ...]:
    """Forward costs after a chunk, or backward costs before it."""
    if back:
        return tuple(min(_FAR, min(m[4 * s + t] + costs[t] for t in range(4))) for s in range(4))
    return tuple(min(_FAR, min(costs[s] + m[4 * s + t] for s in range(4))) for t in range(4))


@lru_cache(1 << 14)
def walks(codes: bytes, before: tuple[int, ...], after: tuple[int, ...], last: bool) -> tuple[tuple[int, int, str], ...]:
    """``(states at the beginning, states at the end, letters)`` for each set of states that can stand at the beginning, as bit masks.

    ``before``: forward costs at the beginning, ``after``: backward costs at the end.
    """
    forward, backward = [list(before)], [list(after)]
    for code in codes:
        forward.append(_forward(forward[-1], code))
    for code in reversed(codes):
        backward.append(_backward(backward[-1], code))
    backward.reverse()
    whole = [_inserted(f) for f in forward]
    best = min(f + b for f, b in zip(whole[-1], after))
    tight = [s for s in range(4) if forward[0][s] + backward[0][s] == best]
    out = []
    for size in range(1, len(tight) + 1):
        for chosen in combinations(tight, size):
            at, letters = set(chosen), []
            for i, code in enumerate(codes):
                while True:
                    found: dict[str, set[int]] = {}
                    for s in at:
                        for a, t, cost, letter in _arcs(code):
                            if a == s and whole[i][s] + cost + backward[i + 1][t] == best:
                                found.setdefault(letter, set()).add(t)
                        t = _NEXT[s][0]
                        if whole[i][s] + INSERT + backward[i][t] == best:
                            found.setdefault("I", set()).add(t)
                    letter = min(found)
                    letters.append(letter)
                    at = found[letter]
                    if letter != "I":
                        break
            while last and not any(s in _ENDS and whole[-1][s] == best for s in at):
                at = {_NEXT[s][0] for s in at if whole[-1][s] + INSERT + after[_NEXT[s][0]] == best}
                letters.append("I")
            out.append((sum(1 << s for s in chosen), sum(1 << s for s in at), "".join(letters)))
    return tuple(out)


def shaped(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """``conv, turn, role, text, gone, digest``; rows that are ``gone`` only tell that their conversation exists."""
    found = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"))
    return found.withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)))


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the query: by a checksum of conversation and turn a row is dropped, emptied, cut of its stops, repeated or given the role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies).drop("_copy")


_ORDER = ("conv", "turn", "_role", "digest")


def _chunks(rows: DataFrame, ws: Workspace) -> DataFrame:
    """``conv, key, codes`` and counts of each chunk; ``key`` is unique and in order."""
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    broken = ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    fault = F.when(blank, FAULT_BLANK).when(broken, FAULT_BROKEN).otherwise(0)
    narrow = rows.select("conv", "turn", F.substring("role", 1, 64).alias("_role"), "digest", "gone", initial.alias("initial"), fault.alias("fault"), F.monotonically_increasing_id().alias("_salt"))
    n = max(1, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = narrow.repartitionByRange(n, *_ORDER, "_salt").sortWithinPartitions(*_ORDER)
    turns = ws.save(dealt.select("conv", "turn", "digest", "gone", "initial", "fault", F.monotonically_increasing_id().alias("at")), "turns")
    first = turns.where(~F.col("gone")).groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    told = turns.join(first, "at", "left")
    fault = F.when((F.col("fault") != FAULT_BLANK) & F.col("first").isNull(), FAULT_REPEATED).otherwise(F.col("fault"))
    told = told.select("conv", "at", "gone", F.when(~F.col("gone"), F.col("turn")).alias("turn"), "initial", F.when(~F.col("gone"), fault).alias("fault"))
    code = F.col("initial") * 3 + F.when(F.col("fault").isin(FAULT_BLANK, FAULT_REPEATED), 1).when(F.col("fault") == FAULT_BROKEN, 2).otherwise(0)
    count = lambda k: F.count_if(F.col("fault") == k)
    codes = F.collect_list(F.when(~F.col("gone"), F.struct("at", code.cast("int").alias("code"))))  # at most CHUNK
    chunks = told.groupBy("conv", F.expr(f"at div {CHUNK}").alias("_chunk")).agg(
        F.min("at").alias("key"), F.transform(F.array_sort(codes), lambda x: x["code"]).alias("codes"), count(FAULT_BLANK).alias("blank"), count(FAULT_REPEATED).alias("repeated"), count(FAULT_BROKEN).alias("broken"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )
    return ws.save(chunks.drop("_chunk"), "chunks")


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one conversation after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["conv"] != row["conv"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(matrix(bytes(c))) for c in batch.column("codes").to_pylist()]
        yield pa.record_batch([batch.column("conv"), batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "key", "matrix"])


def _rows(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names=names)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the forward costs at its beginning and the backward costs at its end."""
    out: list[dict] = []
    names, kinds = ["key", "before", "after", "best", "first", "last"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.bool_()]
    for group in _groups(batches):
        forward, backward = [(0, _FAR, _FAR, _FAR)], [END]
        matrices = [tuple(g["matrix"]) for g in group]
        for m in matrices:
            forward.append(step_costs(forward[-1], m))
        for m in reversed(matrices):
            backward.append(step_costs(backward[-1], m, back=True))
        backward.reverse()
        for i, g in enumerate(group):
            out.append({"key": g["key"], "before": forward[i], "after": backward[i + 1], "best": backward[0][0], "first": i == 0, "last": i == len(group) - 1})
        if len(out) > 4096:
            yield _rows(out, names, kinds)
            out = []
    yield _rows(out, names, kinds)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [walks(bytes(r["codes"]), tuple(r["before"]), tuple(r["after"]), r["last"]) for r in batch.select(["codes", "before", "after", "last"]).to_pylist()]
        columns = [pa.array([[w[i] for w in f] for f in found], pa.list_(k)) for i, k in enumerate((pa.int32(), pa.int32(), pa.string()))]
        yield pa.record_batch([batch.column("conv"), batch.column("key"), batch.column("first"), batch.column("last"), batch.column("best"), *columns], names=["conv", "key", "first", "last", "best", "states", "leads", "letters"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the walk that its conversation takes: its number from 1."""
    out: list[dict] = []
    for group in _groups(batches):
        at = 1
        for g in group:
            n = g["states"].index(at)
            at = g["leads"][n]
            out.append({"key": g["key"], "taken": n + 1})
        if len(out) > 4096:
            yield _rows(out, ["key", "taken"], [pa.int64(), pa.int32()])
            out = []
    yield _rows(out, ["key", "taken"], [pa.int64(), pa.int32()])


def audits(rows: DataFrame, ws: Workspace) -> DataFrame:
    """``conv, key, letters, best`` and counts of each chunk of ``rows`` (:func:`shaped`)."""
    conv = rows.schema["conv"].dataType.simpleString()
    chunks = _chunks(rows, ws)
    matrices = chunks.select("conv", "key", "codes").mapInArrow(_matrices, f"conv {conv}, key long, matrix array<long>")
    costs = _by_conversation(matrices, "key").mapInArrow(_costs, "key long, before array<long>, after array<long>, best long, first boolean, last boolean")
    walked = chunks.select("conv", "key", "codes").join(costs, "key").select("conv", "key", "codes", "before", "after", "best", "first", "last")
    walked = ws.save(walked.mapInArrow(_walked, f"conv {conv}, key long, first boolean, last boolean, best long, states array<int>, leads array<int>, letters array<string>"), "walks")
    alone = F.col("first") & F.col("last")
    taken = _by_conversation(walked.where(~alone).select("conv", "key", "states", "leads"), "key").mapInArrow(_chained, "key long, taken int")
    chosen = walked.where(~alone).join(taken, "key").select("key", "best", F.element_at("letters", F.col("taken")).alias("letters"))
    chosen = chosen.unionByName(walked.where(alone).select("key", "best", F.element_at("letters", F.lit(1)).alias("letters")))
    return chunks.join(chosen, "key")


def illegal_pairs(codes: list[int]) -> int:
    """Neighbours whose roles aren't system and user, user and assistant, or assistant and user."""
    letters = [c // 3 for c in codes]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(letters, letters[1:]))


class _Repair:
    """Follows the letters of one conversation along its turns."""

    def __init__(self, letters: str) -> None:
        self.letters, self.at, self.state = letters, 0, 0

    def insertions(self) -> Iterator[tuple[str, str]]:
        while self.letters.startswith("I", self.at):
            self.at += 1
            self.state, role = _NEXT[self.state]
            yield role, ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = _AFTER[role[0]][self.state]
            yield role, text
        elif letter == "R":
            self.state, role = _NEXT[self.state]
            yield role, text


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object]]:
    """Events of one conversation after the other: ``begin`` with its chunks, ``turn`` for each repaired turn, ``end``."""
    state: dict = {}

    def turns(found: Iterator[tuple[str, str]]) -> Iterator[tuple[str, object]]:
        for t in found:
            yield "turn", t

    def begin() -> Iterator[tuple[str, object]]:
        state["repair"] = _Repair("".join(c["letters"] for c in state["chunks"]))
        yield "begin", (state["conv"], state["chunks"])

    def close() -> Iterator[tuple[str, object]]:
        if state:
            if "repair" not in state:
                yield from begin()
            yield from turns(state["repair"].insertions())
            yield "end", state["conv"]
            state.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if state and state["conv"] != row["conv"]:
                yield from close()
            if not state:
                state |= {"conv": row["conv"], "chunks": []}
            if row["kind"] == 0:
                state["chunks"].append(row)
                continue
            if "repair" not in state:
                yield from begin()
            yield from turns(state["repair"].turn(row["role"], row["text"]))
    yield from close()


def _summary(conv: object, chunks: list[dict]) -> dict:
    low = min((c["low"] for c in chunks if c["low"] is not None), default=None)
    high, held, last = None, 0, None
    for c in chunks:
        if c["low"] is not None:
            held += c["turns"] - (c["low"] == high)
            high = c["high"]
    illegal = 0
    for c in chunks:
        illegal += illegal_pairs(([last] if last is not None else []) + c["codes"])
        last = c["codes"][-1] if c["codes"] else last
    sums = {out: sum(c[own] for c in chunks) for out, own in (("blank", "blank"), ("duplicate", "repeated"), ("truncated", "broken"))}
    return {"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - held, **sums, "illegal": illegal, "cost": chunks[0]["best"], "audit": "".join(c["letters"] for c in chunks)}


_DIGESTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _with_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks of each conversation, then its turns in order."""
    turns = rows.where(~F.col("gone")).select("conv", F.lit(1).alias("kind"), "turn", F.substring("role", 1, 64).alias("_role"), "digest", "role", "text")
    both = found.select("conv", F.lit(0).alias("kind"), "key", "letters", "best", "codes", "blank", "repeated", "broken", "low", "high", "turns").unionByName(turns, allowMissingColumns=True)
    return _by_conversation(both, "kind", "key", "turn", "_role", "digest").drop("_role", "digest", "turn", "key")


def audited(rows: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cost and letters of its repair, and the SHA-256 of the repaired ``role:text`` lines."""
    ship(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        conv = first.schema.field("conv").type
        kinds = [conv, *[pa.int64()] * 6, pa.string(), pa.string()]
        out: list[dict] = []
        digest, any_turn = hashlib.sha256(), False

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for event, x in _stream(again()):
            if event == "begin":
                digest, any_turn = hashlib.sha256(), False
                out.append(_summary(*x))
            elif event == "turn":
                digest.update((("\n" if any_turn else "") + f"{x[0]}:{x[1]}").encode("utf-8", "surrogatepass"))
                any_turn = True
            else:
                out[-1]["repaired_sha256"] = digest.hexdigest()
                if len(out) > 1024:
                    yield _rows(out, _DIGESTS, kinds)
                    out = []
        yield _rows(out, _DIGESTS, kinds)

    ws = Workspace(rows.sparkSession, "conversations")
    both = _with_texts(rows, audits(rows, ws))
    return both.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _DIGESTS[1:7]) + ", audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, position, role, text``: the turns of all repaired conversations, positions from 0."""
    ship(rows.sparkSession)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        names, kinds, conv, n = ["conv_id", "position", "role", "text"], [None, pa.int64(), pa.string(), pa.string()], None, 0

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[0] = batch.schema.field("conv").type
                yield batch

        for event, x in _stream(typed()):
            if event == "begin":
                conv, n = x[0], 0
            elif event == "turn":
                out.append({"conv_id": conv, "position": n, "role": x[0], "text": x[1]})
                n += 1
                if len(out) > 1024:
                    yield _rows(out, names, kinds)
                    out = []
        if out:
            yield _rows(out, names, kinds)

    ws = Workspace(rows.sparkSession, "conversations")
    both = _with_texts(rows, audits(rows, ws))
    return both.mapInArrow(run, f"conv_id {kind}, position long, role string, text string")
