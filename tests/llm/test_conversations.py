import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from kindred.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, gone string"
COSTS = {"D": 2, "I": 5}
PATTERN = re.compile(r"(s?(ua)+)?")


@lru_cache(None)
def suffix(turns, i, roles, inserts):
    """Least (cost, letters, roles given) of turns from i on such that all roles fit; the pattern is checked on whole strings at the end."""
    options = []
    if i == len(turns):
        if PATTERN.fullmatch(roles):
            options.append((0, "", ()))
    else:
        initial, must, broken = turns[i]

        def go(cost, letter, role, n=1, ins=0):
            rest = suffix(turns, i + n, roles + role[:1], ins)
            if rest:
                options.append((cost + rest[0], letter + rest[1], (role, *rest[2])))

        rest = suffix(turns, i + 1, roles, 0)
        if rest:
            options.append((COSTS["D"] + rest[0], "D" + rest[1], ("", *rest[2])))
        if not must:
            more = 5 if broken else 0
            if initial in "sua":
                go(more, "K", initial)
            go(1 + more, "R", "user")
            go(1 + more, "R", "assistant")
    if inserts < 3:
        for role in ("user", "assistant"):
            if re.fullmatch(r"s?(ua)*u?", roles + role[0]):
                rest = suffix(turns, i, roles + role[0], inserts + 1)
                if rest:
                    options.append((COSTS["I"] + rest[0], "I" + rest[1], (role, *rest[2])))
    return min(options, default=None)


def expected(rows):
    """The result for damaged rows (conv, turn, role, text) of one conversation, from the contract alone."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2][:64], hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest()))
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        turns.append((role[:1] or "-", fault in (0, 1), fault == 2))
    suffix.cache_clear()
    cost, letters, roles = suffix(tuple(turns), 0, "", 0)
    out, at = [], iter(rows)
    for letter, role in zip(letters, roles):
        row = next(at) if letter != "I" else (0, 0, "", "")
        if letter != "D":
            out.append(f"{row[2] if letter == 'K' else role}:{row[3]}")
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(row):
    conv, turn, role, text = row
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def random_rows(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rnd.randrange(1, longest)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "sys"])
            text = rnd.choice(["Yes.", "No!", "What?", "cut off", "", " \t", None, "Why? \n", "a.b", "ü.", f"turn {turn}."])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, turn + 3, None]), role, text, "x"))
    return rows


def audit(df):
    got = c.audited(c.shaped(c.damaged(df), gone=F.col("gone"))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_audits_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    rows = random_rows(chunk, 150, 10)
    rows.append((next(n for n in range(1000, 2000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0), 0, "user", "Dropped.", "x"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {}
    for conv, group in groupby(rows, key=lambda r: r[0]):
        want[conv] = expected([d for r in group for d in damage(r[:4])])
    assert audit(df) == want
    assert any(not w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def test_a_conversation_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 16)
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}.", "") for t in range(3000)] + [(i, 0, "user", "Hi.", "") for i in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = audit(df)
    codes, before = [], None
    for d in (d for r in rows[:3000] for d in damage(r[:4])):
        solid = d[3].strip()
        codes.append(3 * "sua".index(d[2][0]) + (1 if not solid or d == before else 0 if solid[-1] == "." else 2))
        before = d
    ((_, _, letters),) = [w for w in c.walks(bytes(codes), (0, c._FAR, c._FAR, c._FAR), c.END, True)]
    assert got[7][6] == letters and len(got) == 61
    turns = c.repaired_turns(c.shaped(c.damaged(df), gone=F.col("gone"))).where("conv_id = 7").orderBy("position").collect()
    assert [t.position for t in turns] == list(range(len(turns))) and re.fullmatch(r"(s?(ua)+)?", "".join(t.role[0] for t in turns))
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == got[7][7]


@pytest.mark.parametrize("costs", [(2, 5), (9, 1), (3, 1), (5, 5), (1, 1)])
def test_chunks_of_turns_chain_at_any_costs(monkeypatch, costs):
    """With the fixed costs no insertion is ever cheapest, so others are tried here."""
    monkeypatch.setitem(COSTS, "D", costs[0])
    monkeypatch.setitem(COSTS, "I", costs[1])
    monkeypatch.setattr(c, "DELETE", costs[0])
    monkeypatch.setattr(c, "INSERT", costs[1])
    for f in (c._arcs, c.matrix, c.walks):
        f.cache_clear()
    end, start = tuple(c._inserting([0, c._FAR, c._FAR, 0])), (0, c._FAR, c._FAR, c._FAR)
    rnd, letters = random.Random(sum(costs)), set()
    for _ in range(120):
        codes = [rnd.randrange(12) for _ in range(rnd.randrange(8))]
        suffix.cache_clear()
        want = suffix(tuple(("sua-"[x // 3], x % 3 == 1, x % 3 == 2) for x in codes), 0, "", 0)
        cuts = sorted(rnd.randrange(len(codes) + 1) for _ in range(2))
        parts = [bytes(codes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        before, after = [start], [end]
        for p, q in zip(parts, reversed(parts)):
            before.append(c.step_costs(before[-1], c.matrix(p)))
            after.append(c.step_costs(after[-1], c.matrix(q), back=True))
        after.reverse()
        at, found = 1, ""
        for k, p in enumerate(parts):
            (walk,) = [w for w in c.walks(p, before[k], after[k + 1], k == 2) if w[0] == at]
            at, found = walk[1], found + walk[2]
        assert (after[0][0], found) == want[:2]
        letters |= set(found)
    assert costs[1] > 1 or "I" in letters
    for f in (c._arcs, c.matrix, c.walks):
        f.cache_clear()


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], SCHEMA)) == {}
