import heapq
import re

from pyspark.sql import functions as F

from kindred.llm import mixing
from kindred.llm.workspace import Workspace


def targets(sums, cap=3):
    whole, free, out = sum(sums.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}, {}
    left = whole
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > cap * sums[s] + 1e-9]
        if not over:
            return out | {s: level * w for s, w in free.items()}
        for s in over:
            out[s] = cap * sums[s]
            left -= out[s]
            del free[s]
    return out


def test_targets_and_taken(spark):
    rows = [(i, ["hot", "a", "b", "tiny", None, "hot", "é"][i % 7], "w " * (1 if i % 7 == 3 else 5 + i * 37 % 400)) for i in range(600)]
    rows += [(9_000, "hot", None), (9_001, "empty", ""), (9_002, "long", "z " * 60_000), (None, "a", "x y"), (3, "a", "x y z"), (3, "a", "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(df, shard_words=20_000).collect()
    assert len(got) == len(rows)
    sums = {}
    for _, s, t in rows:
        sums[s] = sums.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sums)
    of = {(d, s): s for d, s, _ in rows}
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = next(v for (d, _), v in of.items() if d == r.doc_id and sums[v] == r.source_size)
        assert abs(r.target - want[s]) < 1e-6
        taken[s] = taken.get(s, 0) + r.taken
    for s in sums:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS, s


def test_small_sources_meet_their_targets_in_many_shards(spark):
    rows = [(i, "a", "w " * 17) for i in range(200)] + [(1_000 + i, "b", "w " * 5) for i in range(200)]
    taken = lambda rows: {r.doc_id: r for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), shard_words=20).collect()}
    near = [r for r in taken(rows).values() if r.source_size == 1_000]  # its target is just below the cap
    assert abs(sum(r.taken for r in near) - near[0].target) <= mixing.BLOCK_WORDS and all(r.taken <= 3 * r.size for r in near)
    rows += [(5_000, "c", "w " * 10), (5_001, "d", "w " * 4)] + [(6_000 + i, None, "w w") for i in range(40)]
    assert all(r.taken == r.size * 3 for d, r in taken(rows).items() if d >= 5_000)


def highest_quotients(shares, seats):
    """Seats given one by one, each to the highest quotient."""
    heap, won = [(-v, k, 0) for k, v in shares.items() if v > 0], dict.fromkeys(shares, 0)
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k, s = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-shares[k] / (2 * s + 3), k, s + 1))
    return won


def test_quotas_are_highest_quotients(spark):
    groups = {
        "many tiny and a giant": ({"giant": 10_000.0, **{f"t{i:04}": 0.6 for i in range(1000)}}, 10_600),
        "equal": ({f"e{i:03}": 5.0 for i in range(200)}, 333), "more rows than seats": ({f"m{i:03}": 1.0 + i for i in range(300)}, 40), "one": ({"o": 3.0}, 7), "none": ({"x": 0.0, "y": 0.0}, 9),
        **{f"mixed {n}": ({f"s{i:02}": 10.0 + i * i * 37 % 900 for i in range(25)}, n) for n in (0, 1, 7, 100, 1003)},
    }
    rows = [(g, k, v, n) for g, (shares, n) in groups.items() for k, v in shares.items()]
    df = spark.createDataFrame(rows, "g string, k string, share double, seats long").repartition(5)
    got = {(r.g, r.k): r.quota for r in mixing.apportioned(df, ["g"], "seats", "share", ["k"], Workspace(spark, "test")).collect()}
    assert len(got) == len(rows)
    for g, (shares, n) in groups.items():
        assert {k: got[g, k] for k in shares} == highest_quotients(shares, n), g


def test_the_mixture_holds_the_words_that_are_taken(spark):
    rows = [(i, ["a", "b", None][i % 3], f"\t{i} " + " \n".join(f"w{i}_{k}" for k in range(i * 13 % 70)), "clash") for i in range(300)]
    rows += [(1, "a", rows[1][2], "clash"), (None, "b", "no id here", "x"), (900, "a", None, "x"), (901, "a", " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _order string").withColumn("copy", F.lit("clash"))
    figures = {(r.doc_id, r.size): r.taken for r in mixing.mixed(df, shard_words=900).collect()}
    out, words = mixing.mixture(df.repartition(7), shard_words=900), {}
    assert out.columns == ["doc_id", "source", "text", "_order", "size", "source_size", "target", "taken", "copy"]
    for r in out.collect():
        whole = next(t for d, _, t, _ in rows if d == r.doc_id)
        assert whole.startswith(r.text) and r.taken == figures[r.doc_id, r.size]
        words.setdefault(r.doc_id, []).append(len(r.text.split()))
    for (d, size), taken in figures.items():
        assert sum(words.get(d, [])) == taken * (2 if d == 1 else 1) and all(n == size for n in sorted(words.get(d, []))[1:]), d


def test_empty_and_wordless_tables(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    got = mixing.mixed(spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_tables_of_few_words_are_mixed(spark):
    got = mixing.mixed(spark.createDataFrame([(1, "a", "x"), (2, "b", "x y"), (3, "b", "")], "doc_id long, source string, text string")).collect()
    assert sum(r.taken for r in got) == 3 and {r.doc_id: r.target for r in got} == {1: 1.0, 2: 2.0, 3: 2.0}
    assert mixing.mixed(spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")).first().taken == 1
