import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from kindred.llm import near_dup
from kindred.llm.components import connected_components
from kindred.llm.workspace import Workspace

TABLE = "/root/testdata/sf0.01/documents.parquet"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crowd():
    """Near copies whose similarities lie around 0.8, rows that share a passage, exact copies, short and empty texts."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rnd.sample(range(120), rnd.randrange(0, 9)):
            w[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(60)]
    rows += [(i, " ".join([*passage, *[f"q{i}_{k}" for k in range(rnd.randrange(5, 40))]])) for i in range(150, 230)]
    rows += [(300, None), (301, ""), (302, "One two"), (303, "one\n TWO "), (304, "a b c d"), (305, rows[3][1].upper()), (305, rows[3][1].upper()), (306, "z " * 30_000), (307, "z " * 29_000)]
    return rows


def brute(rows, size):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, own in enumerate(sets):
        met = Counter(j for g in own for j in holders.get(g, ()))
        for j, common in met.items():
            if 100 * common >= 80 * (len(own) + len(sets[j]) - common):
                parent[top(i)] = top(j)
        for g in own:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min((x for x in (d, least.get(top(i))) if x is not None), default=None)
    return sorted((d, len(sets[i]), least[top(i)], least[top(i)] == d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("chunks", [(200_000, 512), (700, 8)])
def test_components_equal_brute_force(spark, monkeypatch, chunks):
    monkeypatch.setattr(near_dup, "CHUNK_SHINGLES", chunks[0])
    monkeypatch.setattr(near_dup, "CHUNK_NODES", chunks[1])
    rows = crowd()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4)


def test_one_of_each_group_stays(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), "other words that stand alone here"
    near = f"{text} more"
    rows = [(3, text, "x"), (1, text, "y"), (1, text, "y"), (1, near, "y"), (2, other, "z"), (2, near, "z"), (4, None, None), (4, None, "twice"), (6, " ", None), (None, "no id at all in this row", "n"), (None, near, "n")]
    got = near_dup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, k1 string").withColumnRenamed("k1", "row")).collect()
    left = sorted((r.doc_id or 0, r.text or "") for r in got)
    first = [x for x in left if x[0] == 1]
    assert [x for x in left if x[0] != 1] == [(0, "no id at all in this row"), (2, other), (4, ""), (6, " ")] and len(first) == 1 and first[0][1] in (text, near)


def test_rows_without_id_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:30], "changed", *words[31:]])
    rows = [(1, text), (None, near), (None, "quite another text that nobody else has"), (None, "quite another text that nobody else has indeed"), (None, "z " * 50)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 1, 0, True), (0, 4, 0, True), (0, 5, 0, True), (0, 57, 1, False), (1, 57, 1, True)]


@pytest.mark.skipif(not Path(TABLE).exists(), reason="needs the sample tables")
def test_all_links_of_a_real_table_are_found(spark):
    rows = [tuple(r) for r in spark.read.parquet(TABLE).select("doc_id", "text").collect()]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4)


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_path_and_star_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)] + [(5, 5), (7, 6)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(21)] + [(i, 100) for i in range(100, 120)]


def test_minima_estimate_similarity():
    rnd = np.random.default_rng(1)
    whole = rnd.integers(0, 2**63, 1500).astype(np.uint64)
    low = near_dup.minima([np.sort(whole[:1000]), np.sort(whole[100:1100])], 2000)
    assert abs((low[0] == low[1]).mean() - 900 / 1100) < 0.04
