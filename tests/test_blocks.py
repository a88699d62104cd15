import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocks, index, match
from kindred.plans.schema import FieldSpec, MatchSchema, Tier

SCHEMA = MatchSchema("s", (FieldSpec("databaseField", "database", 0), FieldSpec("idField", "id", 1), FieldSpec("idxNGramField", "title", 2), FieldSpec("noCompField", "note", 3)), (Tier(0.7, 0),))


@pytest.mark.parametrize("dense, k", [(0, 12), (40, 5), (1000, 12), (40, 400)])
def test_best_of_a_block_equal_all_scores(monkeypatch, dense, k):
    monkeypatch.setattr(blocks, "DENSE", dense)
    rnd = random.Random(dense + k)
    held = [{(f"g{min(int(rnd.expovariate(0.05)), 150):03}"): rnd.randrange(1, 10**10) for _ in range(20)} for _ in range(500)]
    rows = [(g, 3 * t, w) for t, found in enumerate(held) for g, w in found.items()]
    rnd.shuffle(rows)
    block = blocks.Postings(pa.table({"gram": [r[0] for r in rows], "tid": [r[1] for r in rows], "weight": [r[2] for r in rows]}))
    asked = ["".join(f"g{rnd.randrange(151):03}" for _ in range(rnd.randrange(1, 25))) for _ in range(40)]
    wanted = [blocks._asked(block.ids, a, 4) for a in asked]
    block.prepare(max(sum(int(block.heaviest[g]) * c for g, c in found) for found in wanted))
    for a, found in zip(asked, wanted):
        counts = Counter(a[i : i + 4] for i in range(0, len(a), 4))
        scores = [(-sum(c * d.get(g, 0) for g, c in counts.items()), 3 * t) for t, d in enumerate(held)]
        at, sums = block.best(found, k)
        assert list(zip(sums.tolist(), block.tids[at].tolist())) == [(-s, t) for s, t in sorted(scores)[:k] if s]


def test_many_queries_meet_texts_in_blocks(spark, monkeypatch):
    """No table of the scores of pairs: the plan holds the blocks, and the results are those of few queries."""
    rows = spark.createDataFrame([(i, ["d", str(i), f"{'dengue zika rural '[i % 5:]}{i % 40} study"]) for i in range(90)], "seq long, fields array<string>")
    built = index.build_index(rows, SCHEMA)
    qtexts = built.docs.select(F.col("title").alias("qtext"), F.col("seq").alias("qtid"))
    few = match.best_texts(qtexts, built, 12)
    monkeypatch.setattr(match, "SENT_QUERIES", 10)
    many = match.best_texts(qtexts, built, 12)
    assert "CoGroups" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(many.collect()) == sorted(few.collect()) and few.count() > 500


def test_documents_stay_where_they_are_if_none_is_replaced(spark):
    rows = spark.createDataFrame([(i, ["d", str(i), f"text {i}"]) for i in range(20)], "seq long, fields array<string>")
    kept = index.upserted(index.shape_documents(rows, SCHEMA))
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 20
