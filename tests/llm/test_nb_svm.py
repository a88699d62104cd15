import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.llm import nb_svm

TABLES = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").repartition(8)
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    found = nb_svm.scores(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 800
    assert np.mean([q == p for q, p in held]) > 0.97
    assert np.mean([p for q, p in held if q == 1]) > 0.98 and np.mean([1 - p for q, p in held if q == 0]) > 0.9


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"fine word{i % 7} text" if i % 3 else f"junk ### {i % 5} $$$", 1) for i in range(300)], "doc_id long, text string, SCORE int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = nb_svm.train(docs, labels)
    turned = labels.withColumn("quality", F.when(nb_svm.fold("doc_id") == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = nb_svm.train(docs, turned)
    assert np.array_equal(model.weights, other.weights) and model[2:] == other[2:]
    got = nb_svm.scored(docs, model)
    assert got.columns == ["doc_id", "text", "score"]  # the column of that name in another case is replaced
    assert all((r.score > 0.7) == (r.doc_id % 3 > 0) for r in got.collect())
    assert sorted(nb_svm.train(docs, labels, entries=400).weights.nonzero()[0].tolist()) != sorted(model.weights.nonzero()[0].tolist())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (None, "a b"), (4, "same"), (4, "same"), (5, " \n\t"), (6, "é ☃ 日本")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 5), (4, 1), (4, 0), (3, 1), (6, 1), (9, 1)], "doc_id long, quality int")
    got = nb_svm.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.score, r.held_out))
    assert by[1] == by[2] or {s for s, _ in by[1]} == {s for s, _ in by[2]}
    assert all(len(s) == 1 for s in by.values()) and by[None] and {h for _, h in by[None]} == {False}
    none = nb_svm.scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert nb_svm.scores(docs.limit(0), labels).collect() == []


def test_coordinate_descent_closes_the_duality_gap(monkeypatch):
    monkeypatch.setattr(nb_svm, "STILL", 1e-6)
    rnd = np.random.default_rng(5)
    rows = [(np.sort(rnd.choice(40, 6, replace=False)).astype(np.int32), rnd.normal(size=6)) for _ in range(200)]
    signs = np.where(rnd.random(200) < 0.5, 1.0, -1.0)
    costs = np.full(200, 0.7)
    w, bias = nb_svm.coordinate_descent(rows, signs, costs, 40, rounds=3000)
    margins = np.array([v @ w[at] + bias for at, v in rows])
    primal = (w @ w + bias * bias) / 2 + (costs * np.maximum(0, 1 - signs * margins)).sum()
    for _ in range(200):  # no small step improves it
        d = rnd.normal(size=41) * 10.0 ** rnd.uniform(-5, -1)
        u, c = w + d[:-1], bias + d[-1]
        m = np.array([v @ u[at] + c for at, v in rows])
        assert (u @ u + c * c) / 2 + (costs * np.maximum(0, 1 - signs * m)).sum() >= primal - 1e-4


def naive(text):
    out, kind = [], None
    for ch in text.encode():
        k = 0 if ch in b" \t\n\x0b\x0c\r" else 1 if ch >= 128 or chr(ch).isalnum() else 2
        if k and k == kind:
            out[-1] += bytes([ch])
        elif k:
            out.append(bytes([ch]))
        kind = k
    return out


def test_features_are_distinct_ngrams_of_runs():
    texts = ["a b a b", "Wow!! Wow!", "", None, "é x-1", "a" * 100 + " " + "a" * 99, "a b"]
    got = list(nb_svm.features(pa.array(texts)))
    for t, held in zip(texts, got):
        runs = naive(t or "")
        grams = {tuple(runs[i : i + n]) for n in nb_svm.NGRAMS for i in range(len(runs) - n + 1)}
        assert len(held) == len(grams)
    both = {*naive(texts[0])}
    assert both == {b"a", b"b"} and set(got[6]) <= set(got[0])
