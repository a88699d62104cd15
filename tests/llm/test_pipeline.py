import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq


def test_stages_apply_their_decisions(spark, tmp_path):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    prose = lambda n=60: " ".join(rnd.choice(words) for _ in range(n))
    item = prose(30)
    rows = [(i, prose(), "en", f"s{i % 4}") for i in range(240)]
    toxic = {i: (i, f"{prose(20)} idiot scum loser trash {prose(20)}", "en", "s0") for i in range(1000, 1060)}
    copies = [(2000 + i, rows[7][1] if i % 2 else rows[7][1].upper(), "en", "s1") for i in range(30)]
    leaked = [(3000, f"{prose()} {item} {prose()}", "en", "s2")]
    private = [(4000, f"{prose()} write to some.one@mail.example.com {prose()}", None, None)]
    odd = [(5000, None, None, None), (5001, "", "en", "s1"), (7, rows[7][1], "en", "s3")]
    every = [*rows, *toxic.values(), *copies, *leaked, *private, *odd]
    cols = list(zip(*every))
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": pa.array(cols[2], pa.string()), "source": pa.array(cols[3], pa.string()), "n_chars": pa.array([len(t or "") for t in cols[1]], pa.int64())}), tmp_path / "documents.parquet")
    marks = [(i, 0) for i in range(240)] + [(i, 1) for i in toxic]
    pq.write_table(pa.table({"doc_id": pa.array([m[0] for m in marks], pa.int64()), "quality": pa.array([1] * len(marks), pa.int32()), "toxic": pa.array([m[1] for m in marks], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert name == "mix" or docs.columns == columns
        assert name != "mix" or docs.columns == [*columns, "size", "source_size", "target", "taken", "copy"]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(240)) | {4000}
    assert set(seen["toxicity"]) == clean | set(range(2000, 2030)) | {3000, 5000, 5001}
    assert set(seen["near duplicates"]) == clean | {3000, 5000, 5001}
    assert set(seen["decontamination"]) == clean | {5000, 5001}
    assert set(seen["pseudonyms"]) == clean | {5000, 5001}
    assert "some.one@" not in seen["pseudonyms"][4000].text and seen["pseudonyms"][4000].n_chars == len(seen["pseudonyms"][4000].text)
    assert set(seen["mix"]) <= clean and all(0 < r.taken <= 3 * r.size for r in seen["mix"].values())
    got, words = corpus_pipeline.run(spark, str(tmp_path)).collect(), {}
    for r in got:
        whole = seen["pseudonyms"][r.doc_id]
        assert whole.text.startswith(r.text) and (r.lang, r.source, r.n_chars) == (whole.lang, whole.source, len(r.text)) and "some.one@" not in r.text
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: r.taken for d, r in seen["mix"].items()} and len(got) > len(words)
    assert corpus_pipeline.ORACLE_SQL is None


def test_the_mix_does_not_depend_on_the_key(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(99)}" for _ in range(40)) + f" a{i}.b@mail.example.com", "en", f"s{i % 3}", 1) for i in range(150)]
    docs, mixes = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), []
    for key in ("00" * 32, "17" * 32):
        spark.conf.set("spark.kindred.pseudonyms.key", key)
        try:
            mix = corpus_pipeline.mix_sources(spark, corpus_pipeline.replace_personal_data(spark, docs, ""), "").collect()
        finally:
            spark.conf.unset("spark.kindred.pseudonyms.key")
        mixes.append((sorted((r.doc_id, r.copy, r.taken) for r in mix), {r.text for r in mix}))
    assert mixes[0][0] == mixes[1][0] and mixes[0][1] != mixes[1][1]
