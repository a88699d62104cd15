import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import similarity
from kindred.operators import blocks, index, match, render
from kindred.plans.schema import FieldSpec, MatchSchema, Tier
from kindred.sources import records

FIELDS = (
    FieldSpec("databaseField", "database", 0), FieldSpec("idField", "id", 1), FieldSpec("idxNGramField", "title", 2), FieldSpec("authorsField", "authors", 3),
    FieldSpec("exactField", "year", 4, "MAX_SCORE"), FieldSpec("exactField", "lang", 5, "DENY_DUP"), FieldSpec("regExpField", "pages", 6, pattern=r"(\d+)", group=1, required="year"),
    FieldSpec("nGramField", "journal", 7, min_score=0.7), FieldSpec("diceField", "abstract", 8, min_score=0.81), FieldSpec("noCompField", "note", 9),
)
SCHEMA = MatchSchema("s", FIELDS, (Tier(1, 1), Tier(0.9, 2), Tier(0.6, 3)))


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["virus", "dengue", "brazil", "health", "study", "2019", "rural", "cohort", "zika", "a", "of", "12"]
    people = ["Silva, J", "Souza, M", "Silva, K", "Lee, C"]
    rows = []
    for i in range(n):
        title = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 7)))
        if rows and rnd.random() < 0.5:
            t = list(rnd.choice(rows)[2])
            for _ in range(rnd.randrange(3)):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice("abc 1")
            title = "".join(t)
        rows.append([rnd.choice(["LILACS", "Medline"]), str(i), title, "//@//".join(rnd.sample(people, rnd.randrange(0, 3))), rnd.choice(["2019", "2020", ""]), rnd.choice(["en", "pt", ""]), rnd.choice(["p. 12-20", "12", "7", ""]), rnd.choice(["Lancet", "Lancets", "BMJ", ""]), rnd.choice(["we study zika", "we study zikas", ""]), "n"])
    return rows


def norm(x):
    import unicodedata

    x = x.strip().lower()
    if "//@//" in x:
        x = "//@//".join(sorted({p.strip() for p in x.split("//@//")}))
    x = re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFD", x))
    x = re.sub("(?<![0-9]) | (?![0-9])", "", x)
    return (x[:30] + x[len(x) // 2 - 15 :][:30] + x[-30:] if len(x) > 90 else x).strip()


def norm_list(x):
    return sorted(norm(p) for p in x.split("//@//"))


def dice_of(a, b):
    """Dice coefficient of the bags of bigrams."""
    if not a or not b or len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    return 2.0 * sum((x & y).values()) / (len(a) + len(b) - 2)


def authors_agree(wanted, given):
    left = sorted({g.strip() for g in given} - {""})
    for author in filter(None, (w.strip() for w in wanted)):
        if not left:
            break
        best = max(left, key=lambda g: (dice_of(author, g), g))
        if dice_of(author, best) < 0.4:
            return False
        left.remove(best)
    return True


def sequential(docs, queries, schema, use_similarity=True, self_check=False):
    """The search as a loop over queries and candidates."""
    texts = [norm(d[2]) for d in docs]
    dl = [max(0, len(t) - 2) for t in texts]
    grams = [Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in texts]
    df = Counter(g for c in grams for g in c)
    n, average = len(docs), sum(dl) / len(docs)
    weights = [{g: round(math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * f / (f + 1.2 * (0.25 + 0.75 * dl[k] / average)) * 1e9) for g, f in c.items()} for k, c in enumerate(grams)]
    sim = lambda a, b: float(similarity.ngram_similarities([a], [b])[0])
    seen, out = set(), []
    for qi, q in enumerate(queries):
        text = norm(q[2])
        wanted = Counter(g for piece in text.split(" ") for g in re.findall("...", piece))
        scores = {k: sum(f * w.get(g, 0) for g, f in wanted.items()) for k, w in enumerate(weights)}
        order = sorted((k for k in scores if any(g in weights[k] for g in wanted)), key=lambda k: (-scores[k], k))[:1000]
        left = None
        for k in order:
            if use_similarity:
                if left == 0:
                    break
                s = sim(text, texts[k])
                low = s < np.float32(schema.lowest_tier)
                if left is not None:
                    left -= 1
                elif low:
                    left = 3
                if low:
                    continue
            else:
                if np.float32(scores[k] / 1e9) < 1:
                    break
                s = 0.0
            d, verdicts = docs[k], []
            for f in schema.fields:
                a, b = norm(q[f.pos]), norm(d[f.pos])
                deny = "DENY_DUP" if f.match == "DENY_DUP" else "NOT_SIMILAR"
                if f.kind in ("nGramField", "diceField"):
                    x = sim(a, b) if f.kind == "nGramField" else np.float32(dice_of(a, b))
                    verdicts.append("SIMILAR" if b and np.float32(x) >= np.float32(f.min_score) else deny)
                elif f.kind in ("exactField", "regExpField"):
                    if f.kind == "regExpField":
                        a, b = ((re.search(f.pattern, x) or [""] * 2)[1] for x in (a, b))
                    verdicts.append("IGNORE" if not a or not b else "SIMILAR" if a == b else "NOT_SIMILAR" if f.match == "REQUIRED" else f.match)
                elif f.kind == "authorsField":
                    if not authors_agree(norm_list(q[f.pos]), norm_list(d[f.pos])):
                        verdicts.append("NOT_SIMILAR" if f.match == "REQUIRED" else f.match)
                    else:
                        verdicts.append("SIMILAR" if dice_of(q[f.pos], d[f.pos]) >= 0.75 else deny)
                else:
                    verdicts.append("IGNORE")
            if "DENY_DUP" in verdicts:
                continue
            floor = np.float32(s)
            tier = next((t for t in schema.tiers if floor >= (1 if "MAX_SCORE" in verdicts else np.float32(t.min_value))), None)
            if not tier or verdicts.count("SIMILAR") < tier.min_fields:
                continue
            if self_check:
                key = tuple(sorted([f"{q[1]}_{norm(q[0])}", f"{norm(d[1])}_{norm(d[0])}"]))
                if key in seen:
                    continue
                seen.add(key)
            out.append((qi, k, tuple(verdicts)))
    return out


def frames(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "seq long, fields array<string>")


def found(df):
    return sorted((r.q_seq, r.seq, tuple(c.condition for c in r.checks)) for r in df.collect())


@pytest.mark.parametrize("self_check", [False, True])
def test_match_equals_the_sequential_search(spark, self_check):
    docs = corpus(120, 1)
    built = index.build_index(frames(spark, docs), SCHEMA)
    got = found(match.match(frames(spark, docs), built, self_check=self_check))
    want = sorted(sequential(docs, docs, SCHEMA, self_check=self_check))
    assert len(want) > 100
    assert got == want


@pytest.mark.parametrize("first, least", [(1, 20), (5, 4_000)])
def test_searches_that_stop_in_blocks_equal_the_sequential_search(spark, monkeypatch, first, least):
    """Before, all candidates of every block were shuffled, up to 1000 of a query and block."""
    monkeypatch.setattr(match, "SENT_QUERIES", 0)
    monkeypatch.setattr(blocks, "FIRST", first)
    monkeypatch.setattr(blocks, "LEAST_TEXTS", least)
    docs = corpus(120, 1) + [["d", f"copy{i}", "dengue virus in rural brazil 2019", *["x"] * 7] for i in range(30)]
    built = index.build_index(frames(spark, docs), SCHEMA)
    pairs = match.match(frames(spark, docs), built)
    assert found(pairs) == sorted(sequential(docs, docs, SCHEMA))
    dtexts = built.members.where("did = tid").select("tid", "dtext")
    qtexts = dtexts.toDF("qtid", "qtext")
    seen = blocks.looked_at(qtexts, built.postings, dtexts, len(docs), 1000, SCHEMA.lowest_tier, match.AFTER_MISS)
    assert 2 * seen.count() < blocks.best_of_blocks(qtexts, built.postings, len(docs), 1000).count()


def test_search_without_similarity(spark):
    schema = MatchSchema("s", FIELDS, (*SCHEMA.tiers, Tier(0, 4)))
    docs, queries = corpus(80, 3), corpus(30, 4)
    got = found(match.match(frames(spark, queries), index.build_index(frames(spark, docs), schema), use_similarity=False))
    assert got == sorted(sequential(docs, queries, schema, use_similarity=False)) and got
    assert not found(match.match(frames(spark, queries), index.build_index(frames(spark, docs), SCHEMA), use_similarity=False))


@pytest.mark.parametrize("sent, sums", [(50_000, 5_000), (0, 0)])
def test_ranking_equals_all_scores(spark, monkeypatch, sent, sums):
    """Both plans of the ranking, with blocks of postings and few documents of a text, against the scores of all pairs."""
    monkeypatch.setattr(match, "SENT_QUERIES", sent)
    monkeypatch.setattr(match, "TASK_SUMS", sums)
    monkeypatch.setattr(index, "BLOCK", 20)
    docs = [[d[0], str(i), *d[2:]] for i, d in enumerate(corpus(200, 8) + corpus(3, 9) * 20)]
    built = index.build_index(frames(spark, docs), SCHEMA)
    wanted = records.with_fields(frames(spark, docs), SCHEMA, "q_")
    for k in (12, 1000) if sent else (12,):
        got = match.ranked_candidates(wanted, built, k=k).collect()
        texts = [norm(d[2]) for d in docs]
        dl = [max(0, len(t) - 2) for t in texts]
        grams = [Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in texts]
        df, n, average = Counter(g for c in grams for g in c), len(docs), sum(dl) / len(docs)
        weights = [{g: round(math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * f / (f + 1.2 * (0.25 + 0.75 * dl[d] / average)) * 1e9) for g, f in c.items()} for d, c in enumerate(grams)]
        want = set()
        for q, t in enumerate(texts):
            if texts.index(t) == q:
                asked = Counter(g for piece in t.split(" ") for g in re.findall("...", piece))
                scores = [(-sum(f * w.get(g, 0) for g, f in asked.items()), d) for d, w in enumerate(weights) if any(g in w for g in asked)]
                want |= {(q, d, rank) for rank, (_, d) in enumerate(sorted(scores)[:k], 1)}
        assert {(r.qtid, r.did, r.rank) for r in got} == want


def test_queries_with_many_copies_are_ranked_on(spark):
    docs = [["d", str(i), "dengue virus in rural brazil 2019", *["x"] * 7] for i in range(40)] + [[d[0], f"9{d[1]}", *d[2:]] for d in corpus(30, 10)]
    got = found(match.match(frames(spark, docs), index.build_index(frames(spark, docs), SCHEMA)))
    assert got == sorted(sequential(docs, docs, SCHEMA)) and len([g for g in got if g[0] == 0]) >= 40


@pytest.mark.parametrize("floor", [0.7, 0.95, 0.5])
def test_exhaustive_search_finds_all_pairs(spark, floor):
    docs = corpus(150, 5)
    schema = MatchSchema("s", (*FIELDS[:3], FieldSpec("noCompField", "note", 3)), (Tier(floor, 0),))
    rows = [[*d[:3], "n"] for d in docs]
    built = index.build_index(frames(spark, rows), schema)
    got = match.match(frames(spark, rows), built, mode="exhaustive").collect()
    texts = [norm(d[2]) for d in docs]
    sims = {(a, b): float(similarity.ngram_similarities([x], [y])[0]) for a, x in enumerate(texts) for b, y in enumerate(texts)}
    shared = lambda a, b: floor > 2 / 3 or any(g in texts[b] for p in texts[a].split(" ") for g in re.findall("...", p))
    want = {(a, b) for (a, b), s in sims.items() if s >= np.float32(floor) and texts[a] and shared(a, b)}
    assert {(r.q_seq, r.seq) for r in got} == want and len(want) >= 150
    ranked = match.ranked_candidates(records.with_fields(frames(spark, rows), schema, "q_"), built)
    scores = {(r.qtext, r.did): r.score for r in ranked.collect()}
    assert all(r.score == scores.get((r.q_title, r.seq), 0) for r in got)


def test_early_stop_finds_no_more_than_exhaustive_search(spark):
    docs = corpus(120, 5)
    built = index.build_index(frames(spark, docs), SCHEMA)
    early, ranked = (set(found(match.match(frames(spark, docs), built, mode=m))) for m in ("early_stop", "ranked"))
    assert early <= ranked


@pytest.mark.parametrize("gram, rough", [(2, False), (4, True)])
def test_gram_sizes_and_rough_lengths(spark, gram, rough):
    docs = corpus(60, 11)
    schema = MatchSchema("s", FIELDS, SCHEMA.tiers, gram=gram, rough_lengths=rough)
    built = index.build_index(frames(spark, docs), schema)
    got = {(r.gram, r.tid): r.weight for r in built.postings.collect()}
    texts = [norm(d[2]) for d in docs]
    dl = [max(0, len(t) - gram + 1) for t in texts]
    grams = [Counter(t[i : i + gram] for i in range(len(t) - gram + 1)) for t in texts]
    df, n, average = Counter(g for c in grams for g in c), len(docs), sum(dl) / len(docs)

    def length(x):
        if not rough or x < 40:
            return x
        step = 2 ** ((x - 24).bit_length() - 4)
        return 24 + (x - 24) // step * step

    want = {(g, texts.index(t)): round(math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * f / (f + 1.2 * (0.25 + 0.75 * length(dl[d]) / average)) * 1e9) for d, t in enumerate(texts) for g, f in grams[d].items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)
    assert len(found(match.match(frames(spark, docs), built))) > 50
    one = spark.range(24, 200).select("id", index.quantised(F.col("id")).alias("q")).collect()
    assert all(r.q == 24 + ((r.id - 24) if r.id < 40 else (r.id - 24) // 2 ** ((r.id - 24).bit_length() - 4) * 2 ** ((r.id - 24).bit_length() - 4)) for r in one)


def test_authors_agree_in_the_plan_without_python(spark):
    rnd = random.Random(12)
    people = ["silvaj", "silva j", "souzam", "silvak", "leec", "", " ", "a", "ab", "gggg", "gg", "lee"]
    rows = [([rnd.choice(people) for _ in range(rnd.randrange(5))], [rnd.choice(people) for _ in range(rnd.randrange(5))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").withColumn("agree", similarity.authors_agree(F.col("a"), F.col("b")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.agree == authors_agree(r.a, r.b), r


def test_short_queries_and_empty_tables_find_nothing(spark):
    docs = corpus(20, 6)
    built = index.build_index(frames(spark, docs), SCHEMA)
    short = [["db", "1", "ab", *[""] * 7], ["db", "2", "1 22 1", *[""] * 7]]
    assert found(match.match(frames(spark, short), built)) == []
    assert found(match.match(frames(spark, docs).limit(0), built)) == []
    assert found(match.match(frames(spark, docs), index.build_index(frames(spark, docs).limit(0), SCHEMA))) == []


def test_empty_values_veto_under_deny(spark):
    fields = (*FIELDS[:3], FieldSpec("nGramField", "journal", 3, "DENY_DUP", min_score=0.7))
    schema = MatchSchema("s", fields, (Tier(0.6, 0),))
    docs = [["a", "1", "dengue in brazil", ""], ["a", "2", "dengue in brazil", "lancet"]]
    got = found(match.match(frames(spark, docs), index.build_index(frames(spark, docs), schema)))
    assert [(q, d) for q, d, _ in got] == [(1, 1)]


def test_rendered_lines(spark):
    docs = [["db|x", "1", 'dengue "in" brazil', "Silva, J//@//Lee", "2019", "en", "12", "Lancet", "we study zika", "n"]]
    hit = match.match(frames(spark, docs), index.build_index(frames(spark, docs), SCHEMA), report=True)
    short = render.short_lines(hit, SCHEMA).first().line.split("|")
    assert short[1:6] == ["1.0", "1", "1", 'dengue "in" brazil', 'dengue "in" brazil']
    full = render.full_lines(hit, SCHEMA).first().line.split("|")
    assert len(full) == 2 + 4 * 10 and full[8:10] == ["Silva, J//@//Lee", "leesilvaj"] and full[28:30] == ["Silva, J//@//Lee", "lee,silvaj"]
    report = render.report_lines(hit, SCHEMA).first().line.split("|")
    assert render.report_header(SCHEMA).split("|")[:4] == ["database_1", "database_2", "database_similarity", "database_veridict"]
    assert report[-8:] == ["westudyzika", "westudyzika", "1.0", "SIMILAR", "n", "n", "1.0", "IGNORE"]
    made = render.json_lines(hit, SCHEMA).first().line
    assert made.startswith('{ "database":"dbx", "id":"1", "title":"dengueinbrazil", "authors":["lee", "silvaj"], "year":"2019"') and '"abstract"' not in made
    assert render.numbered(render.json_lines(hit, SCHEMA)).first().line.startswith("1) { ")


def test_upserts_deletes_export(spark):
    rows = [["d", "1", "first one", *["x"] * 7], ["e", "1", "second", *["x"] * 7], ["d", "ABC-1", "t", *["x"] * 7], ["d", "ABC-1", "u", *["x"] * 7], ["d", "abd2", "v", *["x"] * 7]]
    docs = index.shape_documents(frames(spark, rows), SCHEMA)
    assert sorted(r.seq for r in index.upserted(docs).collect()) == [1, 2, 3, 4]
    assert sorted(r.seq for r in index.upserted(docs, "normalized").collect()) == [1, 3, 4]
    assert sorted(r.seq for r in index.upserted(docs, "db_id").collect()) == [0, 1, 3, 4]
    ids = lambda df: sorted(r.seq for r in df.collect())
    assert ids(index.deleted(docs, "abc-1")) == [0, 1, 4]
    assert ids(index.deleted(docs, "abc*")) == [0, 1, 4] and ids(index.deleted(docs, "abc*", legacy_prefix=True)) == [0, 1]
    assert ids(index.deleted(docs, "*")) == []
    assert index.exported(docs, SCHEMA).orderBy("seq").first().line == "d|1|first one|x|x|x|x|x|x|x"


def test_required_fields(spark):
    rows = [["d", "1", "t", "", "", "en", "12", "", "", ""], ["d", "2", "t", "", "2019", "en", "", "", "", ""]]
    assert [r.id for r in index.required_violations(index.shape_documents(frames(spark, rows), SCHEMA), SCHEMA).collect()] == ["1"]


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "seq long, line string")


def test_parsing(spark):
    schema = MatchSchema("s", (*FIELDS[:3], FieldSpec("noCompField", "note", 3)), (Tier(0.5, 0),))
    given = lines(spark, " d | 1 | a: b &amp; &#58;c | n | more ", "", "  ", "d|1|x", "|1|x|n", "d||x|n")
    good, bad = records.parse_records(given, schema, strict=False)
    assert [(r.seq, r.fields) for r in good.collect()] == [(0, ["d", "1", "a  b &  c", "n", "more"])]
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [(3, "too few fields"), (4, "no database"), (5, "no id")]
    for parts in (1, 3, 6):  # of several bad lines the first one is named, however they are dealt
        with pytest.raises(ValueError, match=re.escape("too few fields: d|1|x")):
            records.parse_records(given.repartition(parts), schema)
    queries = records.parse_queries(lines(spark, "d|1|a: &#58;c|n", 'd|1|"a|b"|n'), schema, exact=False)
    assert [r.fields for r in queries.orderBy("seq").collect()] == [["d", "1", "a  :c", "n"], ["d", "1", "a|b", "n"]]
    with pytest.raises(Exception, match="invalid number of fields"):
        records.parse_queries(lines(spark, "d|1|x"), schema).collect()
    made = lines(spark, '{"title": ["a", "b"], "note": 5, "id": "no"}', "{}")
    assert [r[0] for r in made.orderBy("seq").select(records.json_to_pipe(F.col("line"), schema, F.lit("D"), F.lit("7"))).collect()] == ["D|7|a//@//b|5", "D|7||"]
    odd = ['{"title": "[Draft] A study", "note": "{x"}', '{"title": "true", "note": null}', '{"title": "[\\"a\\"]", "note": []}', '{"title": 1.50, "note": ["x"]}']
    assert [r[0] for r in lines(spark, *odd).orderBy("seq").select(records.json_to_pipe(F.col("line"), schema, F.lit("D"), F.lit("7"))).collect()] == ["D|7|[Draft] A study|{x", "D|7|true|", 'D|7|["a"]|', "D|7|1.5|x"]
    for value in ("true", '{"a": 1}', "[1]", "[[]]"):
        with pytest.raises(Exception, match="unsupported value"):
            lines(spark, f'{{"title": {value}}}').select(records.json_to_pipe(F.col("line"), schema, F.lit("D"), F.lit("7"))).collect()


def test_bad_bytes_are_set_apart(spark, tmp_path):
    path = tmp_path / "mixed.txt"
    path.write_bytes("d|1|é|n\n".encode() + b"d|2|\xff\xfe|n\n" + b"d|3|x|n\n")
    good, bad = records.sound_lines(records.read_lines(spark, str(path)))
    assert [r.line for r in good.orderBy("seq").collect()] == ["d|1|é|n", "d|3|x|n"] and [bytes(r.bytes) for r in bad.collect()] == [b"d|2|\xff\xfe|n"]
    several = spark.createDataFrame([(1, " a|b \n c|d\n"), (2, "e")], "seq long, text string")
    assert sorted((r.seq, r.line) for r in records.lines_of_documents(several).collect()) == [(1, "a|b"), (1, "c|d"), (2, "e")]


def test_pairs_are_counted_once_per_key(spark):
    rows = [(0, 1, "1", "D", "2", "d"), (1, 1, "2", "D", "1", "d"), (1, 2, "2", "D", "2", "d")]
    df = spark.createDataFrame([(a, b, c, c, d, e, f) for a, b, c, d, e, f in rows], "q_seq long, rank int, q_id_raw string, q_id string, q_database_raw string, id string, database string")
    assert sorted((r.q_seq, r.rank) for r in match.first_of_pairs(df).collect()) == [(0, 1), (1, 2)]
