import pytest


from kindred.__main__ import main
from kindred.functions import similarity
from kindred.operators import tools
from kindred.sources.records import read_lines

XML = """<config><score minValue="0.7" minFields="1"/><databaseField pos="0"/><idField pos="1"/><idxNGramField pos="2" name="title"/><exactField pos="3" name="year"/></config>"""


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "seq long, line string")


def test_group_count(spark):
    got = tools.group_count_lines(tools.group_count(lines(spark, "a | x", " b|y ", "", "c|x|z"), 1)).collect()
    assert [r.line for r in got] == ["x : 2", "y : 1"]
    with pytest.raises(Exception, match="no such column"):
        tools.group_count(lines(spark, "a"), 1).collect()


def test_common_lines(spark):
    first, second = lines(spark, "k1|a", "k1|b", "short"), lines(spark, "x|k1", "y|k2", "z|k1", "w")
    assert [r.line for r in tools.common_lines(first, 0, second, 1).orderBy("seq").collect()] == ["x|k1", "z|k1"]
    assert [r.line for r in tools.common_lines(first, 0, second, 1, True).orderBy("seq").collect()] == ["k1|b", "k1|b"]
    assert [r.line for r in tools.common_whole_lines(lines(spark, " a", "b"), lines(spark, "a ", "c", "a", "")).orderBy("seq").collect()] == ["a", "a"]


def test_compare_files(spark):
    first, second = lines(spark, "a", "b", "b", " "), lines(spark, "b", "c")
    found = tools.compare_files(first, second)
    assert [r.line for r in tools.compare_lines(found).collect()] == ["<< a", ">> c", "== b"]
    assert {r.section: r.n for r in tools.compare_totals(tools.compare_files(first, second, "onlyleft")).collect()} == {"left": 1, "right": 0, "common": 0}
    groups = tools.compare_files(lines(spark, "id=1 x", "id=2", "none"), lines(spark, "v 2"), "all", r"id=(?<n>\d)", "n", r"(v) (?<m>\d)", "m")
    assert sorted(map(tuple, groups.collect())) == [("common", "2"), ("left", "1")]
    assert sorted(map(tuple, tools.difference(first, second).collect())) == [("<", "a"), ("<>", "b"), (">", "c")]


def test_adjacent_lines(spark):
    values = ["dengue in brazil|x", "dengue in brasil", "", "dengue in brasil", "zika", "zikas"] * 3
    sim = lambda a, b: round(float(similarity.ngram_similarities([a], [b])[0]), 5)
    flat, want = [v.split("|")[0].replace(" ", "") for v in values], []
    for i in range(1, len(flat)):
        if flat[i] and sim(flat[i - 1], flat[i]) >= 0.35:
            want.append((i, sim(flat[i - 1], flat[i])))
    got = [(r.seq, round(float(r.dist), 5)) for r in tools.adjacent_similarity(lines(spark, *values)).orderBy("seq").collect()]
    assert got == want and len(got) > 3
    for n in (1, 3, 50):
        rows = tools.with_previous(spark.createDataFrame([(x * x, f"v{x}") for x in range(40)], "o long, v string"), "o", "v", "p", n)
        assert [(r.v, r.p) for r in rows.orderBy("o").collect()] == [(f"v{x}", f"v{x - 1}" if x else None) for x in range(40)]


def test_threshold_report(spark):
    rows = [f"1|0.{s}|q{s}|d|st|it|a|b" for s in (9, 8, 7, 9, 8)]
    got = tools.threshold_report(lines(spark, "header", *rows)).orderBy("similarity", "seq").collect()
    assert [r.similarity for r in got] == ["0.7", "0.8", "0.8", "0.9"]
    assert got[0].block == "similarity: 0.7\nstext: st\nitext: it\nsid: q7 iid: d\n"


def test_line_numbers_follow_the_file(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("\n".join(f"línea {i}" for i in range(5000)), encoding="utf-8")
    got = read_lines(spark, str(path)).orderBy("seq").collect()
    assert [r.line for r in got] == [f"línea {i}" for i in range(5000)]
    path.write_text("é\nü", encoding="latin-1")
    assert [r.line for r in read_lines(spark, str(path), "ISO-8859-1").orderBy("seq").collect()] == ["é", "ü"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "config.xml").write_text(XML)
    (tmp_path / "docs.txt").write_text("L|1|dengue in brazil|2019\nM|2|dengue in brasil|2019\nM|3|other things|2001\n")
    where = [str(tmp_path / "ix"), str(tmp_path / "config.xml"), "utf-8"]

    def run(*args):
        capsys.readouterr()
        main(list(args))
        return capsys.readouterr().out.splitlines()[:-1]

    run("index", *where, str(tmp_path / "docs.txt"), "utf-8")
    run("search1", *where, str(tmp_path / "docs.txt"), "utf-8", str(tmp_path / "out"), "--single-file")
    out = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert out[0].startswith("rank|similarity") and len(out) == 6 and sorted(x.split("|")[2] + x.split("|")[3] for x in out[1:]) == ["11", "12", "21", "22", "33"]
    assert len(run("search2", *where, "X|9|dengue in brazil|2019")) == 2
    assert run("search2", *where, "X|9|dengue in brazil|2019", "--json")[0].startswith('1) { "database":')
    assert run("search3", *where, "X|9|dengue in brazil|2019") == []
    run("export", *where, str(tmp_path / "exported"), "utf-8")
    assert sorted(x for p in (tmp_path / "exported").glob("part-*") for x in p.read_text().splitlines())[0] == "L|1|dengue in brazil|2019"
    assert run("check-index", *where) == ["ok"]
    assert "den" in run("terms", *where)
    run("delete", *where, "1")
    assert len(run("search2", *where, "X|9|dengue in brazil|2019")) == 1
    assert run("distance", "night", "nacht") == ["0.56666666"]
    assert run("tokens", "abcd") == ["abc [0,3]", "bcd [1,4]"]
    (tmp_path / "two.txt").write_text("a|x\nb|x\n")
    assert run("aggregate", str(tmp_path / "two.txt"), "utf-8", "1") == ["x : 2"]
    assert run("compare-files", str(tmp_path / "two.txt"), "utf-8", str(tmp_path / "two.txt"), "utf-8")[:2] == ["== a|x", "== b|x"]
    (tmp_path / "result.txt").write_text("header\n" + "\n".join(out[1:]) + "\n")
    run("compare-results", *where, str(tmp_path / "result.txt"), "utf-8", str(tmp_path / "compared"))
    assert "<identical> 2 2" in "".join(p.read_text() for p in (tmp_path / "compared").glob("part-*"))


def test_streamed_lines_are_upserted(spark, tmp_path):
    from kindred.operators import index, segments
    from kindred.plans.schema import MatchSchema
    from kindred.streaming.upserts import follow_lines

    schema, path = MatchSchema.from_xml("s", XML), str(tmp_path / "ix")
    first = spark.createDataFrame([(0, ["L", "1", "old title", "2019"])], "seq long, fields array<string>")
    segments.write_index(index.build_index(first, schema), path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"L|1|new title|2020\nL|2|second|2020\nbad line\nL|3|\xff|2020\n")
    follow_lines(spark, str(tmp_path / "in"), path, schema, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.id, r.title) for r in segments.open_index(spark, path, schema).docs.collect()) == [("1", "newtitle"), ("2", "second")]
    refused = spark.read.parquet(f"{path}/rejected/batch=0").collect()
    assert sorted((r.reason, bytes(r.bytes)) for r in refused) == [("not UTF-8", b"L|3|\xff|2020"), ("too few fields", b"bad line")]
