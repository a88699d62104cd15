"""Command line: ``python -m kindred <command> ...``."""

from __future__ import annotations

import argparse
import dataclasses
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.functions import similarity, text
from kindred.operators import index, match, render, search, segments, tools
from kindred.plans.schema import MatchSchema
from kindred.sources import records


def _session() -> SparkSession:
    return SparkSession.builder.appName("kindred").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(lines: DataFrame) -> None:
    for row in lines.toLocalIterator():
        print(row[0])


def _schema(args: argparse.Namespace) -> MatchSchema:
    schema = MatchSchema.from_file(args.index.rstrip("/").rpartition("/")[2], args.config, args.config_encoding)
    return dataclasses.replace(schema, gram=args.gram, rough_lengths=args.rough_lengths)


def _parsed(args: argparse.Namespace, schema: MatchSchema) -> DataFrame:
    """The records of the input; bytes that aren't text, and with ``--permissive`` lines that aren't records, go to a file of their own."""
    lines, broken = records.sound_lines(records.read_lines(_session(), args.input, args.encoding))
    good, bad = records.parse_records(lines, schema, strict=not args.permissive)
    broken.write.mode("overwrite").parquet(f"{args.index}/rejected/bytes")
    if args.permissive:
        bad.write.mode("overwrite").parquet(f"{args.index}/rejected/lines")
    return good


def index_command(args: argparse.Namespace) -> None:
    schema = _schema(args)
    segments.write_index(index.build_index(_parsed(args, schema), schema, args.upsert_key), args.index)


def add_command(args: argparse.Namespace) -> None:
    schema = _schema(args)
    segments.add_records(_session(), args.index, schema, _parsed(args, schema), args.upsert_key)


def search1_command(args: argparse.Namespace) -> None:
    spark, schema = _session(), _schema(args)
    queries = records.parse_queries(records.read_lines(spark, args.input, args.encoding), schema)
    if args.new_pairs:
        found = segments.new_pairs(spark, args.index, schema, queries, report=args.report, mode=args.mode)
    else:
        found = match.match(queries, segments.open_index(spark, args.index, schema), report=args.report, self_check=args.self_check, mode=args.mode)
    lines = render.report_lines(found, schema) if args.report else render.short_lines(found, schema)
    render.write_lines(lines, args.output, render.report_header(schema) if args.report else render.HEADER, args.single_file, args.output_encoding)


def _point(args: argparse.Namespace, use_similarity: bool) -> None:
    spark, schema = _session(), _schema(args)
    if args.json:
        found = search.search_json(spark, args.index, schema, args.text, use_similarity=use_similarity)
    else:
        found = search.search(spark, args.index, schema, args.text, report=args.report, use_similarity=use_similarity)
    _show(found.orderBy("n").select("line"))


def export_command(args: argparse.Namespace) -> None:
    schema = _schema(args)
    docs = segments.open_index(_session(), args.index, schema).docs
    index.exported(docs, schema).orderBy("seq").select(F.col("line").alias("value")).write.mode("overwrite").option("encoding", args.encoding).text(args.output)


def delete_command(args: argparse.Namespace) -> None:
    segments.delete_record(_session(), args.index, _schema(args), args.id, args.legacy_prefix)


def merge_command(args: argparse.Namespace) -> None:
    spark = _session()
    segments.merge(spark, args.index, _schema(args), everything=True)
    segments.vacuum(spark, args.index)


def check_index_command(args: argparse.Namespace) -> None:
    schema = _schema(args)
    bad = index.required_violations(segments.open_index(_session(), args.index, schema).docs, schema).select("id_raw").orderBy("id_raw").limit(1).collect()
    print(f"bad document: {bad[0][0]}" if bad else "ok")


def terms_command(args: argparse.Namespace) -> None:
    schema = _schema(args)
    _show(index.terms(segments.open_index(_session(), args.index, schema).docs, schema.indexed.name, schema.gram).orderBy("term"))


def tokens_command(args: argparse.Namespace) -> None:
    one = _session().createDataFrame([(args.text,)], "t string")
    _show(one.select(F.explode(text.gram_offsets(F.col("t"))).alias("g")).select(F.format_string("%s [%d,%d]", "g.term", "g.start", "g.end")))


def distance_command(args: argparse.Namespace) -> None:
    a, b = args.first, args.second
    if args.normalize:
        row = _session().createDataFrame([(a, b)], "a string, b string").select(text.search_text(F.col("a")), text.search_text(F.col("b"))).first()
        a, b = row[0], row[1]
    print(similarity.ngram_similarities([a], [b])[0])


def aggregate_command(args: argparse.Namespace) -> None:
    _show(tools.group_count_lines(tools.group_count(records.read_lines(_session(), args.input, args.encoding), args.column)))


def common_lines_command(args: argparse.Namespace) -> None:
    spark = _session()
    first, second = (records.read_lines(spark, p, e) for p, e in ((args.first, args.encoding1), (args.second, args.encoding2)))
    if args.column1 is None:
        _show(tools.common_whole_lines(first, second).orderBy("seq").select("line"))
    else:
        _show(tools.common_lines(first, args.column1, second, args.column2, args.show == "first").orderBy("seq").select("line"))


def compare_files_command(args: argparse.Namespace) -> None:
    spark = _session()
    first, second = (records.read_lines(spark, p, e) for p, e in ((args.first, args.encoding1), (args.second, args.encoding2)))
    found = tools.compare_files(first, second, args.mode, args.pattern1, args.group1, args.pattern2 or args.pattern1, args.group2 or args.group1)
    _show(tools.compare_lines(found))
    for row in tools.compare_totals(found).collect():
        print(f"{row.section}: {row.n}")


def diff_command(args: argparse.Namespace) -> None:
    spark = _session()
    first, second = (records.read_lines(spark, p, e) for p, e in ((args.first, args.encoding1), (args.second, args.encoding2)))
    _show(tools.difference(first, second).orderBy("line").select(F.concat_ws(" ", "mark", "line")))


def adjacent_command(args: argparse.Namespace) -> None:
    found = tools.adjacent_similarity(records.read_lines(_session(), args.input, args.encoding), args.floor)
    _show(found.orderBy("seq").select(F.concat(F.lit("dist="), F.concat_ws("|", F.col("dist").cast("string"), "s1", "s2"))))


def compare_results_command(args: argparse.Namespace) -> None:
    spark, schema = _session(), _schema(args)
    lines = records.read_lines(spark, args.input, args.encoding)
    first = lines.orderBy("seq").limit(1).agg(F.max("seq").alias("_last"))
    lines = lines.crossJoin(F.broadcast(first)).where("seq > _last").drop("_last")
    found = tools.compare_results(lines, segments.open_index(spark, args.index, schema).docs, [f.name for f in schema.fields])
    block = F.concat(F.concat_ws(" ", "label", "id1", "id2"), F.when(F.col("differences") != "", F.concat(F.lit("\n"), "differences")).otherwise(""), F.lit("\n"))
    found.orderBy("seq").select(block.alias("value")).write.mode("overwrite").text(args.output)


def report_command(args: argparse.Namespace) -> None:
    found = tools.threshold_report(records.read_lines(_session(), args.input, args.encoding), args.skip_lines)
    found.orderBy("similarity", "seq").select(F.col("block").alias("value")).write.mode("overwrite").text(args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kindred")
    top.add_argument("--gram", type=int, default=text.GRAM, help="size of the grams of the index")
    top.add_argument("--rough-lengths", action="store_true", help="score with lengths as one byte keeps them")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: str, of_index: bool = False, **flags) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if of_index:
            p.add_argument("index")
            p.add_argument("config")
            p.add_argument("config_encoding")
        for a in arguments:
            p.add_argument(a)
        p.set_defaults(run=run)
        return p

    for name, run in (("index", index_command), ("add", add_command)):
        p = command(name, run, "input", "encoding", of_index=True)
        p.add_argument("--permissive", action="store_true", help="set bad lines apart instead of failing")
        p.add_argument("--upsert-key", choices=("raw", "normalized", "db_id"), default="raw")
    p = command("search1", search1_command, "input", "encoding", "output", of_index=True)
    p.add_argument("output_encoding", nargs="?", default="UTF-8")
    for flag in ("--report", "--self-check", "--single-file", "--new-pairs"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--mode", choices=("early_stop", "ranked", "exhaustive"), default="early_stop")
    for name, use in (("search2", True), ("search3", False)):
        p = command(name, lambda args, use=use: _point(args, use), "text", of_index=True)
        p.add_argument("--report", action="store_true")
        p.add_argument("--json", action="store_true")
    command("export", export_command, "output", "encoding", of_index=True)
    command("delete", delete_command, "id", of_index=True).add_argument("--legacy-prefix", action="store_true")
    command("merge", merge_command, of_index=True)
    command("check-index", check_index_command, of_index=True)
    command("terms", terms_command, of_index=True)
    command("tokens", tokens_command, "text")
    command("distance", distance_command, "first", "second").add_argument("--normalize", action="store_true")
    command("aggregate", aggregate_command, "input", "encoding").add_argument("column", type=int)
    for name, run in (("common-lines", common_lines_command), ("compare-files", compare_files_command), ("diff", diff_command)):
        p = command(name, run, "first", "encoding1", "second", "encoding2")
        if name == "common-lines":
            p.add_argument("--column1", type=int)
            p.add_argument("--column2", type=int)
            p.add_argument("--show", choices=("first", "second"), default="second")
        elif name == "compare-files":
            p.add_argument("--mode", choices=sorted(tools.MODES), default="all")
            for x in ("--pattern1", "--group1", "--pattern2", "--group2"):
                p.add_argument(x)
    command("adjacent", adjacent_command, "input", "encoding").add_argument("--floor", type=float, default=tools.ADJACENT_FLOOR)
    command("compare-results", compare_results_command, "input", "encoding", "output", of_index=True)
    command("report", report_command, "input", "encoding", "output").add_argument("--skip-lines", type=int, default=2)
    return top


def main(argv: list[str] | None = None) -> None:
    began = time.monotonic()
    args = parser().parse_args(argv)
    args.run(args)
    print(f"{time.monotonic() - began:.0f} s")


if __name__ == "__main__":
    main()
