"""Relational tools over line files ``(seq, line)`` and over results of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions import similarity, text

#: Least similarity and text bound of the adjacent comparison.
ADJACENT_FLOOR, ADJACENT_TEXT = 0.35, 100
#: Ranges that ordered rows are dealt to; bounds what meets in one task.
RANGES = 4096


def _filled(lines: DataFrame) -> DataFrame:
    return lines.select("seq", text.trim(F.col("line")).alias("line")).where("line <> ''")


def group_count(lines: DataFrame, column: int) -> DataFrame:
    """Rows for each value of a pipe column: ``key, n``; a line without the column fails."""
    parts = text.split_columns(F.col("line"))
    missing = F.raise_error(F.concat(F.lit("no such column: "), F.col("line"))).cast("string")
    key = F.when(F.size(parts) > column, F.get(parts, F.lit(column))).otherwise(missing)
    return _filled(lines).select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def group_count_lines(counts: DataFrame) -> DataFrame:
    """``key : n``, most frequent first."""
    return counts.orderBy(F.desc("n"), "key").select(F.concat_ws(" : ", "key", F.col("n").cast("string")).alias("line"))


def _keyed(lines: DataFrame, column: int) -> DataFrame:
    parts = text.split_columns(F.col("line"))
    return lines.where(F.size(parts) > column).select("seq", "line", F.get(parts, F.lit(column)).alias("key"))


def common_lines(first: DataFrame, column1: int, second: DataFrame, column2: int, show_first: bool = False) -> DataFrame:
    """Lines whose keys occur in both files: ``seq, line`` of the second file's order, and of its lines or the first's.

    Of the first file's lines with a key the last one counts.
    """
    left, right = _keyed(first, column1), _keyed(second, column2)
    if not show_first:
        return right.join(left, "key", "left_semi").select("seq", "line")
    last = left.groupBy("key").agg(F.max_by("line", "seq").alias("line"))
    return right.select("seq", "key").join(last, "key").select("seq", "line")


def common_whole_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of the second file that the first has too, trimmed; repeats stay."""
    return _filled(second).join(_filled(first).select("line").distinct(), "line", "left_semi").select("seq", "line")


#: Mark of each section, and the sections of each mode.
MARKS = {"left": "<<", "right": ">>", "common": "=="}
MODES = {"common": ("common",), "different": ("left", "right"), "onlyleft": ("left",), "onlyright": ("right",), "all": ("left", "right", "common")}


def compare_files(first: DataFrame, second: DataFrame, mode: str = "all", pattern1: str | None = None, group1: str | None = None, pattern2: str | None = None, group2: str | None = None) -> DataFrame:
    """``section, line`` of two files' distinct lines, or of named groups in them; one pass over both."""
    sides = [(first, pattern1, group1, 1), (second, pattern2, group2, 2)]
    both = None
    for lines, pattern, group, side in sides:
        found = _filled(lines).select(text.named_group(F.col("line"), pattern, group).alias("line"), F.lit(side).alias("side")).where("line IS NOT NULL")
        both = found if both is None else both.union(found)
    seen = both.groupBy("line").agg(F.bit_or("side").alias("sides"))
    section = F.when(F.col("sides") == 1, "left").when(F.col("sides") == 2, "right").otherwise("common")
    return seen.select(section.alias("section"), "line").where(F.col("section").isin(*MODES[mode]))


def compare_totals(compared: DataFrame) -> DataFrame:
    """Lines of each section; one that isn't shown has 0."""
    spark = compared.sparkSession
    sections = spark.createDataFrame([(s,) for s in MARKS], "section string")
    counts = compared.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    return sections.join(counts, "section", "left").select("section", F.coalesce("n", F.lit(0)).alias("n"))


def compare_lines(compared: DataFrame) -> DataFrame:
    """Marked lines, section after section."""
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    order = F.array_position(F.array(*map(F.lit, MARKS)), F.col("section"))
    return compared.orderBy(order, "line").select(F.concat_ws(" ", mark[F.col("section")], "line").alias("line"))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Marked distinct lines of two files, ``<>`` for those of both."""
    mark = F.when(F.col("section") == "common", "<>").when(F.col("section") == "left", "<").otherwise(">")
    return compare_files(first, second).select(mark.alias("mark"), "line")


def adjacent_similarity(lines: DataFrame, floor: float = ADJACENT_FLOOR) -> DataFrame:
    """``seq, dist, s1, s2`` of lines whose first column resembles that of the line before; a blank line starts anew.

    The order of the file is kept by ranges of ``seq``, so only the rows at their edges are passed on.
    """
    first = F.when(text.trim(F.col("line")) == "", "").otherwise(text.limit_size(text.normalize(F.get(text.split_columns(text.trim(F.col("line"))), F.lit(0))), ADJACENT_TEXT))
    own = lines.select("seq", F.coalesce(first, F.lit("")).alias("s2"))
    own = with_previous(own, "seq", "s2", "s1").withColumn("s1", F.coalesce("s1", F.lit("")))
    pairs = own.where("s2 <> ''").withColumn("dist", similarity.ngram_similarity(F.col("s1"), F.col("s2")))
    return pairs.where(F.col("dist") >= F.lit(floor).cast("float")).select("seq", "dist", "s1", "s2")


def with_previous(rows: DataFrame, order: str, value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the row before in ``order``.

    Rows are dealt to equal ranges of ``order``; the first row of a range takes the last value of the range before, so
    only one row a range meets in one task.
    """
    ends = F.broadcast(rows.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi")))
    part = F.floor((F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * ranges).cast("int")
    dealt = rows.crossJoin(ends).withColumn("_part", part).drop("_lo", "_hi")
    last = dealt.groupBy("_part").agg(F.max_by(value, order).alias("_v"))
    before = last.select(F.col("_part"), F.lag("_v").over(Window.orderBy("_part")).alias("_edge"))
    own = Window.partitionBy("_part").orderBy(order)
    lagged = dealt.withColumns({"_lag": F.lag(value).over(own), "_n": F.row_number().over(own)})
    joined = lagged.join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.when(F.col("_n") == 1, F.col("_edge")).otherwise(F.col("_lag"))).drop("_part", "_lag", "_n", "_edge")


def compare_results(results: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """Result lines joined to both documents: ``seq, similarity, id1, id2, label, differences``.

    Ids are looked up as stored (normalised); of several documents the first counts; a pair counts only if both exist.
    """
    parts = text.split_fields(text.trim(F.col("line")))
    pairs = _filled(results).select("seq", F.get(parts, F.lit(1)).alias("similarity"), F.get(parts, F.lit(2)).alias("id1"), F.get(parts, F.lit(3)).alias("id2"))
    raws = F.struct(*[F.col(f"{n}_raw") for n in names])
    first = docs.groupBy("id").agg(F.min_by(raws, "seq").alias("d"))
    both = pairs.join(first.select(F.col("id").alias("id1"), F.col("d").alias("d1")), "id1").join(first.select(F.col("id").alias("id2"), F.col("d").alias("d2")), "id2")
    value = lambda side, n: F.coalesce(F.col(f"{side}.{n}_raw"), F.lit(""))
    differs = F.array_compact(F.array(*[F.when(value("d1", n) != value("d2", n), F.concat(F.lit(f"[{n}]|"), value("d1", n), F.lit("|"), value("d2", n))) for n in names if n != "id"]))
    label = F.when(F.size("differences") == 0, "<identical>").when(F.col("similarity") == "1.0", "<very similar>").otherwise("<similar>")
    return both.withColumn("differences", differs).select("seq", "similarity", "id1", "id2", label.alias("label"), F.array_join("differences", "\n").alias("differences"))


def threshold_report(results: DataFrame, skip_lines: int = 2) -> DataFrame:
    """``similarity, seq, block`` of result lines, by similarity (as text) and then in file order; the first lines are skipped."""
    kept = results
    if skip_lines:
        skipped = F.broadcast(results.orderBy("seq").limit(skip_lines).agg(F.max("seq").alias("_last")))
        kept = results.crossJoin(skipped).where("seq > _last").drop("_last")
    parts = F.split(F.col("line"), r" *\| *", 8)
    get = lambda i: F.get(parts, F.lit(i))
    block = F.concat(F.lit("similarity: "), get(1), F.lit("\nstext: "), get(4), F.lit("\nitext: "), get(5), F.lit("\nsid: "), get(2), F.lit(" iid: "), get(3), F.lit("\n"))
    return _filled(kept).select(get(1).alias("similarity"), "seq", block.alias("block"))
