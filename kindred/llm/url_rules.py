"""URL filters as a sort-merge range join with a stack sweep.

A host is turned into its reversed labels (``a.example.com`` -> ``com,example,a,``), so "this host and all its
subdomains" is one interval of keys.  URLs and rules are dealt to ranges of ``(host key, path)``; a rule goes to every
range that its interval meets.  Each range is sorted and swept once: a stack holds the nested hosts whose interval is
open, and each of its frames holds the sorted intervals of the path prefixes ruled there, each with the one around it.  The longest
fitting rule (deepest host, then longest path) decides; a URL that no rule fits gets ``default``.

The bounds of the ranges are quantiles of a sample of keys and paths, cut to ``BOUND_CHARS``; only one bound a range comes to the driver.
A host and path that so many URLs share that several bounds equal it is spread by a hash over the ranges between those bounds.

Defined cases: a null URL, or one without ``://``, has host and path empty and fits only a rule with an empty host; an
empty rule host fits every URL.  A rule whose host or path is null is ignored.  Repeated rules with unequal verdicts
block.  Repeated rows are judged row by row; an empty table gives an empty result; extra columns are carried along,
and one named like a result column is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kindred.llm.workspace import ship

RULE_SCHEMA = "host string, path string, verdict string"
#: URLs looked at for the bounds of each range; bounds decide only how even the ranges are.
SAMPLE_PER_RANGE, BOUND_CHARS = 64, 200

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a comma; the empty host is the empty key."""
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.", -1)))
    return F.when(host == "", "").otherwise(F.concat(labels, F.lit(",")))


class _Frame:
    """Path prefixes ruled for one host, as nested intervals in order of path."""

    def __init__(self, key: str) -> None:
        self.key, self.rules = key, {}
        self.paths: list[str] | None = None
        self.around: list[int] = []

    def add(self, host: str, path: str, verdict: str) -> None:
        if self.rules.get(path, ("", ""))[1] != "block":
            self.rules[path] = (host + path, verdict)
        self.paths = None

    def _nest(self) -> None:
        """Sorts the intervals and finds the one around each with a stack."""
        self.paths, self.around, open_ = sorted(self.rules), [], []
        for i, path in enumerate(self.paths):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            open_.append(i)

    def find(self, path: str) -> tuple[str, str] | None:
        if self.paths is None:
            self._nest()
        # The last interval that begins at or before the path, or one around it.
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.around[at]
        return self.rules[self.paths[at]] if at >= 0 else None


def sweep(rows: Iterable[tuple]) -> Iterator[tuple[str | None, str | None]]:
    """``(range, host key, is_url, host, path, verdict)`` in order -> ``(rule, verdict)`` of each URL."""
    stack: list[_Frame] = []
    part = None
    for at, key, is_url, host, path, verdict in rows:
        if at != part:
            part, stack = at, []
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if not is_url:
            if not stack or stack[-1].key != key:
                stack.append(_Frame(key))
            stack[-1].add(host, path, verdict)
        else:
            yield next((found for frame in reversed(stack) if (found := frame.find(path))), (None, None))


def _bounds(urls: DataFrame, n: int) -> list[tuple[str, str]]:
    """At most ``n - 1`` quantiles of ``(_key, _path)``; equal ones stay, as they tell of a crowded place."""
    cut = [F.substring(c, 1, BOUND_CHARS).alias(c) for c in ("_key", "_path")]
    sample = urls.select(*cut, F.xxhash64("_salt", "_key", "_path").alias("_h")).orderBy("_h").limit(n * SAMPLE_PER_RANGE)
    # The sample is bounded by its size and by BOUND_CHARS, so one task can number it.
    place = F.row_number().over(Window.orderBy("_key", "_path")) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy())
    placed = sample.select("_key", "_path", place.alias("_at"), total.alias("_n"))
    steps = F.floor(F.col("_at") * n / F.col("_n"))
    first = (F.col("_at") > 0) & (steps > F.floor((F.col("_at") - 1) * n / F.col("_n")))
    return sorted((r[0], r[1]) for r in placed.where(first).select("_key", "_path").collect())


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    spark = pages.sparkSession
    ship(spark)
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    link = F.col(f"`{url}`")
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), host_of(link).alias("_host"), path_of(link).alias("_path"))
    urls = urls.withColumns({"_key": host_key(F.col("_host")), "_salt": F.pmod(F.xxhash64("_row"), F.lit(1 << 30))})

    bounds = _bounds(urls, n)
    low = [b[0] for b in bounds]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for key, path, h in zip(*[batch.column(c).to_pylist() for c in ("_key", "_path", "_salt")]):
                place = (key[:BOUND_CHARS], path[:BOUND_CHARS])
                first, last = bisect_left(bounds, place), bisect_right(bounds, place)
                at.append(last if last - first < 2 else first + 1 + h % (last - first))
            yield batch.append_column("_range", pa.array(at, pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, verdict, key in zip(*[batch.column(c).to_pylist() for c in ("_host", "_path", "_verdict", "_key")]):
                start = key[:BOUND_CHARS]
                first = bisect_left(bounds, (start, ""))
                last = bisect_right(low, start + "\U0010ffff")
                rows += [(key, host, path, verdict, i) for i in range(first, last + 1)]
            names = ("_key", "_host", "_path", "_verdict", "_range")
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    at = T.StructType([*urls.schema.fields, T.StructField("_range", T.IntegerType())])
    left = urls.mapInArrow(dealt, at).select("_range", "_key", F.lit(1).alias("_url"), "_host", "_path", F.lit(None).cast("string").alias("_verdict"), "_row")
    ruled = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(F.translate("host", *_LOWER).alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    ruled = ruled.withColumn("_key", host_key(F.col("_host")))
    right = ruled.mapInArrow(spread, "_key string, _host string, _path string, _verdict string, _range int")
    right = right.select("_range", "_key", F.lit(0).alias("_url"), "_host", "_path", "_verdict", F.lit(None).cast(urls.schema["_row"].dataType).alias("_row"))
    both = left.unionByName(right).repartitionById(n, F.col("_range")).sortWithinPartitions("_range", "_key", "_url", "_path")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                wanted.append(batch)
                yield from zip(*[batch.column(c).to_pylist() for c in ("_range", "_key", "_url", "_host", "_path", "_verdict")])

        found = sweep(rows())
        rule: list = []
        verdict: list = []
        for r, v in found:
            rule.append(r)
            verdict.append(v)
            while wanted and len(rule) >= (k := _urls(wanted[0])):
                yield _out(wanted.pop(0), rule[:k], verdict[:k])
                del rule[:k], verdict[:k]
        while wanted:
            k = _urls(wanted[0])
            yield _out(wanted.pop(0), rule[:k], verdict[:k])
            del rule[:k], verdict[:k]

    schema = T.StructType([urls.schema["_row"], T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    out = both.mapInArrow(judged, schema)
    return out.select("_row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _urls(batch: pa.RecordBatch) -> int:
    return int(pa.compute.sum(batch.column("_url")).as_py() or 0)


def _out(batch: pa.RecordBatch, rule: list, verdict: list) -> pa.RecordBatch:
    kept = batch.filter(pa.compute.equal(batch.column("_url"), 1))
    arrays = [kept.column("_row"), kept.column("_host"), kept.column("_path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
    return pa.record_batch(arrays, names=["_row", "host", "path", "rule", "verdict"])
