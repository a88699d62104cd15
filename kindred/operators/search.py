"""Search for one record in a written index; only the postings of its grams are read."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.functions import text
from kindred.operators import match, render, segments
from kindred.operators.index import Index
from kindred.plans.schema import MatchSchema
from kindred.sources import records


def narrowed(index: Index, queries: DataFrame, double_pass: bool = False) -> Index:
    """The index with the postings of the grams of a few ``queries(seq, fields)`` only.

    Postings lie sorted by gram, so the filter on their (at most ``MAX_TEXT`` a query) grams leaves most files and row groups unread.
    """
    value = text.search_text(F.coalesce(F.get("fields", F.lit(index.schema.indexed.pos)), F.lit("")))
    found = queries.select(F.explode(text.query_grams(value, index.schema.gram, double_pass)).alias("gram")).distinct().collect()
    return dataclasses.replace(index, postings=index.postings.where(F.col("gram").isin(sorted(r.gram for r in found))))


def matches(spark: SparkSession, path: str, schema: MatchSchema, line: str, exact: bool = True, **options) -> DataFrame:
    """Accepted pairs of one query line (:func:`kindred.operators.match.match`)."""
    queries = records.parse_queries(spark.createDataFrame([(0, line)], "seq long, line string"), schema, exact=exact)
    return match.match(queries, narrowed(segments.open_index(spark, path, schema), queries, options.get("double_pass", False)), **options)


def search(spark: SparkSession, path: str, schema: MatchSchema, line: str, report: bool = False, self_check: bool = False, use_similarity: bool = True) -> DataFrame:
    """``n, line``: numbered full lines, or the report, of the matches of one query line; highest string first."""
    found = matches(spark, path, schema, line, report=report, self_check=self_check, use_similarity=use_similarity)
    return render.numbered((render.report_lines if report else render.full_lines)(found, schema)).select("n", "line")


def search_json(spark: SparkSession, path: str, schema: MatchSchema, line: str, self_check: bool = False, use_similarity: bool = True) -> DataFrame:
    """``n, line``: the matches as JSON objects; the number of fields isn't checked."""
    found = matches(spark, path, schema, line, exact=False, self_check=self_check, use_similarity=use_similarity)
    return render.numbered(render.json_lines(found, schema)).select("n", "line")
