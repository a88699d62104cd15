"""Text functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kindred.functions import similarity, text


def register(spark: SparkSession) -> None:
    """Makes ``normalize_text(x)``, ``dice_similarity(a, b)`` and ``ngram_similarity(a, b)`` known to this session's SQL.

    The first two are SQL functions, which the optimiser puts in place of their calls; the third runs in Arrow batches.
    """
    trimmed = r"regexp_replace({}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '')"
    low = f"lower({trimmed.format('x')})"
    each = f"array_join(array_sort(array_distinct(transform(split({low}, '{text.OCCURRENCE}', -1), p -> {trimmed.format('p')}))), '{text.OCCURRENCE}')"
    ordered = f"CASE WHEN contains({low}, '{text.OCCURRENCE}') THEN {each} ELSE {low} END"
    plain = f"translate({ordered}, '{text._ACCENTED}', '{text._PLAIN}')"
    spaced = f"regexp_replace({plain}, '[^a-z0-9]+', ' ')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(x STRING) RETURNS STRING RETURN regexp_replace({spaced}, '(?<![0-9]) | (?![0-9])', '')")
    grams = "CASE WHEN length({0}) > 1 THEN transform(sequence(1, length({0}) - 1), i -> substring({0}, i, 2)) ELSE array() END"
    count = "size(filter({}, o -> o = g))"
    common = f"aggregate(array_distinct({grams.format('a')}), 0, (s, g) -> s + least({count.format(grams.format('a'))}, {count.format(grams.format('b'))}))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dice_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN length(a) > 1 AND length(b) > 1 THEN 2.0D * {common} / (length(a) + length(b) - 2) ELSE 0.0D END")
    spark.udf.register("ngram_similarity", similarity._ngram_similarity)
