from pyspark.sql import functions as F

from kindred.functions import text


def test_references_are_replaced_without_python(spark):
    given = [("a &amp; b&#65279;&#x1F600;&nope;&#55296;&#1114112;&lt&&copy;", "a & b﻿😀&nope;&#55296;&#1114112;&lt&©"), ("none", "none"), ("&#0;", "\0"), (None, None)]
    df = spark.createDataFrame(given, "x string, want string").withColumn("got", text.unescape_html(F.col("x")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert all(r.got == r.want for r in df.collect())
