"""Running sums over a whole table in order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.llm.workspace import Workspace


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, str], ws: Workspace, name: str) -> DataFrame:
    """``rows`` with, for each ``result: column`` of ``sums``, the sum of the column over all rows before this one.

    Rows are dealt to ranges of ``order`` (which should tell rows apart) and written; only one row of sums a range meets in one task.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ws.save(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    parts = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{r}") for r, c in sums.items()])
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_sum_{r}").over(ranges), F.lit(0)).alias(f"_sum_{r}") for r in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({r: F.coalesce(F.sum(c).over(own), F.lit(0)) for r, c in sums.items()})
    joined = inside.join(F.broadcast(parts), "_part")  # a row a range
    return joined.withColumns({r: F.col(r) + F.col(f"_sum_{r}") for r in sums}).drop("_part", *[f"_sum_{r}" for r in sums])
