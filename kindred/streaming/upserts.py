"""A stream of piped lines kept in an index: each micro-batch is an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import segments
from kindred.plans.schema import MatchSchema
from kindred.sources.records import parse_records, sound_lines


def follow_lines(spark: SparkSession, folder: str, path: str, schema: MatchSchema, checkpoint: str, key: str = "raw") -> StreamingQuery:
    """Starts a query that upserts the lines of new files in ``folder`` into the index at ``path``.

    A batch writes what it brings and takes out (:func:`kindred.operators.segments.add_records`).  Versions name the batch that made them, so a batch that
    is run again after its version was committed changes nothing.  Lines that aren't records, or aren't UTF-8, go to ``rejected/batch=<n>`` below the index
    as ``seq, reason, bytes``.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        if number <= segments.last_batch(spark, path):
            return
        lines = batch.select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
        sound, broken = sound_lines(lines)
        good, bad = parse_records(sound, schema, strict=False)
        refused = bad.select("seq", "reason", F.col("line").cast("binary").alias("bytes")).unionByName(broken.select("seq", F.lit("not UTF-8").alias("reason"), "bytes"))
        refused.write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        segments.add_records(spark, path, schema, good, key, number)

    return spark.readStream.text(folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
