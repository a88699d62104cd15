"""Record sources: piped lines, query lines, JSON objects and plain line files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.functions import text
from kindred.plans.schema import MatchSchema
from kindred.sources import wide_lines


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``seq, line`` of one text file, and ``bytes`` of lines that can't be decoded where the charset isn't UTF-8 (their ``line`` is null).

    ``seq`` rises with the place in the file (offset of the split plus row in it).  Charsets with wide characters are split by a data source of our own.
    """
    name = wide_lines.plain(encoding)
    if name in wide_lines.CHARSETS:
        spark.dataSource.register(wide_lines.WideLines)
        return spark.read.format("wide_lines").option("encoding", encoding).load(path)
    rows = spark.read.text(path).select(F.col("value").alias("line"), "_metadata.file_block_start")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = rows.select((F.col("file_block_start") + row).alias("seq"), "line")
    if name in ("utf8", "usascii"):
        return rows
    if bytes(range(128)).decode(encoding) != bytes(range(128)).decode("ascii"):
        raise ValueError(f"{encoding} has other line feeds than ASCII")
    return rows.select("seq", _decoder(encoding)(F.col("line").cast("binary")).alias("_d")).select("seq", "_d.line", "_d.bytes")


def _decoder(encoding: str) -> Callable[[Column], Column]:
    """Text of the bytes of a line in a charset that keeps ASCII's line feeds, or the bytes."""

    def decoded(raw: bytes) -> tuple[str | None, bytes | None]:
        try:
            return raw.decode(encoding), None
        except UnicodeDecodeError:
            return None, raw

    @F.pandas_udf("line string, bytes binary")
    def decode(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(x) for x in lines], columns=["line", "bytes"])

    return decode


def sound_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that could be decoded, and the others as ``seq, bytes`` (to be reported and skipped)."""
    if "bytes" in lines.columns:
        return lines.where(F.col("bytes").isNull()).select("seq", "line"), lines.where(F.col("bytes").isNotNull()).select("seq", "bytes")
    valid = F.is_valid_utf8("line")
    return lines.where(valid), lines.where(~valid).select("seq", F.col("line").cast("binary").alias("bytes"))


def lines_of_documents(docs: DataFrame) -> DataFrame:
    """``seq, line`` of ``docs(seq, text)`` whose texts hold several records each; ``seq`` repeats."""
    return docs.select("seq", F.explode(split_document_lines(F.col("text"))).alias("line"))


def split_document_lines(x: Column) -> Column:
    """The lines of a text that holds several records."""
    return F.split(text.trim(x), r" *\n *", -1)


def parse_records(lines: DataFrame, schema: MatchSchema, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records ``seq, fields`` of index lines, and the lines that are not records with a reason.

    A line needs a field for each position (more are ignored), an id and a database; blank lines are skipped.  With
    ``strict`` all lines are looked at first, and the bad one with the smallest ``seq`` is an error; else bad lines are set apart.
    """
    wanted = len(schema.fields)
    line = text.trim(F.col("line"))
    rows = lines.select("seq", "line", line.alias("_t")).where("_t <> ''")
    fields = text.split_fields(text.trim(F.translate(text.unescape_html(F.col("_t")), ":", " ")))
    rows = rows.withColumn("fields", fields)
    reason = (
        F.when(text.count_char(F.col("_t"), "|") < wanted - 1, "too few fields")
        .when(F.get("fields", F.lit(schema.id.pos)) == "", "no id")
        .when(F.get("fields", F.lit(schema.database.pos)) == "", "no database")
    )
    rows = rows.withColumn("reason", reason)
    bad = rows.where("reason IS NOT NULL").select("seq", "line", "reason")
    if strict and (first := bad.agg(F.min_by(F.struct("reason", "line"), "seq").alias("first")).first()["first"]):
        raise ValueError(f"{first.reason}: {first.line}")
    return rows.where("reason IS NULL").select("seq", "fields"), bad


def parse_queries(lines: DataFrame, schema: MatchSchema, exact: bool = True) -> DataFrame:
    """Query records ``seq, fields``; ``exact`` demands the very number of fields.

    A line whose pipes don't give that number is read as pipe-separated values with double quotes.
    """
    wanted = len(schema.fields)
    colons = text.trim(F.translate("line", ":", " "))
    rows = lines.select("seq", "line", colons.alias("_t")).where("_t <> ''")
    plain = text.trim(text.unescape_html(F.col("_t")))
    rows = rows.withColumn("_p", plain)
    quoted = F.from_csv(F.col("_p"), F.lit(", ".join(f"f{i} string" for i in range(wanted))), {"sep": "|", "quote": '"', "escape": '"'})
    quoted = F.array(*[F.coalesce(quoted[f"f{i}"], F.lit("")) for i in range(wanted)])
    fields = F.when(text.count_char(F.col("_p"), "|") == wanted - 1, text.split_fields(F.col("_p"))).otherwise(quoted)
    if exact:
        size = F.size(text.split_fields(F.col("_t")))
        fields = F.when(size == wanted, fields).otherwise(F.raise_error(F.concat(F.lit("invalid number of fields: "), F.col("line"))).cast("array<string>"))
    return rows.select("seq", fields.alias("fields"))


def json_to_pipe(json: Column, schema: MatchSchema, database: Column, record_id: Column) -> Column:
    """A JSON object as a piped line; lists of strings are joined by the separator, missing fields and nulls are empty, other values fail."""
    parts, parsed = [], F.parse_json(json)
    for f in schema.fields:
        if f.kind == "databaseField":
            parts.append(database)
        elif f.kind == "idField":
            parts.append(record_id)
        else:
            path = f"$['{f.name}']"
            raw = F.get_json_object(json, path)
            kind = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit("VOID"))
            bad = F.raise_error(F.concat(F.lit("unsupported value: "), raw)).cast("string")
            listed = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.array_join(F.from_json(raw, "array<string>"), text.OCCURRENCE)).otherwise(bad)
            other = F.when(kind.startswith("OBJECT") | (kind == "BOOLEAN"), bad).when(kind.startswith("ARRAY"), listed).when(kind == "VOID", "").otherwise(raw)
            parts.append(F.when(kind == "STRING", F.try_variant_get(parsed, path, "string")).otherwise(other))
    return F.concat_ws("|", *parts)


def with_fields(records: DataFrame, schema: MatchSchema, prefix: str = "") -> DataFrame:
    """Each field as raw (trimmed) and search text, authors as lists; ``records(seq, fields)``."""
    out = [F.col("seq").alias(f"{prefix}seq")]
    for f in schema.fields:
        value = F.coalesce(F.get("fields", F.lit(f.pos)), F.lit(""))
        out.append(text.trim(value).alias(f"{prefix}{f.name}_raw"))
        out.append(text.search_text(value).alias(f"{prefix}{f.name}"))
        if f.kind == "authorsField":
            out.append(text.normalize_list(value).alias(f"{prefix}{f.name}_list"))
    return records.select(*out)
