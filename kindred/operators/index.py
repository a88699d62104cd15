"""The index: documents, postings with BM25 weights and their members, in memory or as segments under one path (:mod:`kindred.operators.segments`)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.functions import text
from kindred.plans.schema import MatchSchema
from kindred.sources.records import with_fields
from kindred.sources.scratch import kept

#: BM25 parameters; weights are kept as whole numbers of this unit so that sums don't depend on order.
K1, B, UNIT = 1.2, 0.75, 1e9
#: Documents of one text that a search looks at, and postings of a gram that lie together.
CANDIDATES, BLOCK = 1000, 100_000


@dataclass
class Index:
    """``docs``: one row a document; ``postings``: ``gram, block, tid, weight`` for each distinct indexed text, whose first document is ``tid``;
    ``members``: ``tid, did, dtext`` of the first ``CANDIDATES`` documents of each text."""

    schema: MatchSchema
    docs: DataFrame
    postings: DataFrame
    members: DataFrame


def shape_documents(records: DataFrame, schema: MatchSchema) -> DataFrame:
    """Stored form of ``records(seq, fields)``."""
    docs = with_fields(records, schema)
    key = text.normalize(F.concat_ws("_", f"{schema.database.name}_raw", f"{schema.id.name}_raw"))
    grams = F.greatest(F.length(schema.indexed.name) - (schema.gram - 1), F.lit(0))
    return docs.withColumns({"db_id": key, "dl": grams})


#: What an upsert compares: the stored column, and that of the row that replaces it.
KEYS = {"raw": ("id", "id_raw"), "normalized": ("id", "id"), "db_id": ("db_id", "db_id")}


def upserted(docs: DataFrame, key: str = "raw") -> DataFrame:
    """Later rows replace earlier ones.

    ``raw``: a row goes if a later row's id as given equals its normalised id (so ids that normalisation changes pile
    up); ``normalized`` and ``db_id`` compare the named column with itself.
    """
    own, incoming = KEYS[key]
    last = docs.groupBy(F.col(incoming).alias("_k")).agg(F.max("seq").alias("_last"))
    gone = kept(docs.select(F.col("seq").alias("_seq"), F.col(own).alias("_own")).join(last, (F.col("_own") == F.col("_k")) & (F.col("_last") > F.col("_seq")), "left_semi"))
    if gone.isEmpty():  # then no text needs to be moved
        return docs
    return docs.join(gone, (F.col("seq") == F.col("_seq")) & (F.col(own) == F.col("_own")), "left_anti")


def deleted(docs: DataFrame, record_id: str, legacy_prefix: bool = False) -> DataFrame:
    """Without the documents of an id; ``abc*`` deletes all that begin with ``abc``, ``*`` all.

    ``legacy_prefix``: the prefix is one character too short, as normalisation has removed the star already.
    """
    wanted = text.search_text(F.lit(record_id))
    if record_id.strip().endswith("*"):
        if legacy_prefix:
            wanted = F.substring(wanted, F.lit(1), F.length(wanted) - 1)
        return docs.where(~F.col("id").startswith(wanted))
    return docs.where(F.col("id") != wanted)


def exported(docs: DataFrame, schema: MatchSchema) -> DataFrame:
    """``seq, line``: raw values in order of position, pipe-separated."""
    return docs.select("seq", F.concat_ws("|", *[F.coalesce(f"{f.name}_raw", F.lit("")) for f in schema.fields]).alias("line"))


def texts_of(docs: DataFrame, indexed: str) -> DataFrame:
    """Distinct indexed texts: ``tid`` (the first document's seq), text, number of documents."""
    return docs.groupBy(F.col(indexed).alias("text")).agg(F.min("seq").alias("tid"), F.count(F.lit(1)).alias("n_docs"))


def gram_counts(texts: DataFrame, size: int = text.GRAM) -> DataFrame:
    """Documents and texts that hold each gram: ``gram, df, n_texts``."""
    grams = texts.select("n_docs", F.explode(F.array_distinct(text.index_grams(F.col("text"), size))).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("n_docs").alias("df"), F.count(F.lit(1)).alias("n_texts"))


def collection_stats(docs: DataFrame, indexed: str, size: int = text.GRAM) -> DataFrame:
    """Documents that hold each gram: ``gram, df``."""
    return gram_counts(texts_of(docs, indexed), size).select("gram", "df")


def text_grams(texts: DataFrame, size: int = text.GRAM) -> DataFrame:
    """``gram, tid, tf, dl`` of each text."""
    grams = texts.select("tid", F.greatest(F.length("text") - (size - 1), F.lit(0)).alias("dl"), F.explode(text.index_grams(F.col("text"), size)).alias("gram"))
    return grams.groupBy("gram", "tid", "dl").agg(F.count(F.lit(1)).alias("tf"))


def in_blocks(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """``postings`` with ``block``: those of a frequent gram are dealt to blocks by a hash."""
    blocks = F.ceil(F.col("n_texts") / BLOCK)
    return postings.join(counts.select("gram", "n_texts"), "gram").withColumn("block", F.pmod(F.xxhash64("tid"), blocks).cast("int")).drop("n_texts")


def quantised(dl: Column) -> Column:
    """A length as one byte keeps it: exact below 40, from there on 24 and the first four binary digits of the rest."""
    rest = (dl - 24).cast("int")
    shift = F.length(F.bin(rest)).cast("int") - 4
    rough = F.call_function("shiftleft", F.call_function("shiftright", rest, shift), shift)
    return F.when(dl < 40, dl.cast("int")).otherwise(24 + rough)


def bm25(tf: Column, df: Column, dl: Column, total: Column, average: Column) -> Column:
    """Weight of a gram in a text, in whole ``UNIT`` parts."""
    idf = F.log(1 + (total - df + 0.5) / (df + 0.5))
    return F.round(idf * tf / (tf + K1 * (1 - B + B * dl / average)) * UNIT).cast("long")


def weighted(postings: DataFrame, counts: DataFrame, total: Column, average: Column, rough: bool = False) -> DataFrame:
    """``gram, block, tid, weight`` from ``gram, block, tid, tf, dl`` and documents that hold each gram."""
    dl = quantised(F.col("dl")) if rough else F.col("dl")
    return postings.join(counts.select("gram", "df"), "gram").select("gram", "block", "tid", bm25(F.col("tf"), F.col("df"), dl, total, average).alias("weight"))


def build_postings(docs: DataFrame, schema: MatchSchema) -> DataFrame:
    """Postings at the level of distinct texts; frequencies and lengths are counted over documents."""
    texts = texts_of(docs, schema.indexed.name)
    sums = F.broadcast(docs.agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avg")))
    counts = gram_counts(texts, schema.gram)
    found = in_blocks(text_grams(texts, schema.gram), counts).crossJoin(sums)
    dl = quantised(F.col("dl")) if schema.rough_lengths else F.col("dl")
    return found.join(counts.select("gram", "df"), "gram").select("gram", "block", "tid", bm25(F.col("tf"), F.col("df"), dl, F.col("_n"), F.col("_avg")).alias("weight"))


def first_members(members: DataFrame) -> DataFrame:
    """``tid, did, dtext``: the first ``CANDIDATES`` documents of each group of ``members(key, did, dtext)``, ``tid`` being the first of all.

    A search takes no more of one text, and what exceeds them is cut before the shuffle, so a text that most documents share is no burden.
    """
    order = Window.partitionBy("key").orderBy("did")
    first = members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= CANDIDATES)
    return first.withColumn("tid", F.first("did").over(order)).select("tid", "did", "dtext")


def members_of(docs: DataFrame, indexed: str) -> DataFrame:
    return first_members(docs.select(F.col(indexed).alias("key"), F.col("seq").alias("did"), F.col(indexed).alias("dtext")))


def index_of(docs: DataFrame, schema: MatchSchema) -> Index:
    """An index of documents as they are stored."""
    return Index(schema, docs, build_postings(docs, schema), members_of(docs, schema.indexed.name))


def build_index(records: DataFrame, schema: MatchSchema, upsert_key: str = "raw") -> Index:
    """An index over ``records(seq, fields)``, not written."""
    return index_of(upserted(shape_documents(records, schema), upsert_key), schema)


def terms(docs: DataFrame, indexed: str, size: int = text.GRAM) -> DataFrame:
    """The term dictionary."""
    return docs.select(F.explode(text.index_grams(F.col(indexed), size)).alias("term")).distinct()


def required_violations(docs: DataFrame, schema: MatchSchema) -> DataFrame:
    """Documents in which a field that another one requires is empty."""
    wrong = F.lit(False)
    for f in schema.fields:
        if f.required:
            wrong |= F.coalesce(F.col(f"{f.required}_raw"), F.lit("")) == ""
    return docs.where(wrong)
