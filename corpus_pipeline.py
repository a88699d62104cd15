"""From raw documents to a training mix: each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm import decontaminate, mixing, near_dup, pseudonyms, toxicity
from kindred.llm.workspace import Workspace, read, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group; five-word shingles, similarity 0.8."""
    ship(spark)
    return near_dup.deduplicated(docs, shingle=5, percent=80).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in place of personal data."""
    out = pseudonyms.pseudonymised(docs, pseudonyms.session_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: a row for each time that the mix takes a document, with the text that it takes then, and the figures of the mix.

    What is taken doesn't depend on the key of the pseudonyms.
    """
    out = mixing.mixture(docs, by_text=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pseudonyms", replace_personal_data),
    ("mix", mix_sources),
]

#: The label model and the hashes of the stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
