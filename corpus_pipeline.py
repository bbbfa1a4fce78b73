"""The training-data pipeline: five operators applied in turn, each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatewise.llm import decontaminate, lines, mixing, ngram_join, toxicity
from gatewise.llm.common import remainder, table
from gatewise.session import staged

REJECT = 0.3  # documents with this toxicity score or more go
LINE_SITES = 2  # a line on so many sites stays in its first document only


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``REJECT``. The model learns from labelled documents that are not held out."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), learn=remainder(F.col("doc_id"), 4) != 2)
    return scored.where(F.col(toxicity.SCORE_COLUMN) < REJECT).select(*[f"`{c}`" for c in docs.columns])


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on ``LINE_SITES`` sites or more, but in the first document that has them."""
    counts = "_n_lines", "_n_removed"
    while set(counts) & set(docs.columns):
        counts = counts[0] + "_", counts[1] + "_"
    cleaned = lines.dedup_lines(docs, LINE_SITES, counts)
    columns = [F.when(F.col(counts[1]) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cleaned.select(*columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of its smallest id. Rows without an id, and rows that share one, are documents of their own."""
    return ngram_join.keep_first_of_groups(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with a few edits."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents that it takes with all their columns, how often (``copies``), and the words that gives (``taken``).
    Columns of the input named ``size``, ``copies`` or ``taken`` give way to those of the mix."""
    own = ["size", "copies", "taken"]
    columns = [c for c in docs.columns if c not in own]
    taken = mixing.mix_sources(docs, carry=columns).where("copies > 0")
    return taken.select(*(F.col("_carried").getField(c).alias(c) for c in columns), *own)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate_lines), ("ngram_jaccard", keep_one_of_near_duplicates), ("decontamination", drop_benchmark_leaks), ("mixing", mix)]
ORACLE_SQL = None  # the first stage is a trained model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
