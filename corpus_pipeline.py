"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; where a stage changes texts, ``n_chars`` is counted anew. ``run`` writes each stage's rows as Parquet and reads them
again. No stage has an SQL form: tests/llm checks the operators that the stages call, not the stages themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import credentials, near_duplicates, packing, substrings, toxicity
from palisade.llm.common import bounded_batches, stage, table
from palisade.llm.queries import vocabulary

ORACLE_SQL = None


def _like(docs: DataFrame, rows: DataFrame, changed: bool) -> DataFrame:
    """rows (row, text) with the columns of docs."""
    def column(name: str):
        if name == "text":
            return F.col("text")
        if name == "n_chars" and changed:
            return F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"row.`{name}`")

    return rows.select(*[column(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Documents that the classifier scores below the threshold."""
    bounded_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep_text=True)
    return _like(docs, scored.filter(F.col("score") < threshold), False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    bounded_batches(spark)
    return _like(docs, near_duplicates.one_of_each(docs, 0.8), False)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated 35-word windows; texts without any stay as they are."""
    bounded_batches(spark)
    found = substrings.remove_repeats(docs, 35)
    return _like(docs, found.select("row", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text")), True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    bounded_batches(spark)
    return _like(docs, credentials.mask_secrets(docs), True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 token ids."""
    bounded_batches(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 1024, 0, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
