"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwell.llm import exact_dedup, language, minhash, mixing, packing
from tintwell.llm.common import table, written
from tintwell.llm.queries import tokenizer_path
from tintwell.plans.registry import query


# Every stage takes and returns the columns of documents, under whatever names, but for the last one. All take empty tables
# to empty tables, very long texts whole, and null ids and repeated rows as rows like any other where not said otherwise.


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Null and empty texts, texts without a letter, and those between two languages go."""
    return language.identified_documents(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id. Null texts equal empty ones.

    Rows that share an id are decided together; rows without an id stay.
    """
    return _kept(docs, exact_dedup.exact_groups(docs))


#: Least similarity of near copies in percent; the 85 of minhash is op8's alone.
NEAR_PERCENT = 80


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id. Texts without words and rows without an id stay."""
    return _kept(docs, minhash.near_classes(docs, percent=NEAR_PERCENT))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them. A null source is one of its own; texts without words go
    with their source's share."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences. Null and empty texts are their end id alone."""
    return packing.pack(docs, tokenizer_path())


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents not decided against. The ids of those that go are the short list, and null ids stay."""
    gone = written(decided.where("NOT kept AND doc_id IS NOT NULL").select("doc_id"), "gone")
    # The row travels as one column, so none of its names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id")
    return rows.join(gone, "doc_id", "left_anti").select("row.*")


STAGES = [("language", identify), ("exact dedup", dedup_exact), ("near dedup", dedup_near), ("mix", mix), ("pack", pack)]

#: The language model's and the tokenizer's decisions have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder; each result is written and read again. An empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
