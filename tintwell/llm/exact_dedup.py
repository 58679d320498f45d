"""Exact dedup with a heavy-hitter split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintwell.llm.common import BLANKS, written

#: Counters of a Misra-Gries summary, and so the most digests that are ever broadcast.
COUNTERS = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 of the text without blanks, and n_points, the code points of the text as it is. Null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("n_points"),
    )


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them each one with more than 2 / counters of all rows.

    A task keeps a summary of `counters` counters, each short of the truth by at most 1 / counters of its rows. Summed
    over the tasks, a digest above twice that share keeps more than one share, and no more than `counters` can.
    """

    def summary(batches):
        kept = pd.Series(dtype="int64")
        for batch in batches:
            counts = kept.add(batch["text_sha256"].value_counts(), fill_value=0).astype("int64").sort_values(ascending=False)
            if len(counts) > counters:
                counts = counts - counts.iloc[counters]
                counts = counts[counts > 0]
            kept = counts
        yield pd.DataFrame({"text_sha256": kept.index.astype(str), "seen": kept.to_numpy()})

    total = rows.count()
    found = rows.select("text_sha256").mapInPandas(summary, "text_sha256 string, seen long")
    return found.groupBy("text_sha256").agg(F.sum("seen").alias("seen")).where(F.col("seen") > total / counters).select("text_sha256")


def _winners(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("low"))).alias("best")
    return rows.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).select("text_sha256", (-F.col("best.low")).alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per input row.

    Texts are equal when they agree after the removal of blanks; the row with the most code points, then the smallest
    id, stays. Frequent digests are found by Misra-Gries, counted exactly with their winners, and resolved on the map
    side from a broadcast of at most `counters` rows; the others take an ordinary shuffle. Null text is empty text, a
    null id loses every tie, an empty table gives no rows, rows that repeat an id are decided together, and other
    columns are ignored.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    frequent = written(frequent_digests(rows, counters), "frequent")
    heavy = written(_winners(rows.join(F.broadcast(frequent), "text_sha256", "left_semi")), "winners")
    light = rows.join(F.broadcast(frequent), "text_sha256", "left_anti")
    out = rows.join(F.broadcast(heavy), "text_sha256").unionByName(light.join(_winners(light), "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
