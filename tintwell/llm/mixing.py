"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tintwell.llm.common import WORD, written

#: Repeating weights of the sources in code-point order.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and the most times a source may be used.
SHARE, EPOCHS = 1.5, 2
SEED = "mix"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words and draw, the seeded hash that orders the documents."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        draw_of(F.col(id_col), seed).alias("draw"),
    )


def draw_of(doc_id, seed: str = SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def water_fill(per_source: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """Adds target to (source, source_size): weighted shares clamped at `epochs` times the size, the excess given on by weight.

    In order of cap / weight, the sources that reach their cap come first, and the level of the rest follows from what
    is left. The windows run over one row per source.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    all_rows, by_ratio = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per_source.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("goal", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    # The first source that its level does not fill sets the level of all after it; theirs would be lower.
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(all_rows)
    target = F.when(F.col("ratio") <= F.coalesce(level, F.col("ratio")), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return ranked.select("source", "source_size", target.alias("target"))


def plan(rows: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """Per source: size, target, whole repetitions, and what its fractional repetition takes: draws up to `last` and `extra`.

    In seeded order, documents are taken while their running words fit the fraction; then the one later document
    closest to the rest is added if that brings the source nearer. Running words are summed over 4,096 blocks of the
    hash and inside a block, so no task orders a whole source.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = water_fill(per_source, share, epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = written(goals.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    by_draw = rows.groupBy("source", "draw").agg(F.sum("size").alias("size")).withColumn("block", F.substring("draw", 1, 3))
    blocks = by_draw.groupBy("source", "block").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).alias("b")
    # Only the block in which the fraction ends needs its own order.
    ends = blocks.join(goals.alias("g"), F.expr("b.source <=> g.source")).where("b.base <= g.part AND b.base + b.words > g.part")
    ends = ends.select(F.col("b.source").alias("source"), F.col("b.block").alias("block"), "base", "part")
    inside = by_draw.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source AND d.block = e.block"))
    run = Window.partitionBy("d.source").orderBy("draw")
    inside = inside.withColumn("upto", F.col("base") + F.sum("size").over(run)).where("upto <= part")
    inside = inside.groupBy(F.col("d.source").alias("source")).agg(F.max("draw").alias("draw"), F.max("upto").alias("taken"))
    ends = ends.alias("e").join(inside.alias("i"), F.expr("e.source <=> i.source"), "left")
    # Before the first draw of the block lies the end of the block before it: its prefix sorts above all shorter draws.
    ends = ends.select(F.col("e.source").alias("source"), F.coalesce("draw", "block").alias("last"), (F.col("part") - F.coalesce("taken", "base")).alias("rest"))
    ends = written(ends, "ends")
    gap = F.abs(F.col("size") - F.col("rest"))
    fill = by_draw.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source")).where((F.col("draw") > F.col("last")) & (gap < F.col("rest")))
    fill = fill.groupBy(F.col("d.source").alias("source")).agg(F.min(F.struct(gap.alias("gap"), F.col("draw"))).alias("near"))
    fill = fill.select("source", F.col("near.draw").alias("extra"))
    out = goals.join(ends, same(goals, ends), "left").drop(ends["source"]).select("source", "source_size", "target", "whole", "last")
    return out.join(fill, same(out, fill), "left").select(out["source"], "source_size", "target", "whole", "last", "extra")


def repeats(draw, plan_row=F.col):
    """Times a document is taken: the whole repetitions, and one more when the fraction takes it."""
    part = (draw <= plan_row("last")) | (draw == plan_row("extra"))
    return plan_row("whole") + F.when(F.coalesce(part, F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats of every row.

    A source whose cap its share exceeds is used `epochs` times in full and the excess is reshared. Null and empty texts
    have no words, very long ones count in full, a null source is a source of its own that comes last, a source without
    words gets nothing. Documents equally close to the rest go by their draw; rows that share an id are drawn together. An
    empty table gives no rows, and other columns, whatever their names, are ignored. Reruns agree.
    """
    rows = written(sizes(docs, id_col, text_col, source_col, seed), "sizes")
    goals = written(plan(rows, **how), "plan")
    out = rows.alias("r").join(goals.alias("p"), F.expr("r.source <=> p.source"))
    n = repeats(F.col("draw"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("repeats"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of the input; rows as for `mix`."""
    rows = written(sizes(docs, id_col, text_col, source_col, seed), "sizes")
    goals = written(plan(rows, **how), "plan").alias("plan")
    # The caller's row travels as one column, so none of its names can clash.
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("of"), draw_of(F.col(id_col), seed).alias("at"))
    out = row.join(goals, F.expr("of <=> plan.source"))
    n = repeats(F.col("at"), lambda c: F.col(f"plan.{c}"))
    out = out.withColumn("times", n.cast("int")).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
