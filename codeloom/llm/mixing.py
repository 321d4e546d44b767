"""Mixing sources to target weights, in DataFrame operations alone.

The sizes of each source are summed, a target is derived for each, and every
document is taken floor(rate) times, with rate = target / size of its source,
plus once more with the rate's fraction as probability. The draw is a hash of
seed and doc_id, so reruns and executors agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import shared

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target for each source.

    sizes: one row for each source with source (null for none) and source_size.
    Weights go to the sources by code point, null last. A target above `most`
    times its source's size stops there and the excess goes to the others by
    weight: with the sources in order of size / weight, those up to some place
    are full, and the rest share what is left. The windows here see one row a
    source, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = weighted.select(
        "source",
        "source_size",
        "weight",
        (
            (F.lit(share) * F.sum("source_size").over(whole) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
        ).alias("level"),
        F.row_number().over(fill).alias("place"),
    ).withColumn("open", F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size"))
    # The first source that is not full sets the level; with none, all are full.
    water = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(whole)
    return level.select(
        "source",
        "source_size",
        F.when(water["place"].isNull() | (F.col("place") < water["place"]), F.lit(most) * F.col("source_size"))
        .otherwise(F.least(water["level"] * F.col("weight"), F.lit(most) * F.col("source_size")))
        .cast("double")
        .alias("target"),
    )


def draw(doc_id: Column, seed: int) -> Column:
    """A number from [0, 1) by seed and doc_id: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row.

    share: of all sizes, what the mix is to hold; most: times that a source may
    be repeated. A null text has size 0; a null source is a source of its own; a
    null doc_id is drawn as an empty one; rows that repeat a doc_id share its
    draw. Where nothing has a size, all targets are 0. Other columns, whatever
    their names, are left out; an empty table gives an empty table.
    """
    small = shared.written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    plan = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "of")
    return _with_copies(small, plan, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _with_copies(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The join is left to the adaptive planner: it broadcasts the plan if that turns out small, else splits hot sources."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draws = (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return sized.join(plan, sized["source"].eqNullSafe(plan["of"])).withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("long") + draws)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The documents of the mix, with all columns of docs, each as often as it is taken."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    own = shared.unused_prefix(docs)
    plan = plan.select(*(F.col(c).alias(f"{own}{c}") for c in plan.columns))
    size, target = F.col(f"{own}source_size"), F.col(f"{own}target")
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    draws = (draw(docs["doc_id"], seed) < rate - F.floor(rate)).cast("int")
    joined = docs.join(plan, docs["source"].eqNullSafe(plan[f"{own}source"]))
    copies = F.explode(F.array_repeat(F.lit(1), F.floor(rate).cast("int") + draws)).alias(f"{own}copy")
    return joined.select(*shared.columns_of(docs), copies).drop(f"{own}copy")
