"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight (-ln(u) / weight, u from a hash of its id),
documents are sorted by key within their source, and prefix sums of their sizes meet the source's token budget.
Complete epochs precede the fractional selection: a budget of 2.4 times a source takes each document twice and
then documents in key order for the remaining 0.4. Documents are taken whole; what a pass leaves free, because the next
document in order is too long, goes in the same order to documents that still fit, until none does. Each further pass
reads only what still fits, and none of the documents that stopped an earlier one is among it.

Documents of a source are dealt to cells by the share of its keys that are smaller, computed from the counts of its
weights, so that cells follow the key and are even whatever the weights are.

Built of DataFrame functions only. Defined results: a null or empty text has size 0; sources are dealt weights in
code-point order, null last as a source of its own; repeated rows share one key and are taken each on its own;
an empty table gives an empty mix; columns besides id, text and source are ignored. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cells_for, durable, prefix, scratch


#: Steps of the weights that the cells are computed from.
LEVELS = 20


def quality_weight(text: Column) -> Column:
    """A native quality weight between 0.1 and 1: falls with the share of symbol characters."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 10.0 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float], most_epochs: float) -> DataFrame:
    """Targets by source, from one row (source, source_size) each.

    Weights repeat over the sources in code-point order, null last. Targets share the total by weight; one that
    would be above most_epochs times its source stops there and its excess is shared again by weight among the
    others, until none is above. In closed form: sources reach their cap in the order of cap / weight, so the
    water level is the first at which no further source is above its cap. One row a source is all that meets.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(in_order) - 1) % len(weights)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), nth.cast("int") + 1)
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most_epochs))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = left / open_w  # the level if all sources before this one are at their caps, and no other
    rows = rows.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") > F.col("_cap"))
    final = F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_level").alias("level")))).over(everything)["level"]
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), final * F.col("_w")))
    return rows.select("source", "source_size", F.coalesce(target, F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float], most_epochs: float = 3, seed: int = 17, weight: Column | None = None, draw: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row: id, size, source, source_size, target, epochs (whole times taken) and taken (words).

    `weight`: quality weight of a document, a Column over `docs`. `draw`: what a document's draw is hashed from, its id and
    text where none is given.
    """
    with scratch(docs.sparkSession) as scope:
        return scope.keep(_mixed(docs, weights, most_epochs, seed, weight, draw, id_col, text_col, source_col), "mix")


def _mixed(docs: DataFrame, weights: Sequence[float], most_epochs: float, seed: int, weight: Column | None, draw: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(*([F.col(id_col), text] if draw is None else [draw]), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text).alias("_tie"),
        (quality_weight(text) if weight is None else weight).alias("_weight"), (-F.log(u)).alias("_key"),
    ).withColumn("_key", F.col("_key") / F.col("_weight"))
    rows = rows.withColumn("_level", F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.round(F.col("_weight") * LEVELS)))).drop("_weight")
    rows = durable(rows, "mix-keys")
    total = rows.groupBy("source", "_level").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    total = total.groupBy("source").agg(F.sum("source_size").alias("source_size"), F.sum("_n").alias("_n"), F.collect_list(F.struct((F.col("_level") / LEVELS).alias("w"), "_n")).alias("_levels"))
    total = durable(total, "mix-sources")  # one row a source
    goal = durable(targets(total.select("source", "source_size"), weights, most_epochs), "mix-targets")
    n_rows = rows.count()
    known = goal.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    known = known.withColumn("_free", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    known = known.join(total.select(F.col("source").alias("_of"), "_n", "_levels"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    joined = rows.join(known, rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    cells = cells_for(n_rows)
    smaller = F.aggregate("_levels", F.lit(0.0), lambda acc, x: acc + x["_n"] * (1.0 - F.exp(-F.col("_key") * x["w"])))
    joined = joined.withColumn("_cell", F.floor(smaller / F.col("_n") * cells)).drop("_levels", "_n", "_level")
    state = joined.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_row", F.monotonically_increasing_id())
    state = durable(state, "mix-0")
    order = [F.col("_key"), F.col("size"), F.col("_tie"), F.col("id"), F.col("_row")]
    narrow = ["_source", "_cell", "_key", "size", "_tie", "id", "_row", "_free"]
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("_free"))
    open_ones, taken = state.select(narrow), []
    while True:
        summed = prefix(open_ones, ["_source"], F.col("_cell"), order, "_before", F.when(fits, F.col("size")).otherwise(F.lit(0).cast("long")))
        tried = durable(summed.withColumn("_take", fits & (F.col("_before") + F.col("size") <= F.col("_free"))), "mix-pass")
        taken.append(tried.filter("_take").select("_row"))
        used = durable(tried.groupBy("_source").agg(F.coalesce(F.sum(F.when(F.col("_take"), F.col("size"))), F.lit(0).cast("long")).alias("_used")), "mix-used")  # one row a source
        left = tried.filter("not _take").join(used, "_source").withColumn("_free", F.col("_free") - F.col("_used"))
        # Written before the next pass, so that its windows are dealt by (source, cell) and not as this join was.
        open_ones = durable(left.filter(fits).select(narrow), "mix-left")
        if not open_ones.limit(1).count():
            break
    extra = reduce(DataFrame.union, taken).withColumn("extra", F.lit(1))
    copies = F.col("epochs") + F.coalesce("extra", F.lit(0))
    return state.join(extra, "_row", "left").select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
