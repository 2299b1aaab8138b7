"""Naive forecasters for all origins at once, as windows over each origin's usable history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import excluded

#: Half-width of an 80 % interval in standard deviations (fixed value).
Z80 = 1.2816
#: Forecasters by name: the fewest changes that each needs.
MINIMUM = {"random_walk": 2, "mean_3m": 3, "mean_6m": 6, "drift": 3}


def forecasts(target_changes: DataFrame, regime: tuple[str, str], keys: tuple[str, ...] = ("origin",), target_month: Column | None = None) -> DataFrame:
    """(keys, target_month, model, point, lower, upper, n_train, baseline_point) from (keys, month, change).

    Months of the excluded regime are taken out and the rest counts as contiguous. A rule's forecast for row i uses the
    rows before i, so one window gives the forecast (for an added row at the end) and the errors that the rule
    would have made, whose mean square sets the interval.
    """
    k = list(keys)
    newest = F.max("month").over(Window.partitionBy(*k))
    own = F.struct("month", "change", F.lit(False).alias("_next"))
    added = F.struct((F.add_months("month", 1) if target_month is None else target_month).alias("month"), F.lit(None).cast("double").alias("change"), F.lit(True).alias("_next"))
    each = F.when(F.col("month") == F.col("_newest"), F.array(own, added)).otherwise(F.array(own))
    usable = target_changes.withColumn("_newest", newest).select(*k, F.inline(each)).filter(F.col("_next") | ~excluded("month", regime))
    w = Window.partitionBy(*k).orderBy("_next", "month")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(w) - 1
    last, first = F.lag("change").over(w), F.first("change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = usable.select(
        *k, "month", "change", "_next", n.alias("_n"), last.alias("random_walk"),
        F.avg("change").over(w.rowsBetween(-3, -1)).alias("mean_3m"), F.avg("change").over(w.rowsBetween(-6, -1)).alias("mean_6m"),
        (last + (last - first) / F.when(n > 1, n - 1)).alias("drift"), F.last("change").over(past).alias("_last"),
    )
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.when(F.col("_n") >= least, F.col(m)).alias("p")) for m, least in MINIMUM.items())))
    long = rows.select(*k, "month", "change", "_next", "_n", "_last", each.alias("m")).select("*", "m.model", "m.p").filter(F.col("p").isNotNull())
    e = F.col("change") - F.col("p")
    out = long.groupBy(*k, "model").agg(
        F.max(F.when(F.col("_next"), F.col("month"))).alias("target_month"),
        F.max(F.when(F.col("_next"), F.col("p"))).alias("point"),
        F.sqrt(F.avg(e * e)).alias("_spread"),
        F.count(e).alias("_errors"),
        F.max(F.when(F.col("_next"), F.col("_n"))).cast("int").alias("n_train"),
        F.max(F.when(F.col("_next"), F.col("_last"))).alias("baseline_point"),
    ).filter(F.col("point").isNotNull())
    half = F.when(F.col("_errors") >= 2, Z80 * F.col("_spread"))
    return out.select(*k, "target_month", "model", "point", (F.col("point") - half).alias("lower"), (F.col("point") + half).alias("upper"), "n_train", "baseline_point")
