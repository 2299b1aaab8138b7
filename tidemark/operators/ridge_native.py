"""Ridge forecasts of all origins by expressions alone: what `operators.ridge` computes in Python groups, for the JVM.

Sums of products of a training prefix are running sums over an origin's rows; rows at which a fold ends, and the last one,
keep theirs. Standardised, they are one small system of equations a prefix and penalty, solved by elimination, a step for
each input. A validated month finds the prefix of its fold by an equality, and its errors for all penalties meet in one
aggregation an origin, which gives the penalty and the interval.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.design import Term
from tidemark.operators.ridge import FIRST_FOLD, FOLDS, LEAST_ERRORS, PENALTIES, SMALLEST_SPREAD


def solved(matrix: Column, size: int) -> Column:
    """The last column after elimination of `size` rows of size + 1 numbers, by the pivots of the diagonal."""
    def step(m: Column, k: Column) -> Column:
        pivot_row = F.get(m, k)
        pivot = F.get(pivot_row, k)
        return F.transform(m, lambda row, i: F.when(i == k, F.transform(row, lambda v: v / pivot)).otherwise(F.zip_with(row, pivot_row, lambda v, p: v - F.get(row, k) * p / pivot)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step), lambda row: F.get(row, F.lit(size)))


def _prefixes(train: DataFrame, k: int, penalties: Sequence[float]) -> DataFrame:
    """(origin, at, n, mean, spread, intercept, weights by penalty) of the prefixes that end a fold or the training."""
    w = Window.partitionBy("origin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    v = [F.lit(1.0), *(F.col(f"x{j}") for j in range(k)), F.col("y")]
    sums = {(i, j): F.sum(v[i] * v[j]).over(w).alias(f"s{i}_{j}") for i, j in combinations_with_replacement(range(k + 2), 2)}
    ends = train.select("origin", "at", "n", "width", *sums.values()).filter((F.col("at") == F.col("n")) | ((F.col("n") > FIRST_FOLD + 1) & (F.col("at") >= FIRST_FOLD) & ((F.col("at") - FIRST_FOLD) % F.col("width") == 0)))
    s = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}")
    count = s(0, 0)
    mean = [s(0, j + 1) / count for j in range(k)]
    moment = lambda i, j: s(i + 1, j + 1) - count * mean[i] * mean[j]
    spread = [F.greatest(F.sqrt(F.greatest(moment(j, j), F.lit(0.0)) / count), F.lit(SMALLEST_SPREAD)) for j in range(k)]
    named = ends.select("*", F.array(*mean).alias("mean"), F.array(*spread).alias("spread"), (s(0, k + 1) / count).alias("intercept"))
    m, d = (lambda j: F.get("mean", F.lit(j))), (lambda j: F.get("spread", F.lit(j)))
    rows = [F.array(*((s(i + 1, j + 1) - count * m(i) * m(j)) / (d(i) * d(j)) for j in range(k)), (s(i + 1, k + 1) - m(i) * s(0, k + 1)) / d(i)) for i in range(k)]
    system = named.select("origin", "at", "n", "mean", "spread", "intercept", F.array(*rows).alias("system"))
    shifted = lambda a: F.transform("system", lambda row, i: F.transform(row, lambda v, j: v + F.when(i == j, a).otherwise(F.lit(0.0))))
    return system.withColumn("weights", F.transform(F.array(*map(F.lit, map(float, penalties))), lambda a: solved(shifted(a), k))).drop("system")


def _moved(x: Column, mean: Column, spread: Column, weights: Column) -> Column:
    """What each input adds to the intercept."""
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), spread.alias("d"), weights.alias("w")), lambda z: (z["x"] - z["m"]) / z["d"] * z["w"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def forecasts(design: DataFrame, terms: Sequence[Term], units: dict[str, str] | None = None, penalties: Sequence[float] = PENALTIES, level: float = 0.8) -> DataFrame:
    """The same rows as `ridge.forecasts`. `design` is read several times: hand in a stored table."""
    if any(a < 0 for a in penalties) or not len(penalties):
        raise ValueError("penalties are not negative, and there is one at least")
    names, k = [t.name for t in terms], len(terms)
    following = design.filter("is_next").select("origin", F.col("month").alias("target_month"), F.array(*names).alias("new"), F.col("n_ok").cast("int").alias("n_train"), F.col("last_change").alias("baseline_point"), "skip_reason")
    rows = design.filter("not is_next and status = 'ok' and skip_reason is null")
    every, in_order = Window.partitionBy("origin"), Window.partitionBy("origin").orderBy("month")
    middle = [F.avg(name).over(every) for name in names]
    n = F.count(F.lit(1)).over(every)
    # Sums of shifted inputs lose no digits to their level.
    train = rows.select("origin", "y", F.row_number().over(in_order).alias("at"), n.alias("n"), F.greatest(F.lit(1), F.floor((n - FIRST_FOLD) / FOLDS)).alias("width"), F.array(*middle).alias("middle"), *((F.col(name) - mid).alias(f"x{j}") for j, (name, mid) in enumerate(zip(names, middle, strict=True))))
    prefixes = _prefixes(train, k, penalties)
    fold = (FIRST_FOLD + F.floor((F.col("at") - FIRST_FOLD - 1) / F.col("width")) * F.col("width")).cast("int")
    left_out = train.filter((F.col("n") > FIRST_FOLD + 1) & (F.col("at") > FIRST_FOLD)).select("origin", fold.alias("at"), "y", F.array(*(f"x{j}" for j in range(k))).alias("x"))
    tried = left_out.join(prefixes.drop("n"), ["origin", "at"])
    errors = tried.select("origin", F.transform("weights", lambda w: F.col("y") - F.col("intercept") - _total(_moved(F.col("x"), F.col("mean"), F.col("spread"), w))).alias("e"))
    of = lambda a: F.get("e", F.lit(a))
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    judged = errors.groupBy("origin").agg(F.count(F.lit(1)).alias("k"), F.array(*(F.avg(of(a) * of(a)) for a in range(len(penalties)))).alias("mse"), F.array(*(F.percentile(of(a), tails) for a in range(len(penalties)))).alias("spans"))
    last = prefixes.filter("at = n").join(train.filter("at = n").select("origin", "middle"), "origin").join(judged, "origin", "left")
    only = F.lit(len(penalties) // 2)
    best = F.when(F.col("k").isNull(), only).otherwise((F.array_position("mse", F.array_min("mse")) - 1).cast("int")) if len(penalties) > 1 else only
    picked = last.withColumn("best", best).withColumn("w", F.get("weights", F.col("best")))
    made = following.join(picked.select("origin", "middle", "mean", "spread", "intercept", "k", "spans", "best", "w"), "origin", "left")
    parts = _moved(F.zip_with("new", "middle", lambda v, m: v - m), F.col("mean"), F.col("spread"), F.col("w"))
    made = made.withColumn("parts", parts).withColumn("point", F.col("intercept") + _total(F.col("parts")))
    span = lambda side: F.when(F.col("k") >= LEAST_ERRORS, F.col("point") + F.get(F.get("spans", F.col("best")), F.lit(side)))
    driver = lambda j, t: F.struct(F.lit(t.name).alias("name"), F.lit(t.label or t.name).alias("label"), F.lit((units or {}).get(t.series_id, "")).alias("unit"), F.get("new", F.lit(j)).alias("value"), F.get("w", F.lit(j)).alias("coefficient"), F.get("parts", F.lit(j)).alias("contribution"))
    penalty = F.get(F.array(*map(F.lit, map(float, penalties))), F.col("best"))
    return made.select(
        "origin", "target_month", F.lit("ridge").alias("model"), "point", span(0).alias("lower"), span(1).alias("upper"), F.lit(float(level)).alias("interval_level"), "n_train", "baseline_point", penalty.alias("penalty"), "intercept",
        F.when(F.col("point").isNotNull(), F.array(*(driver(j, t) for j, t in enumerate(terms)))).alias("drivers"), "skip_reason")
