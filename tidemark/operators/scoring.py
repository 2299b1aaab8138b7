"""Scores of walk-forward forecasts, and the paired Diebold-Mariano test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.exceptions import InsufficientDataError
from tidemark.functions.columns import two_sided_p


def common_origins(scored: DataFrame, n_models: int) -> DataFrame:
    """Only origins that every model has forecast."""
    full = scored.groupBy("origin").agg(F.countDistinct("model").alias("k")).filter(F.col("k") == n_models).select("origin")
    return scored.join(full, "origin", "left_semi")


def checked(scored: DataFrame, models: Sequence[str] = ()) -> DataFrame:
    """`scored` itself, or an error: nothing to score for a model, a forecast without actual, two of one origin, or
    models on different origins, which no paired test may compare. One aggregation, a row a model.
    """
    key = F.xxhash64("origin")
    seen = scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("origin").alias("origins"), F.count_if(F.col("point").isNull() | F.col("actual").isNull()).alias("open"),
        F.bit_xor(key).alias("x"), F.sum(F.pmod(key, F.lit(1 << 31))).alias("s")).collect()
    by = {r["model"]: r for r in seen}
    for model in models or by:
        if model not in by:
            raise InsufficientDataError(f"no forecasts to score for {model}")
    if not by:
        raise InsufficientDataError("no forecasts to score")
    for model, r in by.items():
        if r["open"]:
            raise ValueError(f"{model}: {r['open']} of {r['n']} forecasts have no point or no actual")
        if r["n"] != r["origins"]:
            raise ValueError(f"{model}: {r['n']} forecasts of {r['origins']} origins")
    if len({(r["n"], r["x"], r["s"]) for r in seen}) > 1:
        raise ValueError("a comparison needs the same origins: " + ", ".join(f"{m} has {r['n']}" for m, r in sorted(by.items())))
    return scored


def scorecard(scored: DataFrame, by: tuple[str, ...] = ("model",), nominal: float = 0.8) -> DataFrame:
    """From (by, point, lower, upper, actual): n, mae, rmse, bias, directional_accuracy, interval_*, coverage_gap."""
    e, a = F.col("point") - F.col("actual"), F.col("actual")
    both = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    hit = F.when(a != 0, ((F.col("point") >= 0) == (a >= 0)).cast("int"))
    covered = F.when(both, (a.between(F.col("lower"), F.col("upper"))).cast("int"))
    out = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg(hit).alias("directional_accuracy"), F.avg(covered).alias("interval_coverage"),
        F.avg(F.when(both, F.col("upper") - F.col("lower"))).alias("mean_interval_width"), F.count_if(both).alias("n_with_interval"),
    )
    return out.withColumn("coverage_gap", F.col("interval_coverage") - nominal)


def relative_mae(cards: DataFrame, reference: str, order: Sequence[str] = ()) -> DataFrame:
    """By how many percent of the reference's MAE a model is better, and which model is best: of equal ones the first in `order`."""
    place = F.coalesce(F.array_position(F.lit(list(order)), F.col("model")), F.lit(0)) if order else F.lit(0)
    together = cards.agg(F.collect_list(F.struct("mae", place.alias("place"), "model")).alias("c"))  # a row a model
    ref = F.filter("c", lambda m: m["model"] == reference)[0]["mae"]
    each = together.select(ref.alias("ref"), F.array_min("c")["model"].alias("best"), F.explode("c").alias("m"))
    return each.select("m.model", "m.mae", (100 * (F.col("ref") - F.col("m.mae")) / F.col("ref")).alias("relative_mae"), (F.col("m.model") == F.col("best")).alias("is_best"))


def paired(scored: DataFrame, model: str) -> DataFrame:
    """(origin, rival, e_model, e_rival) on the origins that both have: the errors of an origin meet in one group."""
    each = F.struct("model", (F.col("point") - F.col("actual")).alias("e"))
    met = scored.groupBy("origin").agg(F.max(F.when(F.col("model") == model, F.col("point") - F.col("actual"))).alias("e_model"), F.collect_list(F.when(F.col("model") != model, each)).alias("rivals"))  # a row a model
    return met.filter(F.col("e_model").isNotNull()).select("origin", "e_model", F.inline("rivals")).select("origin", F.col("model").alias("rival"), "e_model", F.col("e").alias("e_rival"))


def diebold_mariano(pairs: DataFrame, least: int = 8, horizon: int = 1) -> DataFrame:
    """By rival and loss: losses, mean difference, small-sample corrected statistic, p and verdict, one step ahead.

    Rivals with fewer than `least` pairs or without variance have a null statistic, p and verdict. Losses further ahead are
    correlated, which this variance does not see, so another horizon is an error.
    """
    if horizon != 1:
        raise ValueError(f"one step ahead only, not {horizon}")
    losses = F.explode(F.array(
        F.struct(F.lit("absolute").alias("loss"), F.abs("e_model").alias("m"), F.abs("e_rival").alias("b")),
        F.struct(F.lit("squared").alias("loss"), (F.col("e_model") * F.col("e_model")).alias("m"), (F.col("e_rival") * F.col("e_rival")).alias("b")),
    ))
    d = F.col("l.m") - F.col("l.b")
    agg = pairs.select("rival", losses.alias("l")).groupBy("rival", "l.loss").agg(
        F.count(F.lit(1)).alias("n"), F.avg("l.m").alias("model_loss"), F.avg("l.b").alias("rival_loss"), F.avg(d).alias("mean_difference"), F.var_pop(d).alias("_v"))
    n = F.col("n").cast("double")
    usable = (F.col("n") >= least) & (F.col("_v") > 0)
    statistic = F.when(usable, F.col("mean_difference") / F.sqrt(F.col("_v") / n) * F.sqrt((n - 1) / n))
    out = agg.withColumn("statistic", statistic).withColumn("degrees_of_freedom", (F.col("n") - 1).cast("int"))
    p = F.when(F.col("statistic").isNotNull(), two_sided_p("statistic", "degrees_of_freedom"))
    out = out.withColumn("p_value", p)
    verdict = F.when(F.col("p_value").isNull(), F.lit(None).cast("string")).when(F.col("p_value") >= 0.05, "indistinguishable").when(F.col("mean_difference") < 0, "model is better").otherwise("rival is better")
    return out.withColumn("verdict", verdict).drop("_v")
