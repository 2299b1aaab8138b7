"""Walk-forward backtests of all origins in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.exceptions import ConfigurationError
from tidemark.functions.columns import excluded, is_current, known_on, month_of
from tidemark.operators import baselines, features, ridge, scoring
from tidemark.operators.design import Term, rows
from tidemark.sources.registry import unit_label
from tidemark.tables import durable

MODELS = (*baselines.MINIMUM, "ridge")


def actuals_at_release(observed: DataFrame, wanted: DataFrame, dimension: DataFrame, target: str) -> DataFrame:
    """(origin, target_month, actual) for the wanted (origin, target_month): what was printed on the release date.

    Both levels come from that day's snapshot. Only the two months asked for are looked up, by month.
    """
    scale = dimension.filter(F.col("series_id") == target).first()["scale_to_thousands"]
    levels = observed.filter(F.col("series_id") == target).select(month_of("obs_date").alias("month"), "realtime_start", "realtime_end", (F.col("value") * scale).alias("value"))
    asked = wanted.select("origin", "target_month", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("month", F.expr("add_months(target_month, -k)"))
    found = levels.join(asked, "month").filter(known_on("origin"))
    both = found.groupBy("origin", "target_month").agg(F.max(F.when(F.col("k") == 0, F.col("value"))).alias("now"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("before"))
    return both.select("origin", "target_month", (F.col("now") - F.col("before")).alias("actual"))


def actuals_of_today(observed: DataFrame, wanted: DataFrame, dimension: DataFrame, target: str) -> DataFrame:
    """(origin, target_month, actual) for the wanted (origin, target_month, previous_month), from the last non-null vintage of each date.

    The earlier level is that of previous_month, the newest with a change: the two may be of different vintages and, after
    a gap, more than a month apart.
    """
    scale = dimension.filter(F.col("series_id") == target).first()["scale_to_thousands"]
    last = observed.filter((F.col("series_id") == target) & F.col("value").isNotNull()).groupBy(month_of("obs_date").alias("month")).agg((F.max_by("value", "realtime_start") * scale).alias("value"))
    asked = wanted.select("origin", "target_month", F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("target_month").alias("month")), F.struct(F.lit(-1).alias("sign"), F.col("previous_month").alias("month")))).alias("m"))
    both = asked.select("origin", "target_month", "m.*").join(last, "month").groupBy("origin", "target_month").agg(F.sum(F.col("sign") * F.col("value")).alias("actual"), F.count(F.lit(1)).alias("n"))
    return both.filter("n = 2").select("origin", "target_month", "actual")


def origins_of(observed: DataFrame, calendar: DataFrame, scorecard: str, target: str, upto: str | None = None) -> DataFrame:
    """Release dates, or for the lag-shifted scorecard the months that the target has; up to a cutoff."""
    found = calendar.select("origin") if scorecard == "vintage" else observed.filter(F.col("series_id") == target).select(month_of("obs_date").alias("origin"))
    found = found.distinct()
    return found if upto is None else found.filter(F.col("origin") <= F.lit(upto).cast("date"))


def check_models(models: Sequence[str]) -> None:
    unknown = [m for m in models if m not in MODELS]
    if unknown or not models:
        raise ConfigurationError(f"unknown model {', '.join(unknown)}; known: {', '.join(MODELS)}")


def lags_of(dimension: DataFrame) -> dict[str, int]:
    return {r["series_id"]: r["publication_lag_months"] for r in dimension.collect()}  # a row a series


def units_of(dimension: DataFrame) -> dict[str, str]:
    return {r["series_id"]: r["u"] for r in dimension.select("series_id", unit_label(F.col("units")).alias("u")).collect()}


def attempts(panel: DataFrame, target: str, terms: Sequence[Term], regime: tuple[str, str], models: Sequence[str], dimension: DataFrame, level: float = 0.8, shifted: bool = False) -> DataFrame:
    """Of each origin of a panel and each model a forecast, or a null point and why there is none. The panel is stored.

    What is forecast is the month after the newest change, or the origin itself where it is a month (shifted), however
    long ago the newest change was; previous_month is that of the newest change.
    """
    check_models(models)
    month = F.col("origin") if shifted else None
    moved = features.changes(panel, ["origin", "series_id"])
    if "ridge" in models:
        moved = durable(moved, "changes")
    of_target = moved.filter(F.col("series_id") == target).select("origin", "month", "change")
    columns = ["origin", "model", "point", "lower", "upper", "n_train", "skip_reason"]
    ends = of_target.groupBy("origin").agg(F.max("month").alias("previous_month"), F.count_if(~excluded("month", regime)).alias("_usable"))
    ends = ends.withColumn("target_month", F.add_months("previous_month", 1) if month is None else month)
    naive = [m for m in models if m in baselines.MINIMUM]
    needs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(baselines.MINIMUM[m]).alias("least")) for m in naive))) if naive else None
    out = None
    if naive:
        each = ends.select("origin", "_usable", needs.alias("m")).select("origin", "_usable", "m.model", "m.least")
        made = baselines.forecasts(of_target, regime, target_month=month).select("origin", "model", "point", "lower", "upper", "n_train")
        reason = F.when(F.col("point").isNull(), F.concat(F.col("least").cast("string"), F.lit(" changes are needed, there are "), F.col("_usable").cast("string")))
        out = each.join(made, ["origin", "model"], "left").withColumn("skip_reason", reason).select(columns)
    if "ridge" in models:
        fitted = ridge.forecasts(rows(panel, terms, target, regime, ridge.LEAST_ROWS, lags_of(dimension), moved, month), terms, units_of(dimension), level=level).select(columns)
        out = fitted if out is None else out.unionByName(fitted)
    return out.join(ends.drop("_usable"), "origin")


def outcomes(observed: DataFrame, calendar: DataFrame, dimension: DataFrame, target: str, terms: Sequence[Term], regime: tuple[str, str], scorecard: str = "vintage", models: Sequence[str] = MODELS, upto: str | None = None, level: float = 0.8) -> DataFrame:
    """(origin, target_month, model, point, lower, upper, n_train, actual, skip_reason) of every usable origin and model.

    An origin without a panel, with an excluded target month, without an actual or without any forecast is no origin.
    `observed` is read several times: hand in a stored table. Panel and forecasts are stored.
    """
    check_models(models)
    origins = origins_of(observed, calendar, scorecard, target, upto)
    shifted = scorecard != "vintage"
    panel = durable(features.lag_shifted_panel(observed, origins, dimension, target) if shifted else features.panel(observed, origins, dimension), "panel")
    made = durable(attempts(panel, target, terms, regime, models, dimension, level, shifted).filter(~excluded("target_month", regime)), "attempts")
    wanted = made.select("origin", "target_month", "previous_month").distinct()
    actual = actuals_of_today(observed, wanted, dimension, target) if shifted else actuals_at_release(observed, wanted, dimension, target)
    usable = made.filter(F.col("point").isNotNull()).select("origin").distinct()
    scored = made.join(actual.filter(F.col("actual").isNotNull()), ["origin", "target_month"]).join(usable, "origin", "left_semi")
    return scored.select("origin", "target_month", "model", "point", "lower", "upper", "n_train", "actual", "skip_reason")


def walk_forward(observed: DataFrame, calendar: DataFrame, dimension: DataFrame, target: str, terms: Sequence[Term], regime: tuple[str, str], scorecard: str = "vintage", models: Sequence[str] = MODELS, common: bool = True, upto: str | None = None, level: float = 0.8) -> DataFrame:
    """`outcomes` with a forecast, on origins that all models have forecast."""
    scored = outcomes(observed, calendar, dimension, target, terms, regime, scorecard, models, upto, level).filter(F.col("point").isNotNull()).drop("skip_reason")
    return scoring.common_origins(scored, len(models)) if common else scored


def skips(found: DataFrame) -> DataFrame:
    """(model, skip_reason, n_origins) of `outcomes`: which model could not forecast how many origins, and why."""
    return found.filter(F.col("point").isNull()).groupBy("model", "skip_reason").agg(F.count(F.lit(1)).alias("n_origins"))
