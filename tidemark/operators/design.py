"""Lagged design matrices of all origins: a wide row for each target month, by calendar lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.exceptions import ConfigurationError
from tidemark.functions.columns import excluded, month_number
from tidemark.operators.features import changes

LEVEL, CHANGE, TRAILING_MEAN = "level", "change", "trailing_mean"


@dataclass(frozen=True)
class Term:
    name: str
    series_id: str
    transform: str
    lag: int
    label: str = ""
    window: int = 12
    required: int | None = None

    @property
    def least(self) -> int:
        return -(-self.window // 2) if self.required is None else self.required


def default_terms(target: str) -> tuple[Term, ...]:
    """The default terms, in order, for the registry's series (fixed values: series, transform and lag)."""
    return (
        Term("target_trailing_mean_12", target, TRAILING_MEAN, 1, "its own mean change of twelve months"),
        Term("target_change_lag1", target, CHANGE, 1, "its own latest change"),
        Term("target_change_lag2", target, CHANGE, 2, "its own change one month earlier"),
        Term("target_change_lag3", target, CHANGE, 3, "its own change two months earlier"),
        Term("icsa_level", "ICSA", LEVEL, 0, "new claims"),
        Term("icsa_change", "ICSA", CHANGE, 0, "step in new claims"),
        Term("ccsa_change", "CCSA", CHANGE, 0, "step in standing claims"),
        Term("usprv_change", "USPRIV", CHANGE, 1, "step in official private jobs"),
        Term("unrate_change", "UNRATE", CHANGE, 1, "step in the jobless rate"),
        Term("jolts_change", "JTSJOL", CHANGE, 2, "step in open positions"),
    )


def check_terms(terms: Sequence[Term], target: str, lags: dict[str, int]) -> None:
    """No term may look at what is not published yet."""
    for t in terms:
        least = max(lags.get(t.series_id, 0), 1 if t.series_id == target else 0)
        if t.lag < 0 or t.lag < least:
            raise ConfigurationError(f"{t.name}: lag {t.lag} is below {least}")
        if t.series_id == target and t.transform == LEVEL:
            raise ConfigurationError(f"{t.name}: the target enters as change or trailing mean only")
        if t.series_id != target and t.transform == TRAILING_MEAN:
            raise ConfigurationError(f"{t.name}: only the target has a trailing mean")
        if t.transform == TRAILING_MEAN and (t.window < 2 or t.least > t.window):
            raise ConfigurationError(f"{t.name}: window {t.window}, required {t.least}")


def trailing_mean(target_changes: DataFrame, window: int, least: int, regime: tuple[str, str], keys: Sequence[str] = ("origin",)) -> DataFrame:
    """(keys, month, trailing): mean change of the `window` months that end with this month, without excluded ones.

    A range over month numbers, so missing months are missing; null under `least` months. Months in between for which
    the series has no row are not listed.
    """
    w = Window.partitionBy(*keys).orderBy(month_number("month")).rangeBetween(-(window - 1), 0)
    clean = F.when(~excluded("month", regime), F.col("change"))
    return target_changes.select(*keys, "month", F.when(F.count(clean).over(w) >= least, F.avg(clean).over(w)).alias("trailing"))


def rows(panel: DataFrame, terms: Sequence[Term], target: str, regime: tuple[str, str], min_samples: int = 24, lags: dict[str, int] | None = None, moved: DataFrame | None = None, target_month: Column | None = None) -> DataFrame:
    """(origin, month, is_next, y, a column a term, status, missing, n_ok, last_change, skip_reason).

    status: `ok`, `excluded` (the target month or a month that a level or change term reads is in the regime) or
    `incomplete` (a term is missing, then named in `missing`). The row to predict has is_next and is not tested
    against the regime. n_ok counts the origin's complete training rows, last_change is its newest change outside the
    regime. skip_reason says why the origin cannot be used: fewer than min_samples complete rows, or a term without a
    value for the row to predict. lags: publication lags by series, which no term may undercut. moved: the panel's
    changes, where they are there already. target_month: of the row to predict, from the origin; the month after the
    newest change where it is not given.
    """
    check_terms(terms, target, lags or {})
    keyed = ["origin", "series_id"]
    moved = changes(panel, keyed) if moved is None else moved
    of_target = moved.filter(F.col("series_id") == target).select("origin", "month", "change")
    own = F.struct("month", F.col("change").alias("y"), F.lit(False).alias("is_next"))
    added = F.struct((F.add_months("month", 1) if target_month is None else target_month).alias("month"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("is_next"))
    newest = of_target.withColumn("_newest", F.max("month").over(Window.partitionBy("origin")))
    wide = newest.select("origin", F.inline(F.when(F.col("month") == F.col("_newest"), F.array(own, added)).otherwise(F.array(own))))
    used = F.col("series_id").isin(*{t.series_id for t in terms})
    values = panel.filter(used).join(moved.select(*keyed, "month", "change"), [*keyed, "month"], "left").select(*keyed, "month", "value", "change")
    # Every value goes to the rows that read it, once for each term, and the terms of a row meet in one aggregation.
    plain = [t for t in terms if t.transform != TRAILING_MEAN]
    sends = F.explode(F.array(*(F.struct(F.lit(t.name).alias("term"), F.when(F.col("series_id") == t.series_id, F.col("value" if t.transform == LEVEL else "change")).alias("x"), F.lit(t.lag).alias("lag")) for t in plain)))
    sent = values.select("origin", "month", sends.alias("s")).filter("s.x is not null").select("origin", F.add_months("month", F.col("s.lag")).alias("month"), F.col("s.term").alias("term"), F.col("s.x").alias("x"))
    for t in terms:
        if t.transform == TRAILING_MEAN:
            # A month without a change of its own still has a trailing window: the mean is taken at the reading rows.
            back = of_target.select("origin", F.explode(F.sequence(F.lit(t.lag), F.lit(t.lag + t.window - 1))).alias("k"), "month", "change").filter(~excluded("month", regime))
            mean = back.groupBy("origin", F.add_months("month", F.col("k")).alias("month")).agg(F.count("change").alias("n"), F.avg("change").alias("x")).filter(F.col("n") >= t.least)
            sent = sent.unionByName(mean.select("origin", "month", F.lit(t.name).alias("term"), "x"))
    tabled = sent.groupBy("origin", "month").agg(*(F.max(F.when(F.col("term") == t.name, F.col("x"))).alias(t.name) for t in terms))
    joined = wide.join(tabled, ["origin", "month"], "left")
    reads = {0} | {-t.lag for t in plain} | {-t.lag - 1 for t in plain if t.transform == CHANGE}
    dirty = F.lit(False)
    for k in sorted(reads):
        dirty = dirty | excluded(F.add_months("month", k), regime)
    missing = F.filter(F.array(*(F.when(F.col(t.name).isNull(), F.lit(t.name)) for t in terms)), lambda x: x.isNotNull())
    status = F.when(~F.col("is_next") & dirty, "excluded").when(F.size(missing) > 0, "incomplete").otherwise("ok")
    out = joined.withColumn("status", status).withColumn("missing", missing)
    of_origin = Window.partitionBy("origin")
    ok = F.count_if((F.col("status") == "ok") & ~F.col("is_next")).over(of_origin)
    last = F.max(F.when(~F.col("is_next") & ~excluded("month", regime), F.struct("month", "y"))).over(of_origin)["y"]
    out = out.withColumn("n_ok", ok).withColumn("last_change", last).withColumn("_unknown", F.max(F.when(F.col("is_next"), F.array_join("missing", ", "))).over(of_origin))
    few = F.concat(F.lit(f"{min_samples} complete rows are needed, there are "), F.col("n_ok").cast("string"))
    reason = F.when(F.col("n_ok") < min_samples, few).when(F.col("_unknown") != "", F.concat(F.lit("no value for "), "_unknown"))
    return out.select("origin", "month", "is_next", "y", *(t.name for t in terms), "status", "missing", "n_ok", "last_change", reason.alias("skip_reason"))
