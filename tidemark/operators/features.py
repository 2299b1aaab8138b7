"""Features: weekly series to months, changes within a snapshot, panels of all origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import is_current, month_of, overlaps
from tidemark.operators.store import at_origins

#: Aggregations of the weeks of a month, by name.
RULES = {"mean": F.avg}


def monthly(observed: DataFrame, keys: list[str], min_weeks: int = 2, rule: str = "mean") -> DataFrame:
    """(keys, month, value, weeks_used) from weekly observations, by the month of the week's end.

    Null weeks count neither in sum nor in count; a month with fewer than min_weeks stays, with a null value.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}; known: {', '.join(RULES)}")
    used = F.count("value")
    return observed.groupBy(*keys, month_of("obs_date").alias("month")).agg(F.when(used >= min_weeks, RULES[rule]("value")).alias("value"), used.cast("int").alias("weeks_used"))


def passed_through(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly observations in the same shape."""
    return observed.select(*keys, month_of("obs_date").alias("month"), "value", F.col("value").isNotNull().cast("int").alias("weeks_used"))


def changes(levels: DataFrame, keys: list[str], as_of: str | None = None) -> DataFrame:
    """(keys, month, change, level, previous_level): months whose previous month is there and both have values.

    A gap is skipped and never bridged. `keys` name one snapshot of one series, so no change crosses vintages. Levels that
    carry their windows (realtime_start, realtime_end) are held against that: two levels whose windows don't
    overlap, or one that was not known on the column `as_of` where it is given, are an error.
    """
    w = Window.partitionBy(*keys).orderBy("month")
    before = lambda c: F.lag(c).over(w)
    columns = [*keys, "month", F.col("value").alias("level"), before("value").alias("previous_level"), before("month").alias("_previous")]
    change = F.col("level") - F.col("previous_level")
    if "realtime_start" in levels.columns:
        ends = ["realtime_start", "realtime_end"]
        columns += [*ends, *(before(c).alias(f"_{c}") for c in ends), *([] if as_of is None or as_of in keys else [as_of])]
        own, previous = tuple(map(F.col, ends)), tuple(F.col(f"_{c}") for c in ends)
        both_known = F.greatest(own[0], previous[0])
        change = safe_change(F.col("level"), F.col("previous_level"), own, previous, both_known if as_of is None else F.col(as_of))
    adjacent = (F.col("_previous") == F.add_months("month", -1)) & F.col("level").isNotNull() & F.col("previous_level").isNotNull()
    return levels.select(*columns).filter(adjacent).select(*keys, "month", change.alias("change"), "level", "previous_level")


def safe_change(level: Column, previous: Column, window: tuple[Column, Column], previous_window: tuple[Column, Column], as_of: Column) -> Column:
    """level - previous, or an error unless both windows overlap and both were known on as_of."""
    both = overlaps(*window, *previous_window)
    known = (window[0] <= as_of) & (window[1] >= as_of) & (previous_window[0] <= as_of) & (previous_window[1] >= as_of)
    return F.when(~both, F.raise_error(F.lit("values of different vintages")).cast("double")).when(~known, F.raise_error(F.lit("a value is not of this snapshot")).cast("double")).otherwise(level - previous)


def duplicate_dates(snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Reference dates with several values in one snapshot: a violation of the store's windows."""
    return snapshot.groupBy(*keys, "obs_date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _by_month(known: DataFrame, dimension: DataFrame, min_weeks: int) -> DataFrame:
    """(origin, series_id, month, value, weeks_used) from each origin's snapshot: weekly series by `monthly`'s rule, others as they are.

    Series that the registry does not have are not asked for. Two values of one reference date in a snapshot are an error.
    """
    rows = known.join(dimension.select("series_id", "frequency", "scale_to_thousands"), "series_id").withColumn("value", F.col("value") * F.col("scale_to_thousands"))
    used, weekly = F.count("value"), F.col("frequency") == "W"
    out = rows.groupBy("origin", "series_id", "frequency", month_of("obs_date").alias("month")).agg(
        RULES["mean"]("value").alias("mean"), used.cast("int").alias("weeks_used"), F.count(F.lit(1)).alias("n"), F.size(F.collect_set("obs_date")).alias("dates"))
    twice = F.raise_error(F.concat(F.lit("several values of one date in the snapshot of "), "series_id", F.lit(" on "), F.col("origin").cast("string"))).cast("double")
    value = F.when(F.col("n") > F.col("dates"), twice).when(~weekly | (F.col("weeks_used") >= min_weeks), F.col("mean"))
    return out.select("origin", "series_id", "month", value.alias("value"), "weeks_used")


def panel(observed: DataFrame, origins: DataFrame, dimension: DataFrame, one_day: int = 1, min_weeks: int = 2) -> DataFrame:
    """(origin, series_id, month, value, weeks_used) as known `one_day` before each origin, all origins in one plan.

    origins: (origin). dimension: the registry, whose frequency says whether a series is averaged over weeks.
    """
    asked = origins.select("origin", F.date_sub("origin", one_day).alias("as_of")).distinct()
    return _by_month(at_origins(observed, asked), dimension, min_weeks)


def lag_shifted_panel(observed: DataFrame, target_months: DataFrame, dimension: DataFrame, target: str, min_weeks: int = 2) -> DataFrame:
    """The approximate panel of today's values cut by publication lags, for target months (origin).

    Target: current vintage before the target month. A feature: observations up to the end of the month that lies its
    lag before the target month. Said as windows: a value of today is seen from the day after its date on (target) or from
    the month its lag later (feature), so that the panel is an as-of join like the other.
    """
    lagged = observed.filter(is_current()).join(dimension.select("series_id", F.col("publication_lag_months").alias("_lag")), "series_id")
    seen = F.when(F.col("series_id") == target, F.date_add("obs_date", 1)).otherwise(F.add_months(month_of("obs_date"), F.col("_lag")))
    asked = target_months.select("origin").distinct()
    return _by_month(at_origins(lagged.withColumn("realtime_start", seen).drop("_lag"), asked, "origin"), dimension, min_weeks)


def months_available(panel: DataFrame, moved: DataFrame, target: str) -> DataFrame:
    """(origin, series_id, months): a feature's months with a value, the target's changes."""
    of_target = moved.filter(F.col("series_id") == target)
    return panel.filter((F.col("series_id") != target) & F.col("value").isNotNull()).select("origin", "series_id").union(of_target.select("origin", "series_id")).groupBy("origin", "series_id").agg(F.count(F.lit(1)).alias("months"))


def default_as_of(observed: DataFrame) -> DataFrame:
    """(series_id, as_of): the newest day on which something of a series became known, for a snapshot without a stated day."""
    return observed.groupBy("series_id").agg(F.max("realtime_start").alias("as_of"))


def history(observed: DataFrame, last: int, current: bool = True) -> DataFrame:
    """The newest `last` rows of each series in today's values, each with its change from the row before it.

    The row before, not the month before: a gap is shown as one step. current: keep today's values only; otherwise
    `observed` is one snapshot already.
    """
    w = Window.partitionBy("series_id").orderBy("obs_date")
    newest = Window.partitionBy("series_id").orderBy(F.desc("obs_date"))
    rows = (observed.filter(is_current()) if current else observed).withColumn("mom", F.col("value") - F.lag("value").over(w)).withColumn("_nth", F.row_number().over(newest))
    return rows.filter(F.col("_nth") <= last).select("series_id", "obs_date", "value", "mom")
