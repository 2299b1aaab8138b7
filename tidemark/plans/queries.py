"""Queries by name, over series derived from the order tables (tidemark.sources.derived)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.functions import columns as C
from tidemark.operators import design, explain, features, revisions, ridge, scoring, store
from tidemark.operators.design import CHANGE, LEVEL, TRAILING_MEAN, Term
from tidemark.operators.ridge_native import forecasts as ridge_native_of
from tidemark.plans import backtest
from tidemark.sources import derived
from tidemark.sources.registry import registry, to_canonical, unit_label
from tidemark.tables import durable, remove, shared_dir, tidy

TARGET, REGIME = derived.TARGET, derived.REGIME
TERMS = (
    Term("trailing_12", TARGET, TRAILING_MEAN, 1),
    Term("change_lag1", TARGET, CHANGE, 1),
    Term("change_lag2", TARGET, CHANGE, 2),
    Term("high_change", "2-HIGH", CHANGE, 1),
    Term("other_level", "4-NOT SPECIFIED", LEVEL, 2),
    Term("shipped_level", derived.WEEKLY, LEVEL, 0),
    Term("shipped_change", derived.WEEKLY, CHANGE, 0),
)
#: Months that the queries about gaps take from the target.
GAPS = ("1994-03-01", "1995-11-01", "1995-12-01", "1997-06-01")
NAIVE = ("random_walk", "mean_3m", "mean_6m", "drift")


def _inputs(spark: SparkSession, sf_dir: str):
    """Observations, stored so that the order tables are read once; release dates; the registry."""
    observed = durable(derived.observations(spark, sf_dir), "observations")
    return observed, derived.releases(observed), registry(spark, derived.SERIES)


def _scored(spark: SparkSession, sf_dir: str, scorecard: str = "vintage", models=NAIVE, common: bool = True) -> DataFrame:
    observed, calendar, dimension = _inputs(spark, sf_dir)
    return backtest.walk_forward(observed, calendar, dimension, TARGET, TERMS, REGIME, scorecard, models, common)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded for comparison; the small shift keeps values off exact ties, where engines differ by the last bit."""
    return df.select(*(F.round(F.col(c) + 1e-7, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _panel(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    observed, calendar, dimension = _inputs(spark, sf_dir)
    if shifted:
        return features.lag_shifted_panel(observed, backtest.origins_of(observed, calendar, "lag_shifted", TARGET), dimension, TARGET)
    return features.panel(observed, calendar, dimension)


def _stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(_panel(spark, sf_dir), "panel")


def observations_vintages(spark, sf_dir):
    return _rounded(derived.observations(spark, sf_dir))


def canonical_values(spark, sf_dir):
    observed, _, dimension = _inputs(spark, sf_dir)
    scaled = to_canonical(observed.filter(C.is_current()), dimension)
    labels = dimension.select("series_id", unit_label(F.col("units")).alias("unit"))
    return _rounded(scaled.join(labels, "series_id").select("series_id", "obs_date", "value", "unit"))


def asof_panel(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir))


def lag_shifted_panel(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir, shifted=True))


def weekly_to_monthly(spark, sf_dir):
    weekly = derived.observations(spark, sf_dir).filter((F.col("series_id") == derived.WEEKLY) & C.is_current())
    return _rounded(features.monthly(weekly, ["series_id"], min_weeks=4))


def monthly_changes(spark, sf_dir):
    return _rounded(features.changes(_panel(spark, sf_dir), ["origin", "series_id"]))


def trailing_mean(spark, sf_dir):
    moved = features.changes(_panel(spark, sf_dir).filter(F.col("series_id") == TARGET), ["origin"])
    return _rounded(design.trailing_mean(moved, 12, 6, REGIME))


def baseline_forecasts(spark, sf_dir):
    made = backtest.attempts(_stored_panel(spark, sf_dir), TARGET, TERMS, REGIME, NAIVE, registry(spark, derived.SERIES))
    return _rounded(made.filter("point is not null").select("origin", "target_month", "model", "point", "lower", "upper", "n_train"))


def scorecard_baselines(spark, sf_dir):
    return _rounded(scoring.scorecard(_scored(spark, sf_dir)))


def scorecard_lag_shifted(spark, sf_dir):
    return _rounded(scoring.scorecard(_scored(spark, sf_dir, "lag_shifted")))


def _with_gaps(spark: SparkSession, sf_dir: str):
    observed, calendar, dimension = _inputs(spark, sf_dir)
    gone = (F.col("series_id") == TARGET) & F.col("obs_date").isin([F.lit(m).cast("date") for m in GAPS])
    return observed.filter(~gone), calendar, dimension


def gap_outcomes(spark, sf_dir):
    """Every lag-shifted forecast over a target with missing months, beside what it aims at: the step from the newest month with a change."""
    observed, calendar, dimension = _with_gaps(spark, sf_dir)
    found = backtest.outcomes(observed, calendar, dimension, TARGET, TERMS, REGIME, "lag_shifted", (*NAIVE, "ridge"))
    return _rounded(found.select("origin", "target_month", "model", "point", "lower", "upper", "n_train", "actual", "skip_reason"))


def gap_scorecard(spark, sf_dir):
    observed, calendar, dimension = _with_gaps(spark, sf_dir)
    return _rounded(scoring.scorecard(backtest.walk_forward(observed, calendar, dimension, TARGET, TERMS, REGIME, "lag_shifted", NAIVE)))


def relative_mae(spark, sf_dir):
    return _rounded(scoring.relative_mae(scoring.scorecard(_scored(spark, sf_dir)), "random_walk", NAIVE))


def attempted_scored(spark, sf_dir):
    """Origins attempted, scored by all models, and dropped."""
    every = _scored(spark, sf_dir, common=False).groupBy("origin").agg(F.countDistinct("model").alias("k"))
    full = F.count_if(F.col("k") == len(NAIVE))
    return every.agg(F.count(F.lit(1)).alias("n_attempted"), full.alias("n_scored"), (F.count(F.lit(1)) - full).alias("n_dropped"))


def significance(spark, sf_dir):
    return _rounded(scoring.diebold_mariano(scoring.paired(_scored(spark, sf_dir), "mean_3m")))


def _design(spark, sf_dir, panel=None):
    dimension = registry(spark, derived.SERIES)
    return design.rows(_stored_panel(spark, sf_dir) if panel is None else panel, TERMS, TARGET, REGIME, ridge.LEAST_ROWS, backtest.lags_of(dimension))


def design_matrix(spark, sf_dir):
    return _rounded(_design(spark, sf_dir).drop("last_change", "skip_reason").withColumn("missing", F.array_join("missing", ",")))


def _ridge(spark, sf_dir, panel=None):
    return ridge.forecasts(_design(spark, sf_dir, panel), TERMS, backtest.units_of(registry(spark, derived.SERIES)))


def ridge_forecasts(spark, sf_dir):
    return _rounded(_ridge(spark, sf_dir).drop("drivers"))


def ridge_native(spark, sf_dir):
    """The same forecasts by expressions alone, without a Python group."""
    stored = durable(_design(spark, sf_dir), "design")
    return _rounded(ridge_native_of(stored, TERMS, backtest.units_of(registry(spark, derived.SERIES))).drop("drivers"))


def ridge_drivers(spark, sf_dir):
    """Every term's value, weight and contribution in every forecast."""
    made = _ridge(spark, sf_dir).filter("point is not null").select("origin", F.inline("drivers"))
    return _rounded(made.select("origin", "name", "value", "coefficient", "contribution"))


def ridge_scorecard(spark, sf_dir):
    return _rounded(scoring.scorecard(_scored(spark, sf_dir, models=(*NAIVE, "ridge"))))


def model_skips(spark, sf_dir):
    """Which model could not forecast how many origins, and why."""
    observed, calendar, dimension = _inputs(spark, sf_dir)
    return backtest.skips(backtest.outcomes(observed, calendar, dimension, TARGET, TERMS, REGIME, "vintage", (*NAIVE, "ridge")))


def recent_average(spark, sf_dir):
    moved = features.changes(_panel(spark, sf_dir).filter(F.col("series_id") == TARGET), ["origin"])
    return _rounded(explain.recent_average(moved, REGIME))


def months_available(spark, sf_dir):
    panel = _stored_panel(spark, sf_dir)
    return features.months_available(panel, features.changes(panel, ["origin", "series_id"]), TARGET)


def default_as_of(spark, sf_dir):
    return features.default_as_of(derived.observations(spark, sf_dir))


def _explained(spark, sf_dir):
    """Ridge forecasts of all origins explained, with the measured accuracy of ridge and of the six-month mean."""
    observed, calendar, dimension = _inputs(spark, sf_dir)
    panel = durable(features.panel(observed, calendar, dimension), "panel")
    moved = durable(features.changes(panel, ["origin", "series_id"]), "changes")
    made = durable(_ridge(spark, sf_dir, panel), "ridge")
    recent = explain.recent_average(moved.filter(F.col("series_id") == TARGET), REGIME)
    cards = scoring.scorecard(backtest.walk_forward(observed, calendar, dimension, TARGET, TERMS, REGIME, models=("mean_6m", "ridge")))
    return explain.explained(made, REGIME, recent, explain.stale_inputs(panel, made, dimension, TARGET), explain.accuracy_of(cards, "mean_6m"), as_of=F.date_sub("origin", 1))


def explanations(spark, sf_dir):
    said = F.array_join(F.transform("statements", lambda d: d["sentence"]), " ").alias("drivers")
    return _explained(spark, sf_dir).select("origin", "headline", "interval", "anchor", said, "comparison", "context", F.array_join("caveats", " ").alias("caveats"))


def forecast_json(spark, sf_dir):
    return explain.payload(_explained(spark, sf_dir), TARGET)


def _as_batch(observed: DataFrame, day: str) -> DataFrame:
    return observed.withColumn("source", F.lit("derived")).withColumn("fetched_at", F.lit(day).cast("timestamp"))


def upsert_observations(spark, sf_dir):
    """Two overlapping batches: the first ends every window it knows last, the second closes them; once more changes nothing."""
    observed = durable(derived.observations(spark, sf_dir), "observations")
    first = observed.filter("realtime_end < '9999-12-31'").withColumn("realtime_end", F.when(F.col("realtime_start") == F.max("realtime_start").over(_of_date()), F.lit("9999-12-31").cast("date")).otherwise(F.col("realtime_end")))
    stored = store.upserted(_as_batch(first, "2001-01-01"), _as_batch(observed, "2002-01-01"))
    again = store.upserted(stored, _as_batch(observed, "2002-01-01"))
    return _rounded(again.select("series_id", "obs_date", "realtime_start", "realtime_end", "value"))


def _of_date():
    from pyspark.sql import Window

    return Window.partitionBy("series_id", "obs_date")


def release_calendar(spark, sf_dir):
    """The calendar after a repeated upsert, up to a cutoff."""
    days = derived.releases(derived.observations(spark, sf_dir)).select(F.lit(194).alias("release_id"), F.col("origin").alias("release_date"))
    return store.release_upserted(days, days.filter("release_date > '2000-01-01'")).filter("release_date <= '2001-06-30'")


def series_summary(spark, sf_dir):
    """Rows, dates, revisions for each date and the newest date of every series."""
    return _rounded(derived.observations(spark, sf_dir).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("obs_date").alias("n_dates"),
        (F.count(F.lit(1)) / F.countDistinct("obs_date")).alias("revision_density"), F.max("obs_date").alias("latest")))


def store_violations(spark, sf_dir):
    """What the guards would refuse: overlapping windows, inverted ones, repeated dates in a snapshot."""
    observed, calendar, _ = _inputs(spark, sf_dir)
    report = store.batch_report(_as_batch(observed, "2002-01-01"))
    snapshots = store.at_origins(observed.filter(F.col("series_id") == TARGET), calendar.distinct(), "origin")
    repeated = features.duplicate_dates(snapshots, ["origin", "series_id"]).agg(F.count(F.lit(1)).alias("repeated"))
    zero = F.lit(0).cast("long")
    both = report.select("n_rows", "historical", "inverted", zero.alias("repeated")).union(repeated.select(zero, zero, zero, "repeated"))
    return both.agg(*(F.sum(c).alias(c) for c in both.columns))


def stored_revisions(spark, sf_dir):
    """Revisions without windows, written to a store in three batches that overlap, latest first: each batch's windows are made of all
    revisions known by then, so that later ones split what earlier ones left open; buckets are merged, then read back."""
    observed = durable(derived.observations(spark, sf_dir), "observations")
    known = observed.select("series_id", "obs_date", "realtime_start", "value", F.lit("derived").alias("source"), F.lit("2002-01-01").cast("timestamp").alias("fetched_at"))
    kept = store.Store(spark, f"{shared_dir(spark)}/tidemark-store-{uuid.uuid4().hex}", 2, 4, most_segments=2)
    try:
        nth = F.row_number().over(_of_date().orderBy("realtime_start"))
        known = durable(known.withColumn("nth", nth), "revisions")
        for most in ("nth = 3", "nth >= 2", "nth >= 1"):
            kept.upsert(revisions.windows(known.filter(most).drop("nth")))
        return durable(_rounded(kept.observations().select("series_id", "obs_date", "realtime_start", "realtime_end", "value")), "stored-revisions")
    finally:
        remove(spark, kept.path)


def late_revisions(spark, sf_dir):
    """The same revisions as a stream, each twice and in no order: state by series and date closes windows as revisions arrive."""
    folder = f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    kept = store.Store(spark, f"{folder}/store", 2, 4)
    before = {name: spark.conf.get(name) for name in streaming.STATE_STORE}
    try:
        known = derived.observations(spark, sf_dir).select("series_id", "obs_date", "realtime_start", "value", F.lit("derived").alias("source"), F.lit("2002-01-01").cast("timestamp").alias("fetched_at"))
        twice = known.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
        twice.repartition(4, F.xxhash64("series_id", "obs_date", "realtime_start", "_copy")).drop("_copy").write.parquet(f"{folder}/in")
        for name, value in streaming.STATE_STORE.items():
            spark.conf.set(name, value)
        arriving = spark.readStream.schema(revisions.REVISIONS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        streaming.upsert_stream(streaming.windows_stream(arriving), kept, f"{folder}/checkpoint", guarded=False).trigger(availableNow=True).start().awaitTermination()
        return durable(_rounded(kept.observations().select("series_id", "obs_date", "realtime_start", "realtime_end", "value")), "late-revisions")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        remove(spark, folder)


def history(spark, sf_dir):
    return _rounded(features.history(derived.observations(spark, sf_dir), 12))


#: Each leaves its result's table at most.
QUERIES = {f.__name__: tidy(f) for f in (
    observations_vintages, canonical_values, asof_panel, lag_shifted_panel, weekly_to_monthly, monthly_changes, trailing_mean, baseline_forecasts,
    scorecard_baselines, scorecard_lag_shifted, gap_outcomes, gap_scorecard, relative_mae, attempted_scored, significance, design_matrix, ridge_forecasts, ridge_native, ridge_scorecard,
    explanations, forecast_json, ridge_drivers, model_skips, recent_average, months_available, default_as_of, upsert_observations, stored_revisions, late_revisions, release_calendar, series_summary, store_violations, history)}
