"""Command line: ingest, history, forecast, backtest. `python -m tidemark.app --store DIR history`.

Exit codes: 0 done; 1 an error of this library, a store that is not there, or an ingest of which a series failed; 2 an
unknown option, model, series or scorecard.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.exceptions import TidemarkError
from tidemark.operators import baselines, explain, features, ridge, scoring
from tidemark.operators.design import default_terms, rows
from tidemark.operators.store import Store, batch_report, refusal
from tidemark.plans import backtest
from tidemark.sources.registry import INGEST_START, REGIME, RELEASE_ID, ids, lookup, registry
from tidemark.tables import durable, scratch, tidy

log = logging.getLogger("tidemark")
#: The naive model that accuracy is measured against.
RIVAL = "mean_6m"
TITLES = {
    "vintage": "Vintage-correct scorecard: panels as they were known, against what was printed",
    "lag_shifted": "Lag-shifted scorecard (approximate): today's values cut by publication lags; revisions are not seen",
}


def ingest(spark: SparkSession, store: Store, base_url: str, series: list[str] | None = None) -> dict[str, str]:
    """All series by one read and one write. What was done, by series: a series that fails doesn't stop the others, nor do release dates."""
    from tidemark.sources.rest import VintageSource

    spark.dataSource.register(VintageSource)
    names = series or ids()
    read = lambda **o: spark.read.format("vintages").options(base_url=base_url, errors="rows", **o).load()
    with scratch(spark):
        got = durable(read(keys=",".join(names), start=INGEST_START), "ingested")
        reports = {r["series_id"]: r for r in batch_report(got.filter("error is null"), "series_id").collect()}  # a row a series
        failed = {r["series_id"]: r["error"] for r in got.filter("error is not null").groupBy("series_id").agg(F.min("error").alias("error")).collect()}
        failed |= {name: why for name, r in reports.items() if name not in failed and (why := refusal(r))}
        good = [name for name in names if name not in failed]
        store.upsert(got.filter(F.col("error").isNull() & F.col("series_id").isin(good)))
        newest = {r["series_id"]: r["d"] for r in store.observations(good).groupBy("series_id").agg(F.max("obs_date").alias("d")).collect()}
        done = {name: f"failed: {failed[name][:200]}" if name in failed else f"{reports[name]['n_rows'] if name in reports else 0} rows through {newest.get(name)}" for name in names}
        days = durable(read(keys=str(RELEASE_ID), table="release_dates"), "ingested-dates")
        wrong = days.agg(F.min("error")).first()[0]
        done["release_dates"] = f"failed: {wrong[:200]}" if wrong else f"{store.upsert_releases(days)} dates"
    for name, said in done.items():
        if said.startswith("failed"):
            log.warning("%s: %s", name, said)
    return done


@tidy
def forecast(spark: SparkSession, store: Store, today: str, model: str, with_accuracy: bool = False, level: float = 0.8) -> DataFrame:
    """The explained forecast as of `today` for the month after the newest known one; no row where there is none."""
    backtest.check_models([model])
    target = ids("target")[0]
    dimension, terms = registry(spark), default_terms(target)
    observed = store.observations()
    origins = spark.createDataFrame([(today,)], "origin string").select(F.col("origin").cast("date"))
    panel = durable(features.panel(observed, origins, dimension, one_day=0), "panel")
    moved = durable(features.changes(panel, ["origin", "series_id"]), "changes")
    of_target = moved.filter(F.col("series_id") == target).select("origin", "month", "change")
    if model == "ridge":
        made = ridge.forecasts(rows(panel, terms, target, REGIME, ridge.LEAST_ROWS, backtest.lags_of(dimension), moved), terms, backtest.units_of(dimension), level=level)
    else:
        made = baselines.forecasts(of_target, REGIME).filter(F.col("model") == model).withColumn("interval_level", F.lit(0.8))
    made = durable(made, "forecast")
    accuracy = None
    if with_accuracy:
        calendar = store.releases(RELEASE_ID, today).select(F.col("release_date").alias("origin"))
        models = [model] if model == RIVAL else [model, RIVAL]
        cards = scoring.scorecard(backtest.walk_forward(observed, calendar, dimension, target, terms, REGIME, "vintage", models))
        accuracy = durable(explain.accuracy_of(cards, RIVAL), "accuracy")
    return explain.explained(made, REGIME, explain.recent_average(of_target, REGIME), explain.stale_inputs(panel, made, dimension, target), accuracy)


def scorecard_lines(spark: SparkSession, store: Store, today: str, scorecard: str, level: float) -> list[str]:
    """A scorecard as text: counts, scores, the best model's margin, and what could not be forecast."""
    target = ids("target")[0]
    calendar = store.releases(RELEASE_ID).select(F.col("release_date").alias("origin"))
    with scratch(spark) as scope:
        found = scope.keep(backtest.outcomes(store.observations(), calendar, registry(spark), target, default_terms(target), REGIME, scorecard, backtest.MODELS, today, level), "outcomes")
    scored = scoring.common_origins(found.filter(F.col("point").isNotNull()), len(backtest.MODELS))
    n, kept, first, last = found.agg(F.countDistinct("origin")).first()[0], *scored.agg(F.countDistinct("origin"), F.min("origin"), F.max("origin")).first()
    lines = [TITLES[scorecard], f"origins attempted: {n}, scored by all models: {kept}, dropped: {n - kept}"]
    if kept:
        lines.append(f"period: {first} to {last}")
        scoring.checked(scored, backtest.MODELS)
        cards = {r["model"]: r for r in scoring.scorecard(scored, nominal=level).collect()}  # a row a model
        lines.append(f"{'model':14}{'n':>5}{'MAE':>10}{'RMSE':>10}{'bias':>10}{'dir%':>7}{'cover':>7}{'gap':>7}{'width':>10}")
        share = lambda x, sign="": "-" if x is None else f"{100 * x:{sign}.0f}%"
        for m in backtest.MODELS:
            r = cards[m]
            width = "-" if r["mean_interval_width"] is None else f"{r['mean_interval_width']:.0f}"
            lines.append(f"{m:14}{r['n']:>5}{r['mae']:>10.1f}{r['rmse']:>10.1f}{r['bias']:>+10.1f}{share(r['directional_accuracy']):>7}{share(r['interval_coverage']):>7}{share(r['coverage_gap'], '+'):>7}{width:>10}")
        best = min(backtest.MODELS, key=lambda m: cards[m]["mae"])
        lines.append(f"best MAE: {best}")
        for r in scoring.diebold_mariano(scoring.paired(scored, best)).orderBy("rival", "loss").collect():
            said = "not testable" if r["p_value"] is None else f"difference {r['mean_difference']:+.1f}, t {r['statistic']:.2f}, p {r['p_value']:.3f}: {'significant' if r['p_value'] < 0.05 else 'indistinguishable'}"
            lines.append(f"{best} against {r['rival']}, {r['loss']} loss: {said}")
    missed = backtest.skips(found).groupBy("model").agg(F.sum("n_origins").alias("n")).orderBy("model").collect()
    return lines + [f"{r['model']} could not forecast {r['n']} origins" for r in missed]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--store", required=True)
    parser.add_argument("--log-level", default="WARNING", type=str.upper, choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    command = parser.add_subparsers(dest="command", required=True)
    load = command.add_parser("ingest")
    load.add_argument("--base-url", required=True)
    load.add_argument("--series", nargs="*")
    past = command.add_parser("history")
    past.add_argument("-n", "--count", type=int, default=12)
    one = command.add_parser("forecast")
    one.add_argument("-m", "--model", default="ridge", choices=sorted(backtest.MODELS))
    one.add_argument("--with-accuracy", action="store_true")
    one.add_argument("--json", action="store_true")
    test = command.add_parser("backtest")
    test.add_argument("--scorecard", default="both", choices=["vintage", "lag_shifted", "both"])
    test.add_argument("--interval-level", type=float, default=0.8)
    for p in (past, one, test):
        p.add_argument("--today", default=date.today().isoformat())
    a = parser.parse_args(argv)
    if a.command == "history" and a.count < 1:
        parser.error("at least one row is shown")
    if a.command == "backtest" and not 0.01 <= a.interval_level <= 0.99:
        parser.error("an interval level lies between 0.01 and 0.99")
    unknown = sorted(set(a.series or ()) - set(ids())) if a.command == "ingest" else []
    if unknown:
        parser.error(f"unknown series {', '.join(unknown)}; known: {', '.join(ids())}")
    logging.basicConfig(level=a.log_level, stream=sys.stderr)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    store = Store(spark, a.store)
    try:
        if a.command != "ingest" and not store.exists():
            print(f"there is no store at {a.store}; ingest first", file=sys.stderr)
            return 1
        if a.command == "ingest":
            began = time.time()
            done = ingest(spark, store, a.base_url, a.series)
            print("\n".join(f"{k}: {v}" for k, v in done.items()))
            failed = [k for k, v in done.items() if v.startswith("failed") and k != "release_dates"]
            print(f"{store.observations().count()} observations stored, {len(failed)} series failed, {time.time() - began:.1f} s")
            return int(bool(failed))
        target = ids("target")[0]
        if a.command == "history":
            found = features.history(store.observations(target, as_of=a.today), a.count, current=False).orderBy("obs_date").collect()
            if not found:
                print(f"no observations of {target}; ingest first", file=sys.stderr)
                return 1
            print(lookup(target)[3])
            for r in found:
                print(f"{r['obs_date']}  {r['value']:>14,.0f}  {'' if r['mom'] is None else format(r['mom'], '+,.0f'):>12}" if r["value"] is not None else f"{r['obs_date']}  {'-':>14}")
        elif a.command == "forecast":
            found = forecast(spark, store, a.today, a.model, a.with_accuracy)
            said = [r["json"] for r in explain.payload(found, target).collect()] if a.json else [explain.text(r.asDict(recursive=True)) for r in found.collect()]
            if not said:
                print(f"{a.model} has too little history on {a.today}", file=sys.stderr)
                return 1
            print(*said, sep="\n")
        else:
            for card in ("vintage", "lag_shifted") if a.scorecard == "both" else (a.scorecard,):
                print("\n".join(scorecard_lines(spark, store, a.today, card, a.interval_level)), end="\n\n")
    except TidemarkError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
