"""Explanations of forecasts: checked drivers, sentences as column expressions, a JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import article, direction, even, excluded, jobs_phrase, month_name, months_between, quantity
from tidemark.operators.ridge import DRIVER, top_drivers

#: Largest implied intercept, least contribution or gap worth a sentence (thousands), changes that count as recent,
#: share of the rival's error below which a model counts as clearly better.
LARGEST_INTERCEPT, LEAST, RECENT, CLEARLY = 1e6, 1.0, 6, 0.9
#: Columns that a forecast may lack.
OPTIONAL = {"drivers": f"array<{DRIVER}>", "interval_level": "double", "baseline_point": "double"}


def recent_average(target_changes: DataFrame, regime: tuple[str, str]) -> DataFrame:
    """(origin, recent_n, recent_average): of each origin's newest six changes, those outside the regime."""
    newest = Window.partitionBy("origin").orderBy(F.desc("month"))
    last = target_changes.withColumn("_nth", F.row_number().over(newest)).filter((F.col("_nth") <= RECENT) & ~excluded("month", regime))
    return last.groupBy("origin").agg(F.count(F.lit(1)).cast("int").alias("recent_n"), F.avg("change").alias("recent_average"))


def stale_inputs(panel: DataFrame, forecasts: DataFrame, dimension: DataFrame, target: str) -> DataFrame:
    """(origin, stale): features whose newest value is older than the month to forecast, by series, with how far behind."""
    newest = panel.filter((F.col("series_id") != target) & F.col("value").isNotNull()).groupBy("origin", "series_id").agg(F.max("month").alias("newest"))
    behind = newest.join(forecasts.select("origin", "target_month").distinct(), "origin").withColumn("k", months_between("target_month", "newest")).filter("k > 0")
    named = behind.join(dimension.select("series_id", "label"), "series_id")
    text = F.concat("label", F.lit(" ("), "k", F.when(F.col("k") == 1, F.lit(" month behind)")).otherwise(F.lit(" months behind)")))
    return named.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("series_id", text.alias("text")))).alias("s")).select("origin", F.col("s.text").alias("stale"))


def accuracy_of(cards: DataFrame, rival: str) -> DataFrame:
    """(model, mae, n, rival, rival_mae) from a scorecard, a row a model; the rival itself has none to stand against."""
    other = F.when(F.col("model") != rival, F.max(F.when(F.col("model") == rival, F.col("mae"))).over(Window.partitionBy()))
    return cards.select("model", F.col("mae").alias("measured_mae"), F.col("n").alias("measured_n"), F.lit(rival).alias("rival"), other.alias("rival_mae"))


def _amount(thousands: Column) -> Column:
    return F.format_number(F.abs(even(thousands)) * 1000, 0)


def accuracy_sentence() -> Column:
    measured = F.concat(F.lit("Backtests over "), F.col("measured_n").cast("string"), F.lit(" vintage-correct origins missed by "), _amount(F.col("measured_mae")), F.lit(" jobs on average"))
    verdict = F.when(F.col("measured_mae") >= CLEARLY * F.col("rival_mae"), F.lit("competitive with naive rules, not clearly better")).otherwise(F.lit("clearly better than naive rules"))
    against = F.concat(measured, F.lit(", against "), _amount(F.col("rival_mae")), F.lit(" of "), F.translate("rival", "_", " "), F.lit(": "), verdict, F.lit("."))
    return F.when(F.col("measured_mae").isNull(), F.lit("Accuracy has not been measured here; a walk-forward backtest gives it.")).when(F.col("rival_mae").isNull(), F.concat(measured, F.lit("."))).otherwise(against)


def sentence(d: Column) -> Column:
    verb = F.when(direction(d["contribution"]) == "raises", F.lit("adds")).when(direction(d["contribution"]) == "lowers", F.lit("takes away")).otherwise(F.lit("changes little:"))
    return F.concat(F.upper(F.substring(d["label"], 1, 1)), F.substring(d["label"], 2, 1000), F.lit(" is "), quantity(d["value"], d["unit"]), F.lit(", which "), verb, F.lit(" "), jobs_phrase(d["contribution"], signed=False), F.lit("."))


def explained(forecasts: DataFrame, regime: tuple[str, str], recent: DataFrame | None = None, stale: DataFrame | None = None, accuracy: DataFrame | None = None, count: int = 3, as_of: Column | None = None) -> DataFrame:
    """Forecasts with as_of, statements (of the top drivers) and the sentences headline, interval, anchor, comparison, context, caveats.

    The implied intercept (point less all contributions) must be within bounds, or the row is an error. recent, stale and
    accuracy (see above) are joined where they are given; what is not known is said to be so or left out.
    """
    if count < 1:
        raise ValueError(f"at least one driver is named, not {count}")
    rows = forecasts.filter(F.col("point").isNotNull())
    for name, kind in OPTIONAL.items():
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("as_of", F.col("origin") if as_of is None else as_of)
    for table, key, columns in ((recent, "origin", "recent_n int, recent_average double"), (stale, "origin", "stale array<string>"), (accuracy, "model", "measured_mae double, measured_n long, rival string, rival_mae double")):
        if table is not None:
            rows = rows.join(table, key, "left")
        else:
            rows = rows.select("*", *(F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in columns.split(", ")))
    fitted = F.coalesce(F.size("drivers") > 0, F.lit(False))
    implied = F.col("point") - F.aggregate("drivers", F.lit(0.0), lambda acc, d: acc + d["contribution"])
    checked = F.when(F.abs(implied) >= LARGEST_INTERCEPT, F.raise_error(F.lit("drivers don't add up to the forecast")).cast("double")).otherwise(implied)
    rows = rows.withColumn("_base", F.when(fitted, checked))
    top = F.filter(top_drivers(F.col("drivers"), count), lambda d: F.abs(d["contribution"]) >= LEAST)
    statements = F.transform(top, lambda d: F.struct(d["name"].alias("name"), d["label"].alias("label"), d["value"].alias("value"), d["contribution"].alias("contribution"), direction(d["contribution"]).alias("direction"), sentence(d).alias("sentence")))
    level = F.round(F.col("interval_level") * 100).cast("int")
    ranged = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    gap = F.col("point") - F.col("baseline_point")
    known = F.concat(F.lit("Made from data known on "), F.col("as_of").cast("string"), F.lit("."))
    recently = F.concat(F.lit("The last "), F.col("recent_n").cast("string"), F.lit(" prints averaged "), jobs_phrase("recent_average"), F.lit("; this forecast is "), F.when(F.col("point") > F.col("recent_average"), F.lit("above")).otherwise(F.lit("below")), F.lit(" that. "), known)
    caveats = F.array(
        accuracy_sentence(),
        F.when(fitted, F.concat(F.lit("Drivers are associations over "), F.col("n_train").cast("string"), F.lit(" months, not causes."))),
        F.when(ranged, F.lit("The range is the spread of past errors and holds only while that spread lasts.")).otherwise(F.lit("There is no range: the history is too short for one.")),
        F.concat(F.lit("Months from "), month_name(F.lit(regime[0]).cast("date")), F.lit(" to "), month_name(F.lit(regime[1]).cast("date")), F.lit(" are left out of training.")),
        F.when(fitted & (F.size("stale") > 0), F.concat(F.lit("Some inputs are older than the month forecast: "), F.array_join("stale", ", "), F.lit("."))),
    )
    return rows.select(
        *forecasts.columns, "as_of", *(c for c in OPTIONAL if c not in forecasts.columns), F.coalesce(statements, F.array().cast("array<struct<name: string, label: string, value: double, contribution: double, direction: string, sentence: string>>")).alias("statements"),
        F.concat(F.lit("The next report should show "), jobs_phrase("point"), F.lit(" for "), month_name("target_month"), F.lit(".")).alias("headline"),
        F.when(ranged, F.concat(article(level), F.lit(" "), level.cast("string"), F.lit("% range goes from "), jobs_phrase("lower"), F.lit(" to "), jobs_phrase("upper"), F.lit("."))).alias("interval"),
        F.when(fitted, F.concat(F.lit("The average of the "), F.col("n_train").cast("string"), F.lit(" months of training is "), jobs_phrase("_base"), F.lit("; drivers move it:"))).otherwise(F.concat(F.lit("The rule "), F.translate("model", "_", " "), F.lit(" over recent prints, without a fitted model."))).alias("anchor"),
        F.when(gap.isNull(), F.lit("There is no month before to compare with.")).when(F.abs(gap) < LEAST, F.concat(F.lit("That repeats last month's print of "), jobs_phrase("baseline_point"), F.lit("."))).otherwise(
            F.concat(F.lit("That is "), jobs_phrase(gap, signed=False), F.when(gap > 0, F.lit(" above")).otherwise(F.lit(" below")), F.lit(" last month's print of "), jobs_phrase("baseline_point"), F.lit("."))).alias("comparison"),
        F.when(F.col("recent_n") > 0, recently).otherwise(known).alias("context"),
        F.filter(caveats, lambda c: c.isNotNull()).alias("caveats"),
    )


def text(e: dict) -> str:
    """One explained row as plain text."""
    why = [f"  {d['sentence']}" for d in e["statements"]] or ["  No single driver moved the forecast by much."]
    lines = [e["headline"], *([e["interval"]] if e["interval"] else []), "", e["context"], "", "Why:", f"  {e['anchor']}", *why, "", e["comparison"], "", "Caveats:", *(f"  - {c}" for c in e["caveats"])]
    return "\n".join(lines)


def payload(explanations: DataFrame, series_id: str) -> DataFrame:
    """(origin, model, json): a JSON object for each explained forecast; the names of its fields are fixed values."""
    two = lambda c, name: even(c, 2).alias(name)
    drivers = F.transform("statements", lambda d: F.struct(d["name"].alias("name"), d["label"].alias("label"), even(d["value"], 2).alias("value"), even(d["contribution"], 2).alias("contribution"), d["direction"].alias("direction"), d["sentence"].alias("sentence")))
    body = F.struct(
        F.lit(series_id).alias("series_id"), F.col("target_month").cast("string").alias("month"), F.col("as_of").cast("string").alias("as_of"), "model",
        two("point", "point_thousands"), two("lower", "lower_thousands"), two("upper", "upper_thousands"), "interval_level", "n_train", two("baseline_point", "baseline_point_thousands"),
        "headline", F.col("interval").alias("interval_statement"), "context", "anchor", drivers.alias("drivers"), "caveats",
    )
    return explanations.select("origin", "model", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
