import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.exceptions import ConfigurationError
from tidemark.functions import columns as C
from tidemark.operators import baselines, design, explain, features, ridge
from tidemark.sources.registry import ids, lookup, registry, to_canonical


def months(n, start=2020):
    return [date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_weeks_go_to_the_month_of_their_end_and_thin_months_stay_null(spark):
    rows = [("S", date(2026, 7, 4), 200.0), ("S", date(2026, 7, 11), 210.0), ("S", date(2026, 7, 18), None), ("S", date(2026, 8, 1), 5.0)]
    got = {r["month"]: (r["value"], r["weeks_used"]) for r in features.monthly(spark.createDataFrame(rows, "series_id string, obs_date date, value double"), ["series_id"]).collect()}
    assert got == {date(2026, 7, 1): (205.0, 2), date(2026, 8, 1): (None, 1)}


def test_gaps_are_skipped_and_not_bridged(spark):
    rows = [("S", date(2026, 1, 1), 1.0), ("S", date(2026, 2, 1), 3.0), ("S", date(2026, 4, 1), 9.0), ("S", date(2026, 5, 1), None), ("S", date(2026, 6, 1), 4.0)]
    got = features.changes(spark.createDataFrame(rows, "series_id string, month date, value double"), ["series_id"]).collect()
    assert [(r["month"], r["change"]) for r in got] == [(date(2026, 2, 1), 2.0)]


def test_changes_across_vintages_are_refused(spark):
    d = lambda x: F.lit(x).cast("date")
    v = features.safe_change(F.lit(902.0), F.lit(871.5), (d("2026-02-04"), d("9999-12-31")), (d("2026-01-07"), d("2026-02-03")), d("2026-02-10"))
    with pytest.raises(Exception, match="different vintages"):
        one(spark, v)
    assert one(spark, features.safe_change(F.lit(3.0), F.lit(1.0), (d("2026-02-04"), d("9999-12-31")), (d("2026-02-04"), d("9999-12-31")), d("2026-02-10"))) == 2.0


def test_changes_hold_windows_against_the_snapshot(spark):
    d = date
    columns = "series_id string, month date, value double, realtime_start date, realtime_end date, as_of date"
    rows = lambda end, start, day: spark.createDataFrame([("S", d(2026, 1, 1), 1.0, d(2026, 1, 9), end, day), ("S", d(2026, 2, 1), 4.0, start, d(9999, 12, 31), day)], columns)
    good = features.changes(rows(d(2026, 3, 1), d(2026, 2, 9), d(2026, 2, 20)), ["series_id"], "as_of").collect()
    assert [(r["change"], r["level"], r["previous_level"]) for r in good] == [(3.0, 4.0, 1.0)]
    with pytest.raises(Exception, match="different vintages"):
        features.changes(rows(d(2026, 2, 1), d(2026, 2, 9), d(2026, 2, 20)), ["series_id"]).collect()
    with pytest.raises(Exception, match="not of this snapshot"):
        features.changes(rows(d(2026, 3, 1), d(2026, 2, 9), d(2026, 3, 20)), ["series_id"], "as_of").collect()


@pytest.mark.parametrize("t,df", [(2.776, 4), (2.447, 6), (2.365, 7), (2.262, 9), (2.131, 15), (2.060, 25), (2.000, 60)])
def test_published_critical_values(spark, t, df):
    assert one(spark, C.two_sided_p(F.lit(t), F.lit(df))) == pytest.approx(0.05, abs=1e-3)


def test_p_for_any_degrees_of_freedom(spark):
    """Against the finite series at whole numbers, and a plain integral of the density at others."""
    import math

    ts, dfs = [0.0, 0.3, 1.1, 2.7, 6.0, -2.7], [1, 2, 3, 8, 39, 250]
    pairs = spark.createDataFrame([(t, n) for t in ts for n in dfs], "t double, n int")
    for r in pairs.select("t", "n", C.two_sided_p("t", "n").alias("a"), C.two_sided_p_any("t", "n").alias("b")).collect():
        assert r["b"] == pytest.approx(r["a"], abs=1e-10), r

    def integral(t, n, steps=200_000):
        c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        f = lambda x: c * (1 + x * x / n) ** (-(n + 1) / 2)
        h = t / steps
        return 1 - 2 * h / 3 * (f(0) + f(t) + 4 * sum(f((2 * i - 1) * h) for i in range(1, steps // 2 + 1)) + 2 * sum(f(2 * i * h) for i in range(1, steps // 2)))

    for t, n in ((1.4, 2.5), (3.3, 2.5), (0.6, 0.7), (2.0, 17.25)):
        assert one(spark, C.two_sided_p_any(F.lit(t), F.lit(n))) == pytest.approx(integral(t, n), abs=1e-9)
    assert one(spark, C.two_sided_p_any(F.lit(None).cast("double"), F.lit(2.5))) is None
    for z in (0.05, 0.5, 1.0, 3.7, 40.0):
        assert one(spark, C.log_gamma(F.lit(z))) == pytest.approx(math.lgamma(z), abs=1e-10)


def test_scores_need_forecasts_actuals_and_the_same_origins(spark):
    from tidemark.exceptions import InsufficientDataError
    from tidemark.operators import scoring

    columns = "origin date, model string, point double, lower double, upper double, actual double"
    table = lambda *rows: spark.createDataFrame([(date(2026, m, 1), name, p, None, None, a) for m, name, p, a in rows], columns)
    good = [(m, name, 1.0 * m, 2.0) for m in (1, 2, 3) for name in "xy"]
    assert scoring.checked(table(*good), ["x", "y"]).count() == 6
    assert sorted((r["rival"], r["e_model"], r["e_rival"]) for r in scoring.paired(table(*good, (4, "y", 9.0, 1.0)), "x").collect()) == [("y", e, e) for e in (-1.0, 0.0, 1.0)]
    for rows, models, kind, said in (
        ([], [], InsufficientDataError, "no forecasts"), (good, ["x", "z"], InsufficientDataError, "for z"), ([*good, (4, "x", 1.0, None)], [], ValueError, "no actual"),
        ([*good, (1, "x", 3.0, 2.0)], [], ValueError, "4 forecasts of 3 origins"), ([*good, (4, "x", 3.0, 2.0)], [], ValueError, "same origins"), ([*good[:-1], (4, "y", 3.0, 2.0)], [], ValueError, "same origins")):
        with pytest.raises(kind, match=said):
            scoring.checked(table(*rows), models)
    with pytest.raises(ValueError, match="one step ahead"):
        scoring.diebold_mariano(scoring.paired(table(*good), "x"), horizon=2)


def test_values_and_phrases(spark):
    assert one(spark, C.value_of(F.lit(" . "))) is None
    assert one(spark, C.value_of(F.lit("1.5"))) == 1.5
    with pytest.raises(Exception):  # noqa: B017
        one(spark, C.value_of(F.lit("abc")))
    assert one(spark, C.jobs_phrase(F.lit(2.5))) == "a gain of 2,000 jobs"
    assert one(spark, C.jobs_phrase(F.lit(-41.0))) == "a loss of 41,000 jobs"
    assert one(spark, C.month_name(F.lit("2026-07-01").cast("date"))) == "July 2026"


def test_registry(spark):
    assert ids()[0] == ids("target")[0] == "ADPMNUSNERSA"
    with pytest.raises(ConfigurationError, match="known"):
        lookup("NONE")
    rows = spark.createDataFrame([("ICSA", 2000.0), ("UNRATE", None)], "series_id string, value double")
    assert {r["series_id"]: r["value"] for r in to_canonical(rows, registry(spark)).collect()} == {"ICSA": 2.0, "UNRATE": None}
    with pytest.raises(Exception, match="unknown series"):
        to_canonical(spark.createDataFrame([("X", 1.0)], "series_id string, value double"), registry(spark)).collect()


def test_baselines_against_plain_loops(spark):
    values = [3.0, -1.0, 4.0, 1.0, -5.0, 9.0, 2.0, 6.0]
    regime = ("2020-04-01", "2020-04-01")
    rows = [(date(2021, 1, 1), m, v) for m, v in zip(months(8), values, strict=True)]
    got = {r["model"]: r for r in baselines.forecasts(spark.createDataFrame(rows, "origin date, month date, change double"), regime).collect()}
    v = values[:3] + values[4:]
    rules = {"random_walk": lambda h: h[-1], "mean_3m": lambda h: sum(h[-3:]) / 3, "mean_6m": lambda h: sum(h[-6:]) / 6, "drift": lambda h: h[-1] + (h[-1] - h[0]) / (len(h) - 1)}
    for model, rule in rules.items():
        errors = [v[i] - rule(v[:i]) for i in range(baselines.MINIMUM[model], len(v))]
        assert got[model]["point"] == pytest.approx(rule(v))
        assert got[model]["target_month"] == date(2020, 9, 1)
        if len(errors) >= 2:
            assert got[model]["upper"] - got[model]["point"] == pytest.approx(1.2816 * (sum(e * e for e in errors) / len(errors)) ** 0.5)
        else:
            assert got[model]["upper"] is None


def test_terms_may_not_look_ahead():
    with pytest.raises(ConfigurationError):
        design.check_terms([design.Term("x", "T", design.CHANGE, 0)], "T", {"T": 0})
    with pytest.raises(ConfigurationError):
        design.check_terms([design.Term("x", "F", design.CHANGE, 1)], "T", {"F": 2})
    design.check_terms(design.default_terms("T"), "T", {"T": 1, "ICSA": 0, "JTSJOL": 2})


def test_ridge_against_plain_algebra():
    rng = np.random.default_rng(21)
    x = rng.normal([5.0, -300.0, 0.01], [1.0, 20.0, 0.002], (47, 3))
    y = x @ [1.5, 0.25, 700.0] + rng.normal(0, 3, 47)
    penalties = (0.5, 4.0, 60.0)

    def plain(n, a):  # one system of equations for each prefix and penalty
        m, s = x[:n].mean(0), x[:n].std(0)
        z = (x[:n] - m) / s
        w = np.linalg.solve(z.T @ z + a * np.eye(3), z.T @ (y[:n] - y[:n].mean()))
        return lambda v: y[:n].mean() + (v - m) / s @ w

    table = [(24, 28), (28, 32), (32, 36), (36, 40), (40, 44), (44, 47)]
    assert ridge.fold_table(47).tolist() == [list(t) for t in table] and len(ridge.fold_table(25)) == 0
    errors = {a: np.concatenate([y[i:j] - plain(i, a)(x[i:j]) for i, j in table]) for a in penalties}
    best = min(penalties, key=lambda a: (errors[a] ** 2).mean())
    new = np.array([6.0, -280.0, 0.012])
    got = ridge.forecast(x, y, new, penalties, 0.8)
    assert got["penalty"] == best and got["point"] == pytest.approx(plain(47, best)(new))
    assert [got["lower"] - got["point"], got["upper"] - got["point"]] == pytest.approx(list(np.quantile(errors[best], [0.1, 0.9])))
    assert got["intercept"] + got["contributions"].sum() == pytest.approx(got["point"])
    assert ridge.forecast(x, y, new, (0.0,), 0.8)["point"] == pytest.approx(plain(47, 0.0)(new))
    with pytest.raises(ValueError):
        ridge.forecast(x, y, new, (-1.0,), 0.8)
    flat = np.c_[x, np.full(47, 3.0)]  # an input that never changes moves nothing
    assert ridge.forecast(flat, y, np.r_[new, 3.0], penalties, 0.8)["point"] == pytest.approx(got["point"])


def test_native_ridge_equals_the_grouped_one(spark):
    """All columns to 1e-8: many and few rows, a flat input, too few errors for an interval, an origin that is skipped."""
    from tidemark.operators import ridge_native
    from tidemark.tables import durable

    rng = np.random.default_rng(8)
    terms = [design.Term(f"t{j}", "F", design.LEVEL, 1) for j in range(4)]
    rows = []
    for k, (n, skip) in enumerate([(120, None), (61, None), (47, None), (36, None), (30, None), (25, None), (12, "too few")]):
        x = np.c_[rng.normal([5.0, -3e5, 0.01], [1.0, 200.0, 0.002], (n + 1, 3)), np.full(n + 1, 3.0)]
        y = x[:, :3] @ [1.5, 0.025, 700.0] + rng.normal(0, 3, n + 1)
        for i, m in enumerate(months(n + 1, 2001)):
            rows.append((date(2025, 1, 1 + k), m, i == n, None if i == n else float(y[i]), *map(float, x[i]), "ok", n, 7.0, skip))
        rows.append((date(2025, 1, 1 + k), date(1999, 1, 1), False, 1e9, 1.0, 1.0, 1.0, 1.0, "excluded", n, 7.0, skip))
    table = durable(spark.createDataFrame(rows, "origin date, month date, is_next boolean, y double, t0 double, t1 double, t2 double, t3 double, status string, n_ok long, last_change double, skip_reason string"), "design")
    for penalties in (ridge.PENALTIES, (3.0,)):
        a, b = ({r["origin"]: r for r in made.collect()} for made in (ridge.forecasts(table, terms, {"F": "u"}, penalties, 0.9), ridge_native.forecasts(table, terms, {"F": "u"}, penalties, 0.9)))
        assert len(a) == 7 == len(b)
        for origin, r in a.items():
            s = b[origin]
            for c in ("target_month", "model", "n_train", "baseline_point", "penalty", "skip_reason", "interval_level"):
                assert r[c] == s[c], (origin, c)
            for c in ("point", "lower", "upper", "intercept"):
                assert (r[c] is None) == (s[c] is None) and (r[c] is None or s[c] == pytest.approx(r[c], rel=1e-8, abs=1e-8)), (origin, c)
            assert (r["drivers"] is None) == (s["drivers"] is None)
            for d, e in zip(r["drivers"] or (), s["drivers"] or (), strict=True):
                assert (d["name"], d["unit"], d["value"]) == (e["name"], e["unit"], e["value"])
                assert e["contribution"] == pytest.approx(d["contribution"], abs=1e-8) and e["coefficient"] == pytest.approx(d["coefficient"], abs=1e-8)


def test_top_drivers_break_ties_by_place(spark):
    d = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("contribution")) for n, c in (("a", -2.0), ("b", 5.0), ("c", 2.0), ("d", 1.0))))
    assert [x["name"] for x in one(spark, ridge.top_drivers(d, 3))] == ["b", "a", "c"]


@pytest.mark.parametrize("n,word", [(8, "An"), (11, "An"), (18, "An"), (80, "An"), (89, "An"), (81, "An"), (90, "A"), (12, "A"), (95, "A")])
def test_articles_of_numbers(spark, n, word):
    assert one(spark, C.article(F.lit(n))) == word


def test_quantities(spark):
    assert one(spark, C.quantity(F.lit(12.3455), F.lit("thousands of persons"))) == "12,346"
    assert one(spark, C.quantity(F.lit(4.25), F.lit("percent"))) == "4.2 percent"
    assert one(spark, C.quantity(F.lit(1234.56), F.lit(""))) == "1,234.6"
    assert one(spark, C.jobs_phrase(F.lit(None).cast("double"))) == "an unknown number of jobs"
    assert one(spark, C.jobs_phrase(F.lit(-7.0), signed=False)) == "7,000 jobs"
    assert one(spark, C.even(F.lit(3232.4999999999995))) == one(spark, C.even(F.lit(3232.5))) == 3232.0


def test_two_values_of_one_date_are_refused(spark):
    row = lambda v, d: ("UNRATE", date(2024, 1, 1), d, date(9999, 12, 31), v)
    observed = spark.createDataFrame([row(4.0, date(2024, 2, 1)), row(4.1, date(2024, 2, 2))], "series_id string, obs_date date, realtime_start date, realtime_end date, value double")
    origins = spark.createDataFrame([(date(2024, 3, 1),)], "origin date")
    with pytest.raises(Exception, match="several values"):
        features.panel(observed, origins, registry(spark)).collect()
    assert features.default_as_of(observed).first()["as_of"] == date(2024, 2, 2)


def explained(spark, **change):
    row = dict(origin=date(2024, 5, 1), target_month=date(2024, 4, 1), model="ridge", point=50.0, lower=10.0, upper=95.0, interval_level=0.8, n_train=40, baseline_point=20.0,
               drivers=[("a", "first thing", "thousands of persons", 200.0, 1.0, 30.0), ("b", "second thing", "percent", 4.0, 1.0, -9.0), ("c", "third thing", "", 1.0, 1.0, 0.4)]) | change
    kinds = "origin date, target_month date, model string, point double, lower double, upper double, interval_level double, n_train int, baseline_point double, drivers array<struct<name: string, label: string, unit: string, value: double, coefficient: double, contribution: double>>"
    return spark.createDataFrame([tuple(row[k.split(" ")[0]] for k in kinds.split(", ") if k.split(" ")[0] in row)], kinds)


REGIME_2020 = ("2020-03-01", "2022-06-01")


def test_explanations(spark):
    recent = spark.createDataFrame([(date(2024, 5, 1), 5, 60.0)], "origin date, recent_n int, recent_average double")
    stale = spark.createDataFrame([(date(2024, 5, 1), ["Openings (2 months behind)"])], "origin date, stale array<string>")
    accuracy = spark.createDataFrame([("ridge", 91.0, 39, "mean_6m", 100.0)], "model string, measured_mae double, measured_n long, rival string, rival_mae double")
    e = explain.explained(explained(spark), REGIME_2020, recent, stale, accuracy).first().asDict(recursive=True)
    assert e["headline"] == "The next report should show a gain of 50,000 jobs for April 2024."
    assert e["interval"] == "An 80% range goes from a gain of 10,000 jobs to a gain of 95,000 jobs."
    assert e["anchor"].startswith("The average of the 40 months of training is a gain of 29,000 jobs")
    assert [(d["name"], d["direction"]) for d in e["statements"]] == [("a", "raises"), ("b", "lowers")]
    assert e["statements"][0]["sentence"] == "First thing is 200,000, which adds 30,000 jobs."
    assert e["statements"][1]["sentence"] == "Second thing is 4.0 percent, which takes away 9,000 jobs."
    assert e["comparison"] == "That is 30,000 jobs above last month's print of a gain of 20,000 jobs."
    assert e["context"] == "The last 5 prints averaged a gain of 60,000 jobs; this forecast is below that. Made from data known on 2024-05-01."
    assert len(e["caveats"]) == 5 and "not clearly better" in e["caveats"][0] and "Openings (2 months behind)" in e["caveats"][4] and "March 2020 to June 2022" in e["caveats"][3]
    assert all(s in explain.text(e) for s in (e["headline"], e["comparison"], "Caveats:", "  First thing"))
    better = explain.explained(explained(spark), REGIME_2020, accuracy=accuracy.withColumn("measured_mae", F.lit(89.0))).first()
    assert "clearly better than" in better["caveats"][0] and "not clearly" not in better["caveats"][0]
    alone = explain.explained(explained(spark), REGIME_2020, accuracy=accuracy.withColumn("rival_mae", F.lit(None).cast("double"))).first()
    assert alone["caveats"][0].endswith("missed by 91,000 jobs on average.")


def test_explanations_without_what_is_not_known(spark):
    e = explain.explained(explained(spark, drivers=None, lower=None, upper=None, baseline_point=None, model="mean_3m"), REGIME_2020).first()
    assert e["interval"] is None and e["statements"] == [] and "no range" in e["caveats"][1] and len(e["caveats"]) == 3
    assert e["anchor"].startswith("The rule mean 3m") and e["context"] == "Made from data known on 2024-05-01." and "no month before" in e["comparison"] and "not been measured" in e["caveats"][0]
    assert "repeats last month's print" in explain.explained(explained(spark, baseline_point=50.5), REGIME_2020).first()["comparison"]
    with pytest.raises(Exception, match="add up"):
        explain.explained(explained(spark, point=2e6), REGIME_2020).collect()
    with pytest.raises(ValueError):
        explain.explained(explained(spark), REGIME_2020, count=0)


def test_json_payload(spark):
    body = json.loads(explain.payload(explain.explained(explained(spark, lower=None), REGIME_2020), "T").first()["json"])
    assert list(body) == ["series_id", "month", "as_of", "model", "point_thousands", "lower_thousands", "upper_thousands", "interval_level", "n_train", "baseline_point_thousands", "headline", "interval_statement", "context", "anchor", "drivers", "caveats"]
    assert (body["series_id"], body["month"], body["lower_thousands"], body["interval_statement"], body["drivers"][0]["contribution"]) == ("T", "2024-04-01", None, None, 30.0)
