"""DuckDB SQL by query name."""

from __future__ import annotations

from tidemark.operators.ridge import FIRST_FOLD, FOLDS, LEAST_ROWS, PENALTIES
from tidemark.plans.queries import GAPS, NAIVE, REGIME, TARGET, TERMS
from tidemark.sources.derived import SERIES, WEEKLY

_SERIES = ", ".join(f"('{s[0]}', '{s[2]}', '{s[4]}', {s[5]}::DOUBLE, {s[6]})" for s in SERIES)
_OUT = f"BETWEEN DATE '{REGIME[0]}' AND DATE '{REGIME[1]}'"

OBS = f"""
registry(series_id, frequency, units, scale, lag) AS (VALUES {_SERIES}),
m0 AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS obs_date, o_orderkey AS k, o_totalprice::DECIMAL(18,2) AS x FROM orders),
w0 AS (SELECT '{WEEKLY}' AS series_id, (l_shipdate::DATE + (6 - dayofweek(l_shipdate::DATE))::INT)::DATE AS obs_date, l_orderkey AS k, l_quantity::DECIMAL(18,2) AS x FROM lineitem),
m1 AS (SELECT series_id, obs_date, r, sum(CASE WHEN k % 3 <= r THEN x END)::DOUBLE AS value FROM m0, (VALUES (0), (1), (2)) t(r) GROUP BY ALL),
w1 AS (SELECT series_id, obs_date, r, sum(CASE WHEN k % 3 <= r THEN x END)::DOUBLE AS value FROM w0, (VALUES (0), (1), (2)) t(r) GROUP BY ALL),
obs AS (
  SELECT series_id, obs_date, (obs_date + to_months(1 + r))::DATE + 4 AS realtime_start,
    CASE WHEN r < 2 THEN (obs_date + to_months(2 + r))::DATE + 3 ELSE DATE '9999-12-31' END AS realtime_end, value FROM m1
  UNION ALL SELECT series_id, obs_date, obs_date + 5 + 7 * r, CASE WHEN r < 2 THEN obs_date + 11 + 7 * r ELSE DATE '9999-12-31' END, value FROM w1),
releases AS (SELECT DISTINCT origin FROM (SELECT min(realtime_start) AS origin FROM obs WHERE series_id = '{TARGET}' GROUP BY obs_date))
"""

_MONTHLY = """SELECT origin, series_id, date_trunc('month', obs_date)::DATE AS month,
    CASE WHEN frequency = 'M' THEN max(value) WHEN count(value) >= 2 THEN avg(value) END AS value, count(value)::INT AS weeks_used
  FROM {0} GROUP BY origin, series_id, frequency, date_trunc('month', obs_date)::DATE"""

PANEL = f"""
known AS (SELECT r.origin, o.series_id, o.obs_date, o.value * g.scale AS value, g.frequency FROM releases r, obs o JOIN registry g USING (series_id)
  WHERE o.realtime_start <= r.origin - 1 AND o.realtime_end >= r.origin - 1),
panel AS ({_MONTHLY.format("known")})
"""

SHIFTED = f"""
targets AS (SELECT DISTINCT date_trunc('month', obs_date)::DATE AS origin FROM obs WHERE series_id = '{TARGET}'),
known AS (SELECT t.origin, o.series_id, o.obs_date, o.value * g.scale AS value, g.frequency FROM targets t, obs o JOIN registry g USING (series_id)
  WHERE o.realtime_end = DATE '9999-12-31' AND o.obs_date <= CASE WHEN o.series_id = '{TARGET}' THEN t.origin - 1 ELSE last_day((t.origin - to_months(g.lag))::DATE) END),
panel AS ({_MONTHLY.format("known")})
"""

CHANGES = """
lagged AS (SELECT *, lag(value) OVER w AS previous, lag(month) OVER w AS before FROM panel WINDOW w AS (PARTITION BY origin, series_id ORDER BY month)),
changes AS (SELECT origin, series_id, month, value - previous AS change, value AS level, previous AS previous_level FROM lagged
  WHERE before = (month - to_months(1))::DATE AND value IS NOT NULL AND previous IS NOT NULL)
"""

FORECASTS = f"""
target_changes AS (SELECT origin, month, change FROM changes WHERE series_id = '{TARGET}'),
ends AS (SELECT origin, (max(month) + to_months(1))::DATE AS month FROM target_changes GROUP BY origin),
ordered AS (SELECT origin, month, change, false AS nxt FROM target_changes WHERE NOT month {_OUT} UNION ALL SELECT origin, month, NULL, true FROM ends),
ruled AS (SELECT *, row_number() OVER w - 1 AS n, lag(change) OVER w AS last_one, first_value(change) OVER w AS first_one,
    avg(change) OVER (PARTITION BY origin ORDER BY nxt, month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3,
    avg(change) OVER (PARTITION BY origin ORDER BY nxt, month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m6
  FROM ordered WINDOW w AS (PARTITION BY origin ORDER BY nxt, month)),
long AS (SELECT origin, month, change, nxt, n, 'random_walk' AS model, last_one AS p FROM ruled WHERE n >= 2
  UNION ALL SELECT origin, month, change, nxt, n, 'mean_3m', m3 FROM ruled WHERE n >= 3
  UNION ALL SELECT origin, month, change, nxt, n, 'mean_6m', m6 FROM ruled WHERE n >= 6
  UNION ALL SELECT origin, month, change, nxt, n, 'drift', last_one + (last_one - first_one) / (n - 1) FROM ruled WHERE n >= 3),
forecasts AS (SELECT origin, model, max(month) FILTER (nxt) AS target_month, max(p) FILTER (nxt) AS point,
    CASE WHEN count(change - p) >= 2 THEN 1.2816 * sqrt(avg((change - p) * (change - p))) END AS half, (max(n) FILTER (nxt))::INT AS n_train
  FROM long GROUP BY origin, model HAVING max(p) FILTER (nxt) IS NOT NULL)
"""

_SCALE = next(s[5] for s in SERIES if s[0] == TARGET)

SCORED = f"""
printed AS (SELECT r.origin, date_trunc('month', o.obs_date)::DATE AS month, o.value * {_SCALE}::DOUBLE AS value FROM releases r, obs o
  WHERE o.series_id = '{TARGET}' AND o.realtime_start <= r.origin AND o.realtime_end >= r.origin),
actuals AS (SELECT a.origin, a.month AS target_month, a.value - b.value AS actual FROM printed a JOIN printed b ON a.origin = b.origin AND b.month = (a.month - to_months(1))::DATE
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
attempts AS (SELECT f.*, point - half AS lower, point + half AS upper, actual FROM forecasts f JOIN actuals USING (origin, target_month) WHERE NOT target_month {_OUT}),
"""

#: What is forecast is the origin's own month, and its step is measured from the newest month that has a change.
SCORED_SHIFTED = f"""
newest AS (SELECT date_trunc('month', obs_date)::DATE AS month, arg_max(value, realtime_start) * {_SCALE}::DOUBLE AS value FROM obs WHERE series_id = '{TARGET}' AND value IS NOT NULL GROUP BY 1),
before AS (SELECT origin, max(month) AS month FROM changes WHERE series_id = '{TARGET}' GROUP BY origin),
actuals AS (SELECT p.origin, a.month AS target_month, a.value - b.value AS actual FROM before p JOIN newest a ON a.month = p.origin JOIN newest b ON b.month = p.month),
attempts AS (SELECT f.*, point - half AS lower, point + half AS upper, actual FROM forecasts f JOIN actuals USING (origin, target_month) WHERE NOT target_month {_OUT}),
"""

_NEXT = "(max(month) + to_months(1))::DATE"
FORECASTS_SHIFTED = FORECASTS.replace(_NEXT, "origin")

#: The same series without some months of the target.
_GONE = ", ".join(f"DATE '{m}'" for m in GAPS)
OBS_GAPS = OBS.replace("obs AS (", "whole AS (").replace("releases AS", f"obs AS (SELECT * FROM whole WHERE NOT (series_id = '{TARGET}' AND obs_date IN ({_GONE}))),\nreleases AS")

COMMON = f"scored AS (SELECT * FROM attempts WHERE origin IN (SELECT origin FROM attempts GROUP BY origin HAVING count(DISTINCT model) = {len(NAIVE)}))"

CARD = """SELECT model, count(*) AS n, avg(abs(point - actual)) AS mae, sqrt(avg((point - actual) * (point - actual))) AS rmse, avg(point - actual) AS bias,
  avg(((point >= 0) = (actual >= 0))::INT) FILTER (actual <> 0) AS directional_accuracy, avg((actual BETWEEN lower AND upper)::INT) FILTER (half IS NOT NULL) AS interval_coverage,
  avg(upper - lower) FILTER (half IS NOT NULL) AS mean_interval_width, count(*) FILTER (half IS NOT NULL) AS n_with_interval FROM scored GROUP BY model"""

_CARD_OUT = "SELECT model, n, " + ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("mae", "rmse", "bias", "directional_accuracy", "interval_coverage", "mean_interval_width")) + ", n_with_interval, round(interval_coverage - 0.8 + 1e-7, 4) AS coverage_gap FROM card"

_BACKTEST = f"WITH {OBS}, {PANEL}, {CHANGES}, {FORECASTS}, {SCORED} {COMMON}"

#: Two-sided p of Student's t as the same finite series, summed over a list.
_P = """CASE WHEN df % 2 = 0 THEN 1 - sin(th) * list_sum(list_transform(range(0, df // 2), lambda j: list_product([1.0::DOUBLE] || list_transform(range(1, j + 1), lambda i: (2 * i - 1.0) / (2 * i))) * cos(th) ** (2 * j)))
  ELSE 1 - 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: list_product([1.0::DOUBLE] || list_transform(range(1, j + 1), lambda i: (2.0 * i) / (2 * i + 1))) * cos(th) ** (2 * j + 1)))) END"""


def _terms() -> tuple[str, str]:
    """Joins and columns of the design terms."""
    joins, columns = [], []
    for i, t in enumerate(TERMS):
        if t.transform == "trailing_mean":
            columns.append(f"(SELECT CASE WHEN count(*) >= {t.least} THEN avg(c.change) END FROM target_changes c WHERE c.origin = w.origin AND c.month BETWEEN (w.month - to_months({t.lag + t.window - 1}))::DATE AND (w.month - to_months({t.lag}))::DATE AND NOT c.month {_OUT}) AS {t.name}")
        else:
            table, column = ("panel", "value") if t.transform == "level" else ("changes", "change")
            joins.append(f"LEFT JOIN {table} t{i} ON t{i}.origin = w.origin AND t{i}.series_id = '{t.series_id}' AND t{i}.month = (w.month - to_months({t.lag}))::DATE")
            columns.append(f"t{i}.{column} AS {t.name}")
    return " ".join(joins), ", ".join(columns)


_JOINS, _COLUMNS = _terms()
_READS = sorted({0} | {t.lag for t in TERMS if t.transform != "trailing_mean"} | {t.lag + 1 for t in TERMS if t.transform == "change"})
_DIRTY = " OR ".join(f"(w.month - to_months({k}))::DATE {_OUT}" for k in _READS)
_NAMES = [t.name for t in TERMS]
_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in _NAMES) + ")"

_MONTHS = f"WITH {OBS}, {PANEL}, {CHANGES}"

#: The design rows, with the newest change outside the regime and the reason to skip an origin.
DESIGN = f"""
target_changes AS (SELECT origin, month, change FROM changes WHERE series_id = '{TARGET}'),
wide AS (SELECT origin, month, change AS y, false AS is_next FROM target_changes UNION ALL SELECT origin, (max(month) + to_months(1))::DATE, NULL, true FROM target_changes GROUP BY origin),
filled AS (SELECT w.origin, w.month, w.is_next, w.y, {_COLUMNS}, ({_DIRTY}) AS dirty FROM wide w {_JOINS}),
stated AS (SELECT *, {_MISSING} AS missing FROM filled),
marked AS (SELECT *, CASE WHEN NOT is_next AND dirty THEN 'excluded' WHEN missing <> '' THEN 'incomplete' ELSE 'ok' END AS status FROM stated),
train AS (SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY month) AS i, y, [{", ".join(_NAMES)}] AS x FROM marked WHERE status = 'ok' AND NOT is_next),
nexts AS (SELECT m.origin, m.month AS target_month, [{", ".join(_NAMES)}] AS x, replace(missing, ',', ', ') AS missing, coalesce(n, 0) AS n, last_change FROM marked m
  LEFT JOIN (SELECT origin, count(*) AS n FROM train GROUP BY origin) USING (origin)
  LEFT JOIN (SELECT origin, arg_max(change, month) AS last_change FROM target_changes WHERE NOT month {_OUT} GROUP BY origin) USING (origin) WHERE is_next),
reasons AS (SELECT *, CASE WHEN n < {LEAST_ROWS} THEN '{LEAST_ROWS} complete rows are needed, there are ' || n WHEN missing <> '' THEN 'no value for ' || missing END AS skip_reason FROM nexts)
"""

_K = len(TERMS)

#: Ridge by elimination: for each origin, training prefix and penalty one system of equations, solved step by step.
RIDGE = f"""
sized AS (SELECT origin, n, greatest(1, (n - {FIRST_FOLD}) // {FOLDS}) AS width FROM reasons WHERE skip_reason IS NULL),
folds AS (SELECT origin, n, {FIRST_FOLD} + f * width AS upto, least({FIRST_FOLD} + (f + 1) * width, n) AS until FROM sized, range(0, 200) t(f) WHERE {FIRST_FOLD} + f * width < n
  UNION ALL SELECT origin, n, n, n FROM sized),
cells AS (SELECT origin, i, y, unnest(range(1, {_K} + 1)) AS j, unnest(x) AS v FROM train),
scales AS (SELECT f.origin, f.upto, j, avg(v) AS mean, greatest(stddev_pop(v), 1e-12) AS sd FROM folds f JOIN cells c ON c.origin = f.origin AND c.i <= f.upto GROUP BY ALL),
means AS (SELECT f.origin, f.upto, avg(y) AS ybar FROM folds f JOIN train t ON t.origin = f.origin AND t.i <= f.upto GROUP BY ALL),
zs AS (SELECT f.origin, f.upto, c.i, c.j, (c.v - s.mean) / s.sd AS z, c.y FROM folds f JOIN cells c ON c.origin = f.origin AND c.i <= f.upto JOIN scales s ON s.origin = f.origin AND s.upto = f.upto AND s.j = c.j),
grams AS (SELECT a.origin, a.upto, a.j, b.j AS k, sum(a.z * b.z) AS g FROM zs a JOIN zs b ON b.origin = a.origin AND b.upto = a.upto AND b.i = a.i GROUP BY ALL),
rights AS (SELECT z.origin, z.upto, z.j, sum(z.z * (z.y - m.ybar)) AS c FROM zs z JOIN means m ON m.origin = z.origin AND m.upto = z.upto GROUP BY ALL),
penalties AS (SELECT unnest({list(PENALTIES)}) AS a),
lines AS (SELECT g.origin, g.upto, a, g.j, list(g.g + CASE WHEN g.j = g.k THEN a ELSE 0 END ORDER BY g.k) || [any_value(r.c)] AS line
  FROM grams g JOIN rights r ON r.origin = g.origin AND r.upto = g.upto AND r.j = g.j, penalties GROUP BY g.origin, g.upto, a, g.j),
systems AS (SELECT origin, upto, a, list(line ORDER BY j) AS m FROM lines GROUP BY ALL),
steps AS (SELECT origin, upto, a, 0 AS k, m FROM systems
  UNION ALL SELECT origin, upto, a, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM steps WHERE k < {_K}),
weights AS (SELECT origin, upto, a, unnest(range(1, {_K} + 1)) AS j, unnest(list_transform(m, lambda r: r[{_K + 1}])) AS w FROM steps WHERE k = {_K}),
wrong AS (SELECT f.origin, w.a, c.i, any_value(c.y) - any_value(m.ybar) - sum((c.v - s.mean) / s.sd * w.w) AS e FROM folds f
  JOIN cells c ON c.origin = f.origin AND c.i > f.upto AND c.i <= f.until JOIN scales s ON s.origin = f.origin AND s.upto = f.upto AND s.j = c.j
  JOIN weights w ON w.origin = f.origin AND w.upto = f.upto AND w.j = c.j JOIN means m ON m.origin = f.origin AND m.upto = f.upto GROUP BY f.origin, w.a, c.i),
picked AS (SELECT origin, arg_min(a, mse) AS a FROM (SELECT origin, a, avg(e * e) AS mse FROM wrong GROUP BY ALL) GROUP BY origin),
spans AS (SELECT origin, a, quantile_cont(e, 0.1) AS low, quantile_cont(e, 0.9) AS high FROM wrong JOIN picked USING (origin, a) GROUP BY ALL),
drivers AS (SELECT r.origin, w.j, r.x[w.j] AS value, w.w AS coefficient, (r.x[w.j] - s.mean) / s.sd * w.w AS contribution FROM reasons r JOIN picked p ON p.origin = r.origin
  JOIN weights w ON w.origin = r.origin AND w.a = p.a AND w.upto = r.n JOIN scales s ON s.origin = r.origin AND s.upto = r.n AND s.j = w.j),
ridge AS (SELECT r.origin, r.target_month, 'ridge' AS model, m.ybar + c AS point, m.ybar + c + low AS lower, m.ybar + c + high AS upper, 0.8 AS interval_level, r.n::INT AS n_train, r.last_change AS baseline_point,
    p.a AS penalty, m.ybar AS intercept, r.skip_reason FROM reasons r LEFT JOIN picked p USING (origin) LEFT JOIN means m ON m.origin = r.origin AND m.upto = r.n
  LEFT JOIN (SELECT origin, sum(contribution) AS c FROM drivers GROUP BY origin) USING (origin) LEFT JOIN spans s ON s.origin = r.origin)
"""

_RIDGE = f"WITH RECURSIVE {OBS}, {PANEL}, {CHANGES}, {DESIGN}, {RIDGE}"
#: Naive and ridge forecasts together, with actuals; `attempts` holds what was forecast.
_NAIVE = FORECASTS.replace(f"target_changes AS (SELECT origin, month, change FROM changes WHERE series_id = '{TARGET}'),", "")
_ALL = f"""{_RIDGE}, {_NAIVE}, alls AS (SELECT origin, model, target_month, point, point - half AS lower, point + half AS upper, half FROM forecasts
  UNION ALL SELECT origin, model, target_month, point, lower, upper, upper - lower FROM ridge WHERE point IS NOT NULL), {SCORED.replace("forecasts f", "alls f").replace("f.*, point - half AS lower, point + half AS upper, actual", "f.*, actual")}"""
_SCORED_ALL = f"{_ALL} scored AS (SELECT * FROM attempts WHERE origin IN (SELECT origin FROM attempts GROUP BY origin HAVING count(DISTINCT model) = {len(NAIVE) + 1})), card AS ({CARD})"

#: Forecasts and skipped models of the origins that any model has forecast, over the series with gaps.
GAP_OUTCOMES = f"""WITH RECURSIVE {OBS_GAPS}, {SHIFTED}, {CHANGES}, {DESIGN.replace(_NEXT, "origin")}, {RIDGE}, {_NAIVE.replace(_NEXT, "origin")},
needs(model, least) AS (VALUES ('random_walk', 2), ('mean_3m', 3), ('mean_6m', 6), ('drift', 3)),
usable AS (SELECT c.origin, count(*) FILTER (NOT month {_OUT}) AS n FROM target_changes c GROUP BY c.origin),
alls AS (SELECT u.origin, u.origin AS target_month, model, point, point - half AS lower, point + half AS upper, f.n_train, CASE WHEN point IS NULL THEN least || ' changes are needed, there are ' || n END AS skip_reason
    FROM usable u CROSS JOIN needs LEFT JOIN forecasts f USING (origin, model)
  UNION ALL SELECT origin, target_month, model, point, lower, upper, n_train, skip_reason FROM ridge),
{SCORED_SHIFTED.partition("attempts AS")[0]}
tried AS (SELECT a.*, actual FROM alls a JOIN actuals USING (origin, target_month) WHERE NOT target_month {_OUT})
SELECT origin, target_month, model, {", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("point", "lower", "upper"))}, n_train, round(actual + 1e-7, 4) AS actual, skip_reason
FROM tried WHERE origin IN (SELECT origin FROM tried WHERE point IS NOT NULL)"""


def _count(x: str) -> str:
    return f"format('{{:,}}', abs(round_even(round({x}, 8), 0))::BIGINT * 1000) || ' jobs'"


def _jobs(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'an unknown number of jobs' WHEN round_even(round({x}, 8), 0) = 0 THEN 'no net change' WHEN {x} > 0 THEN 'a gain of ' || {_count(x)} ELSE 'a loss of ' || {_count(x)} END)"


_LABELS = ", ".join(f"({i + 1}, '{t.name}', '{t.label or t.name}', '{t.series_id}')" for i, t in enumerate(TERMS))
_UNIT = "CASE WHEN lower(units) IN ('persons', 'number', 'thousands of persons', 'level in thousands') THEN 'thousands of persons' ELSE lower(units) END"
_NAMED = ", ".join(f"('{s[0]}', '{s[3]}')" for s in SERIES)

EXPLAINED = f"""{_SCORED_ALL}, labels(j, name, label, series_id) AS (VALUES {_LABELS}), names(series_id, label) AS (VALUES {_NAMED}),
ranked AS (SELECT d.*, l.name, l.label, {_UNIT} AS unit, row_number() OVER (PARTITION BY origin ORDER BY abs(contribution) DESC, d.j) AS place FROM drivers d JOIN labels l USING (j) JOIN registry USING (series_id)),
said AS (SELECT origin, list({{'name': name, 'label': label, 'value': round_even(round(value, 8), 2), 'contribution': round_even(round(contribution, 8), 2), 'direction': CASE WHEN contribution > 0.5 THEN 'raises' WHEN contribution < -0.5 THEN 'lowers' ELSE 'neutral' END,
    'sentence': upper(label[1]) || label[2:] || ' is ' || CASE WHEN unit = 'thousands of persons' THEN format('{{:,}}', round_even(round(value * 1000, 8), 0)::BIGINT) ELSE format('{{:,.1f}}', round_even(round(value, 8), 1)) || ' ' || unit END || ', which '
      || CASE WHEN contribution > 0.5 THEN 'adds ' WHEN contribution < -0.5 THEN 'takes away ' ELSE 'changes little: ' END || {_count("contribution")} || '.'}} ORDER BY place) AS statements
  FROM ranked WHERE place <= 3 AND abs(contribution) >= 1 GROUP BY origin),
recent AS (SELECT origin, count(*) AS k, avg(change) AS average FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY month DESC) AS nth FROM target_changes) WHERE nth <= 6 AND NOT month {_OUT} GROUP BY origin),
behind AS (SELECT p.origin, p.series_id, max(p.month) AS newest, any_value(r.target_month) AS target_month FROM panel p JOIN reasons r USING (origin) WHERE p.series_id <> '{TARGET}' AND value IS NOT NULL GROUP BY p.origin, p.series_id),
stale AS (SELECT origin, string_agg(label || ' (' || k || CASE WHEN k = 1 THEN ' month behind)' ELSE ' months behind)' END, ', ' ORDER BY series_id) AS stale
  FROM (SELECT *, (year(target_month) - year(newest)) * 12 + month(target_month) - month(newest) AS k FROM behind) JOIN names USING (series_id) WHERE k > 0 GROUP BY origin),
own AS (SELECT mae, n FROM card WHERE model = 'ridge'), rival AS (SELECT mae AS rival_mae FROM card WHERE model = 'mean_6m'),
explained AS (SELECT r.*, coalesce(statements, []) AS statements, (r.origin - 1)::DATE AS as_of,
  'The next report should show ' || {_jobs("point")} || ' for ' || strftime(target_month, '%B %Y') || '.' AS headline,
  'An 80% range goes from ' || {_jobs("lower")} || ' to ' || {_jobs("upper")} || '.' AS interval,
  'The average of the ' || n_train || ' months of training is ' || {_jobs("intercept")} || '; drivers move it:' AS anchor,
  CASE WHEN abs(point - baseline_point) < 1 THEN 'That repeats last month''s print of ' || {_jobs("baseline_point")} || '.'
    ELSE 'That is ' || {_count("(point - baseline_point)")} || CASE WHEN point > baseline_point THEN ' above' ELSE ' below' END || ' last month''s print of ' || {_jobs("baseline_point")} || '.' END AS comparison,
  CASE WHEN k > 0 THEN 'The last ' || k || ' prints averaged ' || {_jobs("average")} || '; this forecast is ' || CASE WHEN point > average THEN 'above' ELSE 'below' END || ' that. ' ELSE '' END || 'Made from data known on ' || (r.origin - 1)::DATE || '.' AS context,
  list_filter(['Backtests over ' || own.n || ' vintage-correct origins missed by ' || {_count("own.mae")} || ' on average, against ' || replace({_count("rival_mae")}, ' jobs', '') || ' of mean 6m: '
      || CASE WHEN own.mae >= 0.9 * rival_mae THEN 'competitive with naive rules, not clearly better' ELSE 'clearly better than naive rules' END || '.',
    'Drivers are associations over ' || n_train || ' months, not causes.', 'The range is the spread of past errors and holds only while that spread lasts.',
    'Months from ' || strftime(DATE '{REGIME[0]}', '%B %Y') || ' to ' || strftime(DATE '{REGIME[1]}', '%B %Y') || ' are left out of training.',
    'Some inputs are older than the month forecast: ' || stale || '.'], lambda c: c IS NOT NULL) AS caveats
  FROM ridge r LEFT JOIN said USING (origin) LEFT JOIN recent USING (origin) LEFT JOIN stale USING (origin), own, rival WHERE point IS NOT NULL)
"""

ORACLES = {
    "observations_vintages": f"WITH {OBS} SELECT series_id, obs_date, realtime_start, realtime_end, round(value + 1e-7, 4) AS value FROM obs",
    "canonical_values": f"WITH {OBS} SELECT series_id, obs_date, round(value * scale + 1e-7, 4) AS value, CASE WHEN lower(units) IN ('persons', 'number', 'thousands of persons', 'level in thousands') THEN 'thousands of persons' ELSE lower(units) END AS unit FROM obs JOIN registry USING (series_id) WHERE realtime_end = DATE '9999-12-31'",
    "asof_panel": f"WITH {OBS}, {PANEL} SELECT origin, series_id, month, round(value + 1e-7, 4) AS value, weeks_used FROM panel",
    "lag_shifted_panel": f"WITH {OBS}, {SHIFTED} SELECT origin, series_id, month, round(value + 1e-7, 4) AS value, weeks_used FROM panel",
    "weekly_to_monthly": f"WITH {OBS} SELECT series_id, date_trunc('month', obs_date)::DATE AS month, round(CASE WHEN count(value) >= 4 THEN avg(value) END + 1e-7, 4) AS value, count(value)::INT AS weeks_used FROM obs WHERE series_id = '{WEEKLY}' AND realtime_end = DATE '9999-12-31' GROUP BY ALL",
    "monthly_changes": f"{_MONTHS} SELECT origin, series_id, month, round(change + 1e-7, 4) AS change, round(level + 1e-7, 4) AS level, round(previous_level + 1e-7, 4) AS previous_level FROM changes",
    "trailing_mean": f"{_MONTHS} SELECT origin, month, (SELECT round(CASE WHEN count(*) >= 6 THEN avg(c.change) END + 1e-7, 4) FROM changes c WHERE c.series_id = '{TARGET}' AND c.origin = a.origin AND c.month BETWEEN (a.month - to_months(11))::DATE AND a.month AND NOT c.month {_OUT}) AS trailing FROM changes a WHERE series_id = '{TARGET}'",
    "baseline_forecasts": f"{_MONTHS}, {FORECASTS} SELECT origin, target_month, model, round(point + 1e-7, 4) AS point, round(point - half + 1e-7, 4) AS lower, round(point + half + 1e-7, 4) AS upper, n_train FROM forecasts",
    "scorecard_baselines": f"{_BACKTEST}, card AS ({CARD}) {_CARD_OUT}",
    "scorecard_lag_shifted": f"WITH {OBS}, {SHIFTED}, {CHANGES}, {FORECASTS_SHIFTED}, {SCORED_SHIFTED} {COMMON}, card AS ({CARD}) {_CARD_OUT}",
    "gap_scorecard": f"WITH {OBS_GAPS}, {SHIFTED}, {CHANGES}, {FORECASTS_SHIFTED}, {SCORED_SHIFTED} {COMMON}, card AS ({CARD}) {_CARD_OUT}",
    "gap_outcomes": GAP_OUTCOMES,
    "relative_mae": f"{_BACKTEST}, card AS ({CARD}), ref AS (SELECT mae AS r FROM card WHERE model = 'random_walk') SELECT model, round(mae + 1e-7, 4) AS mae, round(100 * (r - mae) / r + 1e-7, 4) AS relative_mae, model = (SELECT arg_min(model, mae) FROM card) AS is_best FROM card, ref",
    "attempted_scored": f"{_BACKTEST} SELECT (SELECT count(DISTINCT origin) FROM attempts) AS n_attempted, (SELECT count(DISTINCT origin) FROM scored) AS n_scored, (SELECT count(DISTINCT origin) FROM attempts) - (SELECT count(DISTINCT origin) FROM scored) AS n_dropped",
    "significance": f"""{_BACKTEST}, pairs AS (SELECT b.model AS rival, a.point - a.actual AS e, b.point - b.actual AS f FROM scored a JOIN scored b USING (origin) WHERE a.model = 'mean_3m' AND b.model <> 'mean_3m'),
losses AS (SELECT rival, 'absolute' AS loss, abs(e) AS m, abs(f) AS b FROM pairs UNION ALL SELECT rival, 'squared', e * e, f * f FROM pairs),
agg AS (SELECT rival, loss, count(*) AS n, avg(m) AS model_loss, avg(b) AS rival_loss, avg(m - b) AS mean_difference, var_pop(m - b) AS v, (count(*) - 1)::INT AS df FROM losses GROUP BY ALL),
stat AS (SELECT *, CASE WHEN n >= 8 AND v > 0 THEN mean_difference / sqrt(v / n) * sqrt((n - 1) / n) END AS statistic FROM agg),
angle AS (SELECT *, atan(abs(statistic) / sqrt(df)) AS th FROM stat), pp AS (SELECT *, {_P} AS p FROM angle)
SELECT rival, loss, n, round(model_loss + 1e-7, 4) AS model_loss, round(rival_loss + 1e-7, 4) AS rival_loss, round(mean_difference + 1e-7, 4) AS mean_difference, round(statistic + 1e-7, 4) AS statistic, df AS degrees_of_freedom, round(p + 1e-7, 4) AS p_value,
  CASE WHEN p IS NULL THEN NULL WHEN p >= 0.05 THEN 'indistinguishable' WHEN mean_difference < 0 THEN 'model is better' ELSE 'rival is better' END AS verdict FROM pp""",
    "design_matrix": f"""{_MONTHS}, target_changes AS (SELECT origin, month, change FROM changes WHERE series_id = '{TARGET}'),
wide AS (SELECT origin, month, change AS y, false AS is_next FROM target_changes UNION ALL SELECT origin, (max(month) + to_months(1))::DATE, NULL, true FROM target_changes GROUP BY origin),
filled AS (SELECT w.origin, w.month, w.is_next, w.y, {_COLUMNS}, ({_DIRTY}) AS dirty FROM wide w {_JOINS}),
stated AS (SELECT *, {_MISSING} AS missing FROM filled),
marked AS (SELECT *, CASE WHEN NOT is_next AND dirty THEN 'excluded' WHEN missing <> '' THEN 'incomplete' ELSE 'ok' END AS status FROM stated)
SELECT origin, month, is_next, round(y + 1e-7, 4) AS y, {", ".join(f"round({n} + 1e-7, 4) AS {n}" for n in _NAMES)}, status, missing, count(*) FILTER (status = 'ok' AND NOT is_next) OVER (PARTITION BY origin) AS n_ok FROM marked""",
    "upsert_observations": f"WITH {OBS} SELECT series_id, obs_date, realtime_start, realtime_end, round(value + 1e-7, 4) AS value FROM obs",
    "stored_revisions": f"WITH {OBS} SELECT series_id, obs_date, realtime_start, realtime_end, round(value + 1e-7, 4) AS value FROM obs",
    "late_revisions": f"WITH {OBS} SELECT series_id, obs_date, realtime_start, realtime_end, round(value + 1e-7, 4) AS value FROM obs",
    "release_calendar": f"WITH {OBS} SELECT 194::INT AS release_id, origin AS release_date FROM releases WHERE origin <= DATE '2001-06-30'",
    "series_summary": f"WITH {OBS} SELECT series_id, count(*) AS n_rows, count(DISTINCT obs_date) AS n_dates, round(count(*) / count(DISTINCT obs_date) + 1e-7, 4) AS revision_density, max(obs_date) AS latest FROM obs GROUP BY series_id",
    "store_violations": f"""WITH {OBS}, snap AS (SELECT r.origin, o.obs_date, count(*) AS n FROM releases r, obs o WHERE series_id = '{TARGET}' AND realtime_start <= origin AND realtime_end >= origin GROUP BY ALL)
SELECT count(*) AS n_rows, count(*) FILTER (realtime_start < DATE '2002-01-01') AS historical, count(*) FILTER (realtime_end < realtime_start) AS inverted, (SELECT count(*) FROM snap WHERE n > 1) AS repeated FROM obs""",
    "history": f"""WITH {OBS}, cur AS (SELECT series_id, obs_date, value, value - lag(value) OVER (PARTITION BY series_id ORDER BY obs_date) AS mom, row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) AS nth
  FROM obs WHERE realtime_end = DATE '9999-12-31') SELECT series_id, obs_date, round(value + 1e-7, 4) AS value, round(mom + 1e-7, 4) AS mom FROM cur WHERE nth <= 12""",
    "ridge_forecasts": f"{_RIDGE} SELECT origin, target_month, model, " + ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("point", "lower", "upper", "interval_level")) + ", n_train, " + ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("baseline_point", "penalty", "intercept")) + ", skip_reason FROM ridge",
    "ridge_native": f"{_RIDGE} SELECT origin, target_month, model, " + ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("point", "lower", "upper", "interval_level")) + ", n_train, " + ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in ("baseline_point", "penalty", "intercept")) + ", skip_reason FROM ridge",
    "ridge_drivers": f"{_RIDGE}, labels(j, name, label, series_id) AS (VALUES {_LABELS}) SELECT origin, name, round(value + 1e-7, 4) AS value, round(coefficient + 1e-7, 4) AS coefficient, round(contribution + 1e-7, 4) AS contribution FROM drivers JOIN labels USING (j)",
    "ridge_scorecard": f"{_SCORED_ALL} {_CARD_OUT}",
    "model_skips": f"""{_ALL} needs(model, least) AS (VALUES ('random_walk', 2), ('mean_3m', 3), ('mean_6m', 6), ('drift', 3)),
usable AS (SELECT c.origin, count(*) FILTER (NOT month {_OUT}) AS n FROM target_changes c GROUP BY c.origin),
scored_origins AS (SELECT DISTINCT a.origin FROM attempts a),
missed AS (SELECT model, least || ' changes are needed, there are ' || n AS skip_reason FROM scored_origins JOIN usable USING (origin), needs WHERE n < least
  UNION ALL SELECT 'ridge', skip_reason FROM scored_origins JOIN reasons USING (origin) WHERE skip_reason IS NOT NULL)
SELECT model, skip_reason, count(*) AS n_origins FROM missed GROUP BY ALL""",
    "explanations": f"{EXPLAINED} SELECT origin, headline, interval, anchor, array_to_string(list_transform(statements, lambda d: d.sentence), ' ') AS drivers, comparison, context, array_to_string(caveats, ' ') AS caveats FROM explained",
    "forecast_json": f"""{EXPLAINED} SELECT origin, model, to_json({{'series_id': '{TARGET}', 'month': target_month::VARCHAR, 'as_of': as_of::VARCHAR, 'model': model, 'point_thousands': round_even(round(point, 8), 2), 'lower_thousands': round_even(round(lower, 8), 2), 'upper_thousands': round_even(round(upper, 8), 2),
  'interval_level': interval_level::DOUBLE, 'n_train': n_train, 'baseline_point_thousands': round_even(round(baseline_point, 8), 2), 'headline': headline, 'interval_statement': interval, 'context': context, 'anchor': anchor, 'drivers': statements, 'caveats': caveats}})::VARCHAR AS json FROM explained""",
    "recent_average": f"{_MONTHS} SELECT origin, count(*)::INT AS recent_n, round(avg(change) + 1e-7, 4) AS recent_average FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY month DESC) AS nth FROM changes WHERE series_id = '{TARGET}') WHERE nth <= 6 AND NOT month {_OUT} GROUP BY origin",
    "months_available": f"{_MONTHS} SELECT origin, series_id, count(*) AS months FROM panel WHERE series_id <> '{TARGET}' AND value IS NOT NULL GROUP BY ALL UNION ALL SELECT origin, series_id, count(*) FROM changes WHERE series_id = '{TARGET}' GROUP BY ALL",
    "default_as_of": f"WITH {OBS} SELECT series_id, max(realtime_start) AS as_of FROM obs GROUP BY series_id",
}
