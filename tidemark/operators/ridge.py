"""Ridge forecasts of all origins.

With inputs standardised over a training prefix, the weights for a penalty a are V diag(1 / (d + a)) V'c, where V and d
decompose Z'Z and c is Z'(y - mean). Z'Z and c follow from the prefix's sums of products, and the sums of all prefixes
from one cumulative sum, so that each fold needs one decomposition for all penalties, and one table of errors (a row for
each validated month, a column for each penalty) gives both the penalty and the interval. An origin has a few hundred
rows at most and is one group.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.design import Term

#: Penalties to choose from, number of folds, rows before the first fold, least rows, least errors of an interval.
PENALTIES = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
FOLDS, FIRST_FOLD, LEAST_ROWS, LEAST_ERRORS = 5, 24, 36, 10
SMALLEST_SPREAD = 1e-12
DRIVER = "struct<name: string, label: string, unit: string, value: double, coefficient: double, contribution: double>"
SCHEMA = f"origin date, target_month date, model string, point double, lower double, upper double, interval_level double, n_train int, baseline_point double, penalty double, intercept double, drivers array<{DRIVER}>, skip_reason string"


def fold_table(n: int) -> np.ndarray:
    """A row (end of training, end of validation) for each fold: training grows, and a remainder is a fold of its own."""
    width = max(1, (n - FIRST_FOLD) // FOLDS)
    ends = np.arange(FIRST_FOLD, n, width) if n > FIRST_FOLD + 1 else np.empty(0, int)
    return np.c_[ends, np.minimum(ends + width, n)].astype(int)


def prefix_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For k rows, at place k - 1: the sums of products of (1, inputs, target)."""
    rows = np.c_[np.ones(len(y)), x, y]
    return np.cumsum(rows[:, :, None] * rows[:, None, :], axis=0)


def weights_of(sums: np.ndarray, penalties: Iterable[float]) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Means, spreads, intercept and a column of weights for each penalty, from the sums of a prefix. No penalty on the intercept."""
    n, of_x, of_y = sums[0, 0], sums[0, 1:-1], sums[0, -1]
    mean = of_x / n
    moments = sums[1:-1, 1:-1] - n * np.outer(mean, mean)
    spread = np.maximum(np.sqrt(np.maximum(np.diag(moments), 0) / n), SMALLEST_SPREAD)
    d, v = np.linalg.eigh(moments / np.outer(spread, spread))
    turned = v.T @ ((sums[1:-1, -1] - mean * of_y) / spread)
    shrunk = turned[:, None] / (np.maximum(d, 0)[:, None] + np.array(list(penalties), float))
    return mean, spread, of_y / n, v @ shrunk


def forecast(x: np.ndarray, y: np.ndarray, new: np.ndarray, penalties: Sequence[float], level: float) -> dict:
    """Point, interval, penalty, intercept, weights and contributions; rows in order of time."""
    if any(a < 0 for a in penalties) or not len(penalties):
        raise ValueError("penalties are not negative, and there is one at least")
    middle = x.mean(0)  # sums of shifted inputs lose no digits to their level
    sums = prefix_sums(x - middle, y)
    errors = [np.empty((0, len(penalties)))]
    for end, until in fold_table(len(y)):
        mean, spread, intercept, w = weights_of(sums[end - 1], penalties)
        errors.append(y[end:until, None] - intercept - (x[end:until] - middle - mean) / spread @ w)
    errors = np.concatenate(errors)
    best = int((errors * errors).mean(0).argmin()) if len(errors) and len(penalties) > 1 else len(penalties) // 2
    mean, spread, intercept, w = weights_of(sums[-1], penalties[best : best + 1])
    parts = (new - middle - mean) / spread * w[:, 0]
    point = float(intercept + parts.sum())
    out = {"point": point, "penalty": float(penalties[best]), "intercept": float(intercept), "weights": w[:, 0], "contributions": parts, "lower": None, "upper": None}
    if len(errors) >= LEAST_ERRORS:
        out["lower"], out["upper"] = (point + float(q) for q in np.quantile(errors[:, best], [(1 - level) / 2, (1 + level) / 2]))
    return out


def forecasts(design: DataFrame, terms: Sequence[Term], units: dict[str, str] | None = None, penalties: Sequence[float] = PENALTIES, level: float = 0.8) -> DataFrame:
    """A row (see SCHEMA) for each origin of the design: a forecast, or why there is none. units: labels by series."""
    names = [t.name for t in terms]

    def of_origin(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month")
        train, following = rows[(rows["status"] == "ok") & ~rows["is_next"]], rows[rows["is_next"]].iloc[0]
        out = dict.fromkeys(n.split(" ")[0] for n in SCHEMA.split(", ") if ":" not in n) | {"drivers": None}
        out |= {"origin": following["origin"], "target_month": following["month"], "model": "ridge", "interval_level": level, "n_train": len(train), "baseline_point": following["last_change"], "skip_reason": following["skip_reason"]}
        if following["skip_reason"] is None:
            new = following[names].to_numpy(float)
            made = forecast(train[names].to_numpy(float), train["y"].to_numpy(float), new, penalties, level)
            drivers = zip(terms, new, made.pop("weights"), made.pop("contributions"), strict=True)
            out |= made | {"drivers": [{"name": t.name, "label": t.label or t.name, "unit": (units or {}).get(t.series_id, ""), "value": float(v), "coefficient": float(w), "contribution": float(c)} for t, v, w, c in drivers]}
        return pd.DataFrame([out])

    return design.select("origin", "month", "is_next", "y", *names, "status", "last_change", "skip_reason").groupBy("origin").applyInPandas(of_origin, SCHEMA)


def top_drivers(drivers: Column, count: int = 3) -> Column:
    """The largest contributions by size, equal ones in the order of the terms."""
    ranked = F.array_sort(F.transform(drivers, lambda d, i: F.struct((-F.abs(d["contribution"])).alias("size"), i.alias("place"), d.alias("driver"))))
    return F.transform(F.slice(ranked, 1, count), lambda s: s["driver"])
