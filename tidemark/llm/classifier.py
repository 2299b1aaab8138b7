"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1, at most `SAMPLE` of them; the unlabelled set is every document
that is not held out. A linear model over the measurements of a text minimises the non-negative unbiased risk
pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)])  with the logistic loss l, pi being the estimated class prior. Where
the second term is positive the risk is convex, and Newton steps go down on it; a step that would make the term
negative, more than there can be, is halved until it does not. Each step reads the stored measurements of all
unlabelled documents once, and adds up loss, gradient and curvature where the rows are: one matrix a task, added up
again in groups of tasks, then on the driver.

The prior comes from the same sums: the model that tells positives from unlabelled documents scores both, and the
smallest share of unlabelled to positive scores above a threshold bounds the share of positives. That model reads the
shares only. The prior is kept between 0.05 and 0.99, as the risk needs both classes.

The penalties were chosen by `cross_fitted` over the documents of sf0.1 that are not held out: five folds, and the fewest
wrong decisions on labels of the fold left out. Held-out rows took no part.

Measurements: shares of characters and repetitions, and signed counts of hashed words and word pairs (lexical
evidence), scaled to length 1. Documents are scored by their whole text and by nothing else.

Defined results: a null text counts as empty, and empty texts get the score of an all-zero measurement; equal texts
have equal scores; conflicting labels of one id count as negative, so it is no trusted positive; a repeated id of a
trusted positive counts once, with the measurements that come first in order; rows without an id are unlabelled and
not held out; without any trusted positive every score is 0.5; columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of
from tidemark.tables import durable, scratch

#: At most so many trusted positives.
SAMPLE = 20_000
SHARES, LEXICAL = 18, 128
FEATURES = SHARES + LEXICAL
#: Of shares and of hashed words, divided by the number of positives, so that they earn their weight from many documents.
PENALTIES = 300.0, 3000.0
#: The prior's bounds.
LEAST_PRIOR, MOST_PRIOR = 0.05, 0.99
STEPS = 10  # of Newton, at most
GROUPS = 8  # sums that reach the driver


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str | None):
    """Measurements of a whole text, each squashed to the order of 1."""
    import numpy as np

    out = np.zeros(FEATURES, np.float32)
    words = words_of(text)
    if not words:
        return out
    data = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = len(data), len(words)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    upper = sum(map(str.isupper, text)) if count[128:].any() else count[65:91].sum()
    share = lambda chars: sum(int(count[ord(c)]) for c in chars)
    distinct = len(set(words))
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, w)
    per_word = (share("*#$%&"), share("|"), share("<>{}[]\\^~_=+"), share("!"), share("?.,;:"), share("0123456789"), adjacent)
    out[:7] = np.log1p([8 * x / (w + 8) for x in per_word])  # a few words are weak evidence
    out[7] = np.log1p(8 * upper / (letters + 40))
    out[8] = np.log1p(8 * share("\n") / w)
    out[9] = distinct / w
    out[10] = np.log1p(w - distinct) / np.log1p(w)
    out[11] = min(lengths.mean(), 40) / 8
    out[12] = min(lengths.std(), 40) / 8
    out[13] = np.log1p(w) / 8
    out[14] = letters / n
    out[15] = len(set(zip(words, words[1:]))) / w
    out[16] = count[128:].sum() / n
    out[17] = w < 10
    h = np.fromiter(map(zlib.crc32, words), np.uint64, w)
    h = np.r_[h, h[:-1] * np.uint64(31) + h[1:] + np.uint64(1 << 33)] * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((h >> np.uint64(57)).astype(np.int64), np.where(h & np.uint64(1 << 40), 1.0, -1.0), LEXICAL)
    out[SHARES:] = counts / max(1.0, np.sqrt(counts @ counts))
    return out


@dataclass
class Model:
    weights: list[float]
    bias: float
    mean: list[float]
    scale: list[float]
    prior: float

    def scores(self, x):
        import numpy as np

        if not self.weights:
            return np.full(len(x), 0.5)
        z = (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softplus(z):
    import numpy as np

    return np.logaddexp(0, z)


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sums_at(w, x):
    """Over rows x with a last column of ones: their number, and the sums of l(-z), of its gradient and of its curvature."""
    import numpy as np

    z = x @ w
    s = _sigmoid(z)
    return np.r_[len(x), _softplus(z).sum(), x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()]


def moments_of(x):
    """Number of rows, sums and sums of squares."""
    import numpy as np

    return np.r_[len(x), x.sum(0), (x * x).sum(0)]


def cuts_of(positive):
    """Thresholds from the positives' scores."""
    import numpy as np

    return np.quantile(positive, np.linspace(0.0, 0.7, 71))


def class_prior(positive, above, n: int) -> float:
    """The smallest share of unlabelled to positive scores above a threshold: where only positives are left, it is the prior.

    positive: scores of the positives; above: unlabelled scores at or above each of their cuts, of n.
    """
    import numpy as np

    p = np.array([(positive >= c).mean() for c in cuts_of(positive)])
    u = above / n
    slack = np.sqrt(u * (1 - u) / n) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(((u + slack) / p).min(), LEAST_PRIOR, MOST_PRIOR))


def risk(w, p, total, prior: float) -> tuple[float, float]:
    """(risk of the positives, negative risk) of `fit`: the objective is the first plus what is positive of the second."""
    z = p @ w
    return prior * _softplus(-z).mean(), total[1] / total[0] - prior * _softplus(z).mean()


def descend(p, total_at: Callable, prior: float | None, penalties: tuple[float, float] = PENALTIES, steps: int = STEPS):
    """Weights that minimise the non-negative risk, or, without a prior, tell positives p from unlabelled rows apart.

    total_at(w): sums_at(w) over all unlabelled rows. p has a last column of ones.
    """
    import numpy as np

    d = p.shape[1]
    of_shares, of_words = penalties
    ridge = np.diag(np.r_[np.full(min(d - 1, SHARES), of_shares / len(p)), np.full(max(0, d - 1 - SHARES), of_words / len(p)), 1e-9])

    def value(w, total) -> tuple[float, float]:
        if prior is None:
            return total[1] / total[0] + _softplus(-(p @ w)).mean() + w @ ridge @ w / 2, 0.0
        own, negative = risk(w, p, total, prior)
        return own + max(0.0, negative) + w @ ridge @ w / 2, negative

    w = np.zeros(d)
    total = total_at(w)
    at, _ = value(w, total)
    for _ in range(steps):
        gradient, curvature = total[2 : 2 + d] / total[0], total[2 + d :].reshape(d, d) / total[0]
        if prior is None:
            s = _sigmoid(-(p @ w))
            gradient = gradient - p.T @ s / len(p)
            curvature = curvature + (p * (s * (1 - s))[:, None]).T @ p / len(p)
        else:  # where the negative risk is not negative, the positives enter by their mean alone
            gradient = gradient - prior * p.mean(0)
        step = np.linalg.solve(curvature + ridge + 1e-6 * np.eye(d), gradient + ridge @ w)
        size, moved = 1.0, False
        while size > 0.1:
            there = total_at(w - size * step)
            new, negative = value(w - size * step, there)
            if new <= at and negative >= 0:
                gain, w, total, at, moved = at - new, w - size * step, there, new, True
                break
            size /= 2
        if not moved or gain < 1e-3 * at:
            break
    return w


def fit(p, moments, total_of: Callable, penalties: tuple[float, float] = PENALTIES) -> Model:
    """A model from positives p (measurement rows) and sums over the unlabelled rows.

    moments: moments_of all unlabelled rows. total_of(f, mean, scale): the sum of f(x) over all of them, standardised
    and with a last column of ones.
    """
    import numpy as np

    if not len(p) or not moments[0]:
        return Model([], 0.0, [], [], 0.5)
    d = p.shape[1]
    both = moments + moments_of(p.astype(float))
    mean = both[1 : d + 1] / both[0]
    scale = np.sqrt(np.maximum(both[d + 1 :] / both[0] - mean * mean, 1e-6))
    p = np.c_[(p - mean) / scale, np.ones(len(p))]
    few = [*range(min(d, SHARES)), d]  # hashed words would tell labelled positives from the others by heart
    plain = np.zeros(d + 1)
    plain[few] = descend(p[:, few], lambda w: total_of(lambda x: sums_at(w, x[:, few]), mean, scale), None, penalties)
    cuts = cuts_of(p @ plain)
    above = total_of(lambda x: ((x @ plain)[:, None] >= cuts).sum(0).astype(float), mean, scale)
    prior = class_prior(p @ plain, above, int(moments[0]))
    w = descend(p, lambda w: total_of(lambda x: sums_at(w, x), mean, scale), prior, penalties)
    return Model(w[:-1].tolist(), float(w[-1]), mean.tolist(), scale.tolist(), prior)


def fit_rows(p, u, penalties: tuple[float, float] = PENALTIES) -> Model:
    """A model from positives p and unlabelled rows u that fit into memory."""
    import numpy as np

    return fit(p, moments_of(u), lambda f, mean, scale: f(np.c_[(u - mean) / scale, np.ones(len(u))]), penalties)


def cross_fitted(x, quality, folds, penalties: tuple[float, float], accept: float = 0.7) -> tuple[int, int]:
    """(lost positives, accepted negatives) when each fold's labels are decided by a model of the other folds.

    x: measurements of rows that may be learned from; quality: 1, 0, or -1 without a label; folds: a number for each row.
    """
    import numpy as np

    lost = accepted = 0
    for k in np.unique(folds):
        own, others = folds == k, folds != k
        model = fit_rows(x[others & (quality == 1)], x[others], penalties)
        said = model.scores(x[own]) >= accept
        lost += int((~said & (quality[own] == 1)).sum())
        accepted += int((said & (quality[own] == 0)).sum())
    return lost, accepted


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): measurements of every row's whole text, as half-precision bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x.as_py()).astype(np.float16).tobytes() for x in batch.column(1)], pa.binary())], names=["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x binary")


def _matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float64)


def summed(rows: DataFrame, f: Callable):
    """The sum of f(x) over blocks x of the measurements in `rows` (x); None without rows."""
    import numpy as np

    def of_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = f(_matrix(batch.column(0).slice(k, 2048)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def of_group(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for batch in batches:
            for raw in batch.column(0):
                part = np.frombuffer(raw.as_py())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.select("x").mapInArrow(of_task, "s binary").repartition(GROUPS).mapInArrow(of_group, "s binary")
    found = [np.frombuffer(r["s"]) for r in parts.collect()]
    return sum(found[1:], found[0]) if found else None


def trusted(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id"):
    """Measurements of at most `sample` trusted positives, on the driver: one row an id, however often it is repeated."""
    import numpy as np

    learnable = labels.select(F.col(id_col).alias("id"), "quality").filter(F.col("id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("id")))
    good = learnable.groupBy("id").agg(F.min("quality").alias("q")).filter("q = 1").select("id")
    chosen = good.join(rows.select("id"), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample)
    got = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("x").alias("x")).select("x").collect()  # sample rows at most
    return np.frombuffer(b"".join(sorted(bytes(r["x"]) for r in got)), np.float16).reshape(-1, FEATURES).astype(np.float64)


def train_stored(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> Model:
    """Fit on `rows` (see `measured`), which are read several times: hand in a stored table.

    At most `sample` trusted positives, chosen by a hash of the id, reach the driver; all unlabelled rows are summed up
    where they are.
    """
    import numpy as np

    p = trusted(rows, labels, sample, id_col)
    unlabelled = rows.filter(~held_out(F.col("id")))
    moments = summed(unlabelled, moments_of) if len(p) else None
    if moments is None:
        return Model([], 0.0, [], [], 0.5)

    def total_of(f: Callable, mean, scale):
        return summed(unlabelled, lambda x: f(np.c_[(x - mean) / scale, np.ones(len(x))]))

    return fit(p, moments, total_of)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on documents; their measurements are stored while it lasts."""
    with scratch(docs.sparkSession):
        return train_stored(durable(measured(docs, id_col, text_col), "measured"), labels, sample, id_col)


def score_stored(model: Model, x: Column) -> Column:
    """The score from stored measurements."""
    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(model.scores(np.frombuffer(b"".join(rows), np.float16).reshape(-1, FEATURES).astype(np.float64)))

    return score(x)


def score_column(model: Model):
    """A pandas UDF from text to score."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        import numpy as np

        x = [features(t).astype(np.float16) for t in texts]
        return pd.Series(model.scores(np.array(x, np.float64).reshape(-1, FEATURES)))

    return score
