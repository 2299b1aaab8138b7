"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to four characters of the lower-cased text are hashed into buckets; ASCII characters other than letters are
one blank. A value is 1 + ln(count) times the bucket's inverse document frequency, rows have length 1. Frequencies are
those of all documents that may be learned from, added up where they are. The model is fitted on the driver from a
bounded sample of labelled rows: `SAMPLE` rows, dealt evenly to the languages, and `SAMPLE_VALUES` values in sum. It is
trained by follow-the-regularised-leader with per-coordinate rates and elastic-net penalties: a weight is zero until its
gradients outgrow the first penalty, and only buckets with a weight are sent to tasks. A fifth of the sample is not trained
on; it sets the temperature by which logits are divided, so that scores are probabilities.

Defined results: `und` with score 0 where the text is null or has no letter, and where nothing can be learned from;
empty languages are languages; rows without an id are predicted, not held out and not learned from; equal texts have
equal results; an empty table gives no rows; columns besides id, text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, scratch

BUCKETS = 1 << 16
LONGEST = 4
#: Characters whose runs are counted at once, so that a long text needs little more memory than itself.
BLOCK = 1 << 18
#: At most so many labelled rows are fitted, and so many of their values.
SAMPLE, SAMPLE_VALUES = 10_000, 20_000_000
UNKNOWN = "und"
#: Of the leader: rate, its offset, and the two penalties; times that the sample is read.
RATE, OFFSET, ABSOLUTE, SQUARED, EPOCHS = 0.5, 1.0, 0.02, 1e-3, 2


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(text: str | None):
    """(bucket, count) arrays of a whole text, buckets ascending."""
    import numpy as np

    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, np.uint32)
    ascii_letter = (c >= 97) & (c <= 122)
    c = np.where(ascii_letter | (c > 127), c, np.uint32(32))
    c = np.r_[np.uint32(32), c, np.uint32(32)]
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    count = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(c), BLOCK):
        part = c[start : start + BLOCK + LONGEST - 1].astype(np.uint64)
        h, found = np.zeros(len(part), np.uint64), []
        for k in range(1, LONGEST + 1):
            n = min(BLOCK, len(part) - k + 1)  # runs that start in this block
            if n > 0:
                h = h[: len(part) - k + 1] * np.uint64(0x100000001B3) + part[k - 1 :] + np.uint64(k)
                found.append(((h[:n] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64))
        count += np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def values(text: str | None, idf):
    """(bucket, value) arrays of a text, of length 1."""
    import numpy as np

    at, count = grams(text)
    x = (1 + np.log(count)) * idf[at]
    return at, x / max(1e-12, np.sqrt(x @ x))


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, text, lang) of rows that may be learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.filter(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())


def inverse_frequencies(rows: DataFrame):
    """ln((n + 1) / (documents with the bucket + 1)) + 1 by bucket, over all rows; a row a bucket and task meets."""
    import numpy as np

    def of_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[grams(text.as_py())[0]] += 1
            total[BUCKETS] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(of_task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS + 1)
    for r in found.collect():  # a row a bucket
        total[r["bucket"]] = r["n"]
    return np.log((total[BUCKETS] + 1) / (total[:BUCKETS] + 1)) + 1


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(place, lang, text) of at most `sample` rows, the languages in turn by a hash of the id; stored.

    A language's rows are thinned by the hash to about twice its part before they are ranked, as one may hold most rows.
    """
    counted = durable(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    part = -(-sample // max(1, counted.count()))
    order = F.xxhash64(F.col("id").cast("string"), "text", F.lit(11))
    thin = (F.shiftrightunsigned(order, 1) / float(1 << 63)) < 2.0 * part / F.col("n") + 64.0 / F.col("n")
    kept = rows.join(counted, "lang").filter(thin).select("lang", "text", order.alias("order"))
    ranked = kept.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text")))
    ranked = durable(ranked.filter(F.col("nth") <= part), "language-ranked")
    place = F.row_number().over(Window.orderBy("nth", "lang"))  # a little more than `sample` rows
    return durable(ranked.select("lang", "text", place.alias("place")).filter(F.col("place") <= sample), "language-sample")


def vectors(rows: DataFrame, idf, most: int = SAMPLE_VALUES) -> list[tuple]:
    """(lang, buckets, values) of the sampled rows in order of place, on the driver, as far as their values add up to `most`."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [values(t.as_py(), idf) for t in batch.column(2)]
            raw = [[a.astype(dtype).tobytes() for a in arrays] for dtype, arrays in zip((np.uint16, np.float16), zip(*found, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw[0], pa.binary()), pa.array(raw[1], pa.binary())], names=["place", "lang", "at", "x"])

    made = durable(rows.select("place", "lang", "text").mapInArrow(run, "place int, lang string, at binary, x binary"), "language-vectors")
    summed = made.select("place", F.sum(F.length("at") / 2).over(Window.orderBy("place")).alias("upto"))
    last = summed.filter(F.col("upto") <= most).agg(F.max("place")).first()[0] or 0
    got = sorted(made.filter(F.col("place") <= last).collect(), key=lambda r: r["place"])
    return [(r["lang"], np.frombuffer(r["at"], np.uint16), np.frombuffer(r["x"], np.float16)) for r in got]


@dataclass
class Model:
    languages: list[str]
    idf: object
    used: object  # buckets with a weight
    weights: object  # by language and used bucket
    bias: object
    temperature: float = 1.0

    def logits(self, at, x):
        import numpy as np

        place = np.searchsorted(self.used, at)
        place[place == len(self.used)] = 0
        hit = self.used[place] == at if len(self.used) else np.zeros(len(at), bool)
        return self.weights[:, place[hit]] @ x[hit] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*values(text, self.idf)) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max())
    return e / e.sum()


class Leader:
    """Follow-the-regularised-leader, proximal, for a softmax over sparse rows; the last coordinate is the unpenalised bias."""

    def __init__(self, classes: int, size: int, rate: float = RATE, offset: float = OFFSET, absolute: float = ABSOLUTE, squared: float = SQUARED):
        import numpy as np

        self.z, self.n = np.zeros((classes, size + 1)), np.zeros((classes, size + 1))
        self.rate, self.offset = rate, offset
        self.absolute, self.squared = np.full(size + 1, absolute), np.full(size + 1, squared)
        self.absolute[-1] = self.squared[-1] = 0.0

    def weights(self, at):
        import numpy as np

        z, n = self.z[:, at], self.n[:, at]
        beyond = np.abs(z) - self.absolute[at]
        return np.where(beyond > 0, -np.sign(z) * beyond / ((self.offset + np.sqrt(n)) / self.rate + self.squared[at]), 0.0)

    def learn(self, at, x, label: int) -> None:
        """at, x: the row with the bias, whose value is 1."""
        import numpy as np

        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[:, at] = n + g * g


def temperature(logits, labels: Sequence[int]) -> float:
    """The divisor of logits with the least log loss, between 1/20 and 20, by golden section over its logarithm; 1 without rows.

    Of m rows each counts as 1 of 2 in m + 2 wrong, evenly over the languages, so that a few right ones are no certainty.
    """
    import numpy as np

    if not len(labels):
        return 1.0
    z, y = np.array(logits), np.array(labels)
    wrong = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        s = z / np.exp(t)
        s = s - s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        return -float(((1 - wrong) * s[np.arange(len(y)), y] + wrong * s.mean(1)).mean())

    low, high, ratio = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: Sequence[tuple], idf, epochs: int = EPOCHS) -> Model:
    """A model from (lang, buckets, values); every fifth row calibrates, if each language has others."""
    import numpy as np

    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], idf, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    seen: dict[str, int] = {}
    own, others = [], []
    for lang, at, x in rows:
        seen[lang] = seen.get(lang, 0) + 1
        (others if seen[lang] % 5 == 0 else own).append((number[lang], at, x))
    leader = Leader(len(languages), BUCKETS)
    for _ in range(epochs):
        for label, at, x in own:
            leader.learn(np.r_[at.astype(np.int64), BUCKETS], np.r_[x.astype(np.float64), 1.0], label)
    full = leader.weights(np.arange(BUCKETS + 1))
    used = np.flatnonzero(np.any(full[:, :-1] != 0, axis=0))
    model = Model(languages, idf, used, full[:, used], full[:, -1])
    model.temperature = temperature([model.logits(at, x) for _, at, x in others], [label for label, _, _ in others])
    return model


def train(docs: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_VALUES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows of `docs` that may be learned from."""
    with scratch(docs.sparkSession):
        rows = learnable(docs, id_col, text_col, lang_col)
        idf = inverse_frequencies(rows)
        return fit(vectors(sampled(rows, sample), idf, most), idf)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return made.withColumnRenamed("id", id_col)
