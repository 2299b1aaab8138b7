"""Importance resampling towards a target distribution.

Features are hashed runs of words. Their counts over all documents and over the target give each bucket a gain, an array
that every task holds; a document's weight is the mean gain of its features, and its score adds Gumbel noise drawn from
its id, so that the highest scores are a sample without replacement by weight. The last score drawn is found exactly by
radix selection: the key (score down, id, text, row) is cut into digits of 16 bits, a round counts the documents by
their next digit among those that share the digits found, and goes on in the digit in which the k-th lies, until all of
a digit's documents are drawn. Only drawn documents are sorted, by ranges, and ranked.

Defined results: a null text has no feature; null ids draw as an empty id and come last among equal scores; rows of one
score and id come in the order of their text's crc32, then as stored; a table without documents gives no rows, without
target texts every bucket counts as empty there; columns besides id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cells_for, durable, prefix, scratch

#: Bytes by byte: A-Z lower-cased, what is neither letter nor digit nor beyond ASCII a blank.
_WORDS = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
DIGIT = 16
_SIGN = 1 << 63


def buckets_of(text: str | None, buckets: int, longest: int = 1) -> tuple:
    """The number of words, and the bucket of every run of 1 to `longest` of them, in order of length and place."""
    import numpy as np

    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []
    runs = list(words)
    for k in range(2, longest + 1):
        runs += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len(words), np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets)


def counts(texts: DataFrame, buckets: int, longest: int = 1, text_col: str = "text"):
    """Features by bucket over all texts: an array. One row a bucket and task meets."""
    import numpy as np

    def of_task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(buckets_of(text.as_py(), buckets, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(of_task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source, target):
    """Log ratio of the shares of a bucket in target and source, each counted once more, in thousandths."""
    import numpy as np

    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, tie): the floored mean gain of every document's features."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            w, n, weight, tie = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            for i, text in enumerate(batch.column(1)):
                w[i], at = buckets_of(text := text.as_py(), len(gain), longest)
                tie[i] = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
                if len(at):
                    n[i], weight[i] = len(at), int(gain[at].sum()) // len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (w, n, weight, tie))], names=["doc_id", "n_words", "n_features", "weight", "tie"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, tie long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def first_k(rows: DataFrame, keys: Sequence[Column], k: int) -> Column:
    """Which of the rows are the first k in ascending order of keys, longs without null that together differ in every row.

    Each round counts rows by one digit of a key, so at most 65,536 numbers reach the driver.
    """
    if k <= 0:
        return F.lit(False)
    fixed: list[tuple[Column, int]] = []

    def below(last: Column) -> Column:
        for key, value in reversed(fixed):
            last = (key < F.lit(value)) | ((key == F.lit(value)) & last)
        return last

    signed = lambda u: u - _SIGN
    for key in keys:
        bits_of = key.bitwiseXOR(F.lit(-_SIGN))  # unsigned order
        among = rows
        for earlier, value in fixed:
            among = among.filter(earlier == F.lit(value))
        low, high, n = among.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        low, high = low + _SIGN, high + _SIGN
        bits = (low ^ high).bit_length()
        found = low >> bits
        while bits:
            width = min(DIGIT, bits)
            # From the whole unsigned key no bit is fixed yet, and a shift by 64 would be one by 0.
            here = among.filter(F.shiftrightunsigned(bits_of, bits) == F.lit(found)) if bits < 64 else among
            digit = F.shiftrightunsigned(bits_of, bits - width).bitwiseAND(F.lit((1 << width) - 1))
            for r in sorted(here.groupBy(digit.alias("digit")).count().collect()):
                if k <= r["count"]:
                    break
                k -= r["count"]
            bits -= width
            found = found << width | r["digit"]
            if k == r["count"]:  # all rows up to this digit
                return below(key <= F.lit(signed((found + 1 << bits) - 1)))
        if k == n:  # all have one value
            return below(F.lit(True))
        fixed.append((key, signed(found)))
    raise ValueError(f"the keys do not tell rows apart, or there are too few: {k} are missing")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, n_features, weight, score and rank: from 1 for the `percent` hundredths of the documents with `least`
    words and more that are drawn, null for others."""
    with scratch(docs.sparkSession) as scope:
        gain = gains(counts(docs, buckets, longest, text_col), counts(target, buckets, longest))
        rows = weighed(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
        enough = F.col("n_words") >= least
        fit = rows.filter(enough)
        keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("tie"), F.col("row")]
        k = fit.count() * percent // 100
        drawn = enough & first_k(fit, keys, k)
        ranged = rows.filter(drawn).repartitionByRange(cells_for(k), *keys).withColumn("part", F.spark_partition_id())
        ranked = prefix(durable(ranged, "resample-drawn"), [], F.col("part"), keys, "before").withColumn("rank", F.col("before") + 1)
        columns = [F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank"]
        others = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
        return scope.keep(ranked.select(*columns).unionByName(others.select(*columns)), "resample")

