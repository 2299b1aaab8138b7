import math
import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling

DOC = "doc_id long, text string, source string, rank string, score int, n long, row int, part int"


def plain(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[at(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for nth, (i, text, *_) in enumerate(docs):
        w, f = features(text)
        weight = sum(gain[at(x)] for x in f) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w >= least, zlib.crc32((text or "").encode()), nth])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6], r[7]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in rows)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [w + str(i % 7) for i, w in enumerate("Über Kopf ab ba x Y é 日本 z9 q".split() * 4)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "!", "\x7f", "\t"]) for _ in range(n))
    out = [(i * 3 - 40, text(rng.randint(0, 60))) for i in range(150)]
    out += [(500, None), (501, ""), (None, text(30)), (None, text(30)), (502, text(40_000)), (503, "... --- \n")]
    out += [out[3]] * 9 + [(504, text(25)), (504, text(25))] + [(2**62, text(22)), (-(2**62), text(22))]
    return [(*r, "s", "r", 1, 2, 3, 4) for r in out]


@pytest.mark.parametrize("args", [{}, {"percent": 60, "least": 1}, {"percent": 100, "least": 0}, {"percent": 30, "longest": 3, "buckets": 97}, {"percent": 0}, {"least": 10**6}])
def test_same_as_by_definition(spark, rows, args):
    target = [rows[5][1], "nothing of it", None, "é é 日本3"]
    docs = spark.createDataFrame(rows, DOC).coalesce(1)
    got = resampling.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, n int"), **args).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows, target, **args)


def test_empty_tables(spark, rows):
    target = spark.createDataFrame([], "text string")
    docs = spark.createDataFrame(rows, DOC).coalesce(1)
    assert sorted(str(tuple(r)) for r in resampling.resample(docs, target).collect()) == plain(rows, [])
    assert resampling.resample(docs.limit(0), target).collect() == []


def test_first_k_is_exact_on_wide_keys_and_ties(spark):
    rng = random.Random(9)
    extremes = [-(2**63), 2**63 - 1, 0, -1, 1]
    data = [(rng.choice([5, 5, 5, -(10**12), 10**15, *extremes]), rng.choice([*extremes, rng.getrandbits(40)]), i) for i in range(400)]
    df = spark.createDataFrame(data, "a long, b long, c long")
    keys = [F.col(c) for c in "abc"]
    for k in (1, 2, 57, 200, 399, 400):
        got = sorted(tuple(r) for r in df.filter(resampling.first_k(df, keys, k)).collect())
        assert got == sorted(data)[:k]
    assert df.filter(resampling.first_k(df, keys, 0)).count() == 0
    with pytest.raises(ValueError):
        resampling.first_k(df.limit(3), [F.lit(0).cast("long")], 2)
