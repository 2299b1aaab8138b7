import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, id string, at int, held_out int, lang_pred string, score string"
SOUNDS = {"aa": "ba ko ri tu ma", "bb": "sch pf ung eit zer", "cc": "eau oux ille ent que"}


def said(rng, lang, n):
    return " ".join("".join(rng.choices(SOUNDS[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def test_grams_count_runs_of_characters():
    at, count = language.grams("Ab1  ba!")
    runs = [t[i : i + k] for t in (" ab ba ",) for k in range(1, 5) for i in range(len(t) - k + 1)]
    assert count.sum() == len(runs)
    assert len(at) == len(set(runs)) and sorted(count) == sorted(runs.count(r) for r in set(runs))
    same, n = language.grams("AB ba")
    assert (at == same).all() and (count == n).all()


def test_blocks_of_a_long_text_lose_no_run(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("ab cé☃", k=1000))
    at, count = language.grams(text)
    for size in (1, 2, 3, 7, 999, 1002, 1003):
        monkeypatch.setattr(language, "BLOCK", size)
        same, n = language.grams(text)
        assert (at == same).all() and (count == n).all()


def test_leader_follows_the_plain_rule():
    rng = random.Random(1)
    classes, size = 3, 6
    leader = language.Leader(classes, size, rate=0.5, offset=1.0, absolute=0.05, squared=0.1)
    z, n = [[0.0] * (size + 1) for _ in range(classes)], [[0.0] * (size + 1) for _ in range(classes)]

    def weight(k, i):
        absolute, squared = (0.0, 0.0) if i == size else (0.05, 0.1)
        if abs(z[k][i]) <= absolute:
            return 0.0
        return -(z[k][i] - math.copysign(absolute, z[k][i])) / ((1.0 + math.sqrt(n[k][i])) / 0.5 + squared)

    for _ in range(60):
        at = sorted(rng.sample(range(size), 3)) + [size]
        x = [rng.uniform(-1, 1) for _ in range(3)] + [1.0]
        label = rng.randrange(classes)
        w = [[weight(k, i) for i in at] for k in range(classes)]
        e = [math.exp(sum(a * b for a, b in zip(row, x))) for row in w]
        for k in range(classes):
            for j, i in enumerate(at):
                g = (e[k] / sum(e) - (k == label)) * x[j]
                z[k][i] += g - (math.sqrt(n[k][i] + g * g) - math.sqrt(n[k][i])) / 0.5 * w[k][j]
                n[k][i] += g * g
        leader.learn(np.array(at), np.array(x), label)
    assert np.allclose(leader.weights(np.arange(size + 1)), [[weight(k, i) for i in range(size + 1)] for k in range(classes)])


def test_absolute_penalty_leaves_weak_buckets_out():
    rows = [("x", np.array([1, 5]), np.array([1.0, 0.01])), ("y", np.array([2, 5]), np.array([1.0, 0.01]))] * 40
    model = language.fit(rows, np.ones(language.BUCKETS))
    assert set(model.used) == {1, 2}


def test_temperature_makes_scores_probabilities():
    rng = np.random.default_rng(3)
    true = rng.normal(size=(4000, 3)) * 2
    p = np.exp(true) / np.exp(true).sum(1, keepdims=True)
    labels = [rng.choice(3, p=q) for q in p]
    assert language.temperature(list(true * 5), labels) == pytest.approx(5, rel=0.1)
    assert language.temperature(list(true / 2), labels) == pytest.approx(0.5, rel=0.1)
    assert language.temperature([], []) == 1.0
    few = language.temperature([np.array([9.0, 0.0])] * 8, [0] * 8)
    assert language.softmax(np.array([9.0, 0.0]) / few)[0] == pytest.approx(0.95, abs=0.01)  # 1 of 2 in 10 is spread over both


def test_held_out_documents_are_told_apart_and_scores_are_calibrated(spark):
    rng = random.Random(5)
    langs = sorted(SOUNDS)
    rows = [(i, said(rng, langs[i % 3 if i % 7 else 0], rng.randint(2, 60)), langs[i % 3 if i % 7 else 0], "s", "x", 1, 2, "p", "q") for i in range(900)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    model = language.train(docs)
    assert model.languages == langs
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = [r["lang"] == r["lang_pred"] for r in got]
    assert len(got) > 150 and sum(right) > 0.97 * len(got)
    assert abs(sum(r["score"] for r in got) - sum(right)) < 0.05 * len(got)


def test_nothing_of_held_out_rows_is_learned(spark):
    """Wrong languages, and other texts, in rows that are held out leave every weight as it was."""
    rng = random.Random(6)
    rows = [(i, said(rng, "aa" if i % 2 else "bb", 20), "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("text", F.when(language.held_out(F.col("doc_id")), "zz zz").otherwise(F.col("text")))
    a, b = language.train(docs), language.train(spoiled.unionByName(docs.filter("doc_id < 50").withColumn("doc_id", F.lit(None).cast("long"))))
    assert a.languages == b.languages and np.allclose(a.idf, b.idf) and np.allclose(a.weights, b.weights) and a.temperature == b.temperature


def test_sample_is_bounded_and_even(spark):
    rows = [(i, f"w{i % 50} text", "rare" if i % 300 == 0 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4)
    got = language.sampled(docs, 40).collect()
    assert len(got) <= 40 and sorted(r["place"] for r in got) == list(range(1, len(got) + 1))
    assert sum(r["lang"] == "rare" for r in got) == 10 and sum(r["lang"] == "hot" for r in got) == 20
    idf = np.ones(language.BUCKETS)
    all_rows = language.vectors(language.sampled(docs, 40), idf)
    some = language.vectors(language.sampled(docs, 40), idf, most=sum(len(at) for _, at, _ in all_rows) // 2)
    assert 0 < len(some) < len(all_rows)


def test_nulls_blank_long_and_empty(spark):
    rng = random.Random(8)
    odd = [(1000, None), (1001, ""), (1002, " 12 ... \n"), (1003, said(rng, "bb", 30000)), (None, said(rng, "cc", 9)), (1004, "日本語 ☃"), (1004, "日本語 ☃"), (1005, "x")]
    rows = [(i, said(rng, sorted(SOUNDS)[i % 3], 12), sorted(SOUNDS)[i % 3]) for i in range(150)] + [(i, t, None) for i, t in odd]
    docs = spark.createDataFrame([(*r, "s", "x", 1, 2, "p", "q") for r in rows], DOC)
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["score"] <= 1
    assert all((by[i][0]["lang_pred"], by[i][0]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003][0]["lang_pred"] == "bb" and by[None][0]["lang_pred"] == "cc" and not by[None][0]["held_out"]
    assert by[1004][0] == by[1004][1] and by[1005][0]["lang_pred"] in SOUNDS
    none = docs.limit(0)
    assert language.identify(none, language.train(none)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.identify(unlabelled, language.train(unlabelled)).collect()} == {("und", 0.0)}


def test_query_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op11_language_id"](spark, data).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    out = [r for r in got if r["held_out"]]
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
