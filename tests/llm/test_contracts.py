"""Queries against what they promise, and bounds that operators keep."""

import random
import struct
import subprocess
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier, media, mixing, sharding, url_filter
from tidemark.llm.queries import CONTEXT, QUERIES, SHARDS, TOKENIZER

DATA = "/root/testdata/sf0.01"


def test_sharding_query_sizes_slots_and_groups(spark, monkeypatch):
    ran = []
    real = sharding.propagate
    monkeypatch.setattr(sharding, "propagate", lambda *a, **k: ran.append(1) or real(*a, **k))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op5_sharding"](spark, DATA).collect()
    assert ran == [1]
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
        homes[raw].add(r["shard"])
    assert set(slots) <= set(range(SHARDS)) and max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(SHARDS)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(h) == 1 for h in homes.values())  # no group is larger than a shard


def test_equal_texts_are_led_together_by_propagation(spark):
    """Groups apart over all shards at the start are whole in the labels that propagation returns."""
    rng = random.Random(2)
    rows = [(bytes([g // 256, g % 256]), s, rng.randint(1, 3)) for g in range(300) for s in rng.sample(range(8), rng.randint(2, 5))]
    by_shard = spark.createDataFrame(rows, "_group binary, shard int, _n long")
    total = sum(r[2] for r in rows)
    seen = []
    real = sharding.propagate
    try:
        sharding.propagate = lambda *a, **k: seen.append(real(*a, **k)) or seen[-1]
        sharding._led(by_shard, [2 * total // 8] * 8)
    finally:
        sharding.propagate = real
    apart = seen[0].groupBy("node._group").agg(F.countDistinct("shard").alias("k")).filter("k > 1").count()
    assert apart == 0


def test_long_paths_are_cut_seldom(spark):
    """16 paths of 100 documents over 16 shards of 100: 1,584 links."""
    n = 1600
    rng = random.Random(3)
    ids = list(range(n))
    rng.shuffle(ids)
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    links = spark.createDataFrame([(ids[k], ids[k + 1], 1.0) for k in range(n - 1) if (k + 1) % 100], "a long, b long, weight double")
    placed = sharding.shard(rows, 16, links=links)
    found = sharding.cut_weight(placed, links).first()
    assert found["weight"] == 1584 and found["cut"] < 158
    assert [r["count"] for r in placed.groupBy("shard").count().collect()] == [100] * 16


def test_a_hub_with_very_many_neighbours(spark):
    """One document is linked to all others; clusters and shards keep their sizes."""
    rows = spark.range(800).selectExpr("id as doc_id", "concat('t', id) as text")
    links = spark.range(1, 800).selectExpr("0L as a", "id as b", "1.0D as weight")
    placed = sharding.shard(rows, 4, links=links)
    assert [r["count"] for r in placed.groupBy("shard").count().collect()] == [200] * 4
    assert sharding.cut_weight(placed, links).first()["cut"] == 600  # no better is possible
    nodes = rows.select(F.col("doc_id").alias("node"), F.lit(1).cast("long").alias("size"))
    assert sharding.clusters(nodes, sharding._both_ways(links), 50).groupBy("cluster").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] <= 50


def test_mix_leaves_no_room_for_a_document_that_fits(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(docs, (5, 2, 1), 3).collect()
    used, target = defaultdict(int), {}
    for r in got:
        used[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    for r in got:
        whole = int(target[r["source"]] // r["source_size"]) if r["source_size"] else 0
        if r["size"] and r["copies"] == whole:  # its extra copy was not taken
            assert used[r["source"]] + r["size"] > target[r["source"]]
    assert all(used[s] <= target[s] + 1e-6 for s in used)


def test_packing_query_has_no_gaps(spark):
    got = QUERIES["op3_best_fit_packing"](spark, DATA).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= CONTEXT
    for parts in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at)
            at += length
    total = sum(r["length"] for r in got)
    assert len(places) <= total / CONTEXT * 1.01 + 1


def test_words_alone_tell_two_vocabularies_apart():
    """Positives and the rest differ by their words only: lengths, punctuation and repetitions are alike."""
    import numpy as np

    rng = random.Random(5)
    words = [["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)] for _ in range(2)]
    text = lambda v: " ".join(rng.choices(words[v], k=80)) + "."
    kinds = [i % 2 for i in range(1200)]
    x = np.array([classifier.features(text(k)) for k in kinds], np.float64)
    trusted = np.array([k == 0 and i < 400 for i, k in enumerate(kinds)])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    p, u = (np.c_[(part - mean) / scale, np.ones(len(part))] for part in (x[trusted], x))
    w = classifier.descend(p, lambda w: classifier.sums_at(w, u), 0.5, (300.0, 300.0))
    fresh = np.array([classifier.features(text(k)) for k in kinds[:400]], np.float64)
    scores, good = np.c_[(fresh - mean) / scale, np.ones(400)] @ w, np.array(kinds[:400]) == 0
    assert (scores[good][:, None] > scores[~good]).mean() > 0.98


def test_cross_fitting_counts_decisions_of_folds_left_out():
    import numpy as np

    rng = np.random.default_rng(4)
    quality = np.array([1, 0, -1] * 200)
    x = np.zeros((600, classifier.FEATURES))
    x[:, 0] = np.where(quality == 0, 4.0, 0.0) + rng.normal(0, 0.3, 600)
    assert classifier.cross_fitted(x, quality, np.arange(600) // 3 % 4, (1.0, 1e6)) == (0, 0)
    assert classifier.cross_fitted(x, np.where(quality == 0, 1, quality), np.arange(600) // 3 % 4, (1.0, 1e6))[1] == 0
    swapped = np.where(np.arange(600) < 3, 1 - np.abs(quality), quality)  # a wrong label each way in one fold
    assert sum(classifier.cross_fitted(x, swapped, np.arange(600) // 3 % 4, (1.0, 1e6))) >= 2


def _file(stsz: bytes, stsc: tuple, payload: bytes = bytes(range(64)), offsets: tuple = (0,)) -> bytes:
    """A container with one track and the given sample tables; offsets count from the payload's start."""
    def made(base: int) -> bytes:
        stbl = media.box(
            b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(28))), media.full(b"stts", struct.pack(">I", 0)),
            media.full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *r) for r in stsc)), stsz, media.full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *(base + o for o in offsets))))
        mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 8000, 64, 0, 0)), media.box(b"minf", stbl))
        return media.box(b"ftyp", b"isom") + media.box(b"moov", media.box(b"trak", media.full(b"tkhd", struct.pack(">IIII", 0, 0, 1, 0)), mdia))
    return made(len(made(0)) + 8) + media.box(b"mdat", payload)


def _stsz(sizes, each=0) -> bytes:
    return media.full(b"stsz", struct.pack(f">II{0 if each else len(sizes)}I", each, len(sizes), *([] if each else sizes)))


@pytest.mark.parametrize("bits,table", [(16, struct.pack(">3H", 10, 20, 34)), (8, bytes([10, 20, 34])), (4, bytes([0xA5, 0xF0]))])
def test_compact_sample_sizes(bits, table):
    stz2 = media.full(b"stz2", bytes([0, 0, 0, bits]), struct.pack(">I", 3), table)
    found = media.describe(_file(stz2, ((1, 3, 1),)))
    assert [n for _, n in found.samples] == ([10, 5, 15] if bits == 4 else [10, 20, 34])


def test_tables_that_do_not_fit_are_refused():
    good = _file(_stsz([16] * 4), ((1, 4, 1),))
    assert media.demux(good, media.describe(good)) == bytes(range(64))
    for first in (0, 2):
        assert media.describe(_file(_stsz([16] * 4), ((first, 4, 1),))) is None
    assert media.describe(_file(_stsz([16] * 4), ((1, 2, 1), (1, 2, 1)), offsets=(0, 32))) is None
    # Many samples over the same bytes: each fits, together they are far more than the file.
    huge = _file(_stsz([64] * 400), ((1, 1, 1),), offsets=(0,) * 400)
    assert len(huge) < 5000 and media.describe(huge) is None


def test_media_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, codec string, Tracks int")
    stored = media.store_texts(docs).crossJoin(docs.select("codec", "Tracks").limit(1))
    got = media.inspect(stored.select("doc_id", "codec", "Tracks", "n_bytes", "media"))
    assert len(got.columns) == len({c.lower() for c in got.columns})
    assert got.first()["codec"].strip() == "raw"


def test_rules_lower_ascii_hosts_only():
    assert url_filter.key_of("ÉCOLE.Fr/A") == "École.fr /A"
    host, path = url_filter.split("http://ÉCOLE.FR/a/b")
    assert url_filter.key_of("ÉCOLE.fr/a") == f"{host} {path[:2]}"


def test_encoder_memory_is_bounded_by_bytes():
    """2,000 texts without blanks; ids are the tokenizer's."""
    code = f"""
import random, resource, sys
sys.path.insert(0, {str(__import__("pathlib").Path(__file__).resolve().parents[2])!r})
from array import array
from tidemark.llm.common import Encoder
e = Encoder({TOKENIZER!r})
rng = random.Random(1)
alphabets = ["".join(map(chr, range(0x4E00, 0x5200))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
texts = ["".join(rng.choices(alphabets[i % 2], k=8000)) for i in range(2000)]
for t in texts[:2]:
    assert e(t) == array("I", e.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for t in texts:
    e(t)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout)
    assert grown < 200


def test_encoder_gives_memory_back_after_a_column():
    """Workers live on: what columns of many different words took doesn't stay, beyond bounded tables."""
    code = f"""
import random, re, sys
sys.path.insert(0, {str(__import__("pathlib").Path(__file__).resolve().parents[2])!r})
from pathlib import Path
import pyarrow as pa
from tidemark.llm.common import Encoder
def anonymous():
    return int(re.search(r"\\nAnonymous: +([0-9]+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
e = Encoder({TOKENIZER!r})
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(400_000)]
columns = [pa.array([" ".join(rng.choices(words, k=500)) for _ in range(2048)]) for _ in range(4)]
before = anonymous()
for column in columns:
    for ids in e.column(column):
        assert len(ids)
del ids
print(anonymous() - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout)
    assert grown < 80


def test_pipeline_stages_hand_python_bounded_batches(spark):
    """Their results are computed when a reader asks, after the stage has returned."""
    import corpus_pipeline

    session = spark.newSession()
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.col("id") * 60 + i)), " ")
    docs = session.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    got = [r["n"] for r in corpus_pipeline.quality_rules_stage(session, docs, "").mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 6000 and max(got) <= 2048

    from tidemark.tables import bound

    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    bound(session)
    assert session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
