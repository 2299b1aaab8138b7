import random
import struct
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, classifier, media, mixing, neardup, packing, quality_rules, sharding, token_counts, url_filter
from tidemark.llm.common import Encoder, prefix
from tidemark.llm.queries import TOKENIZER

DOC = "doc_id long, text string, lang string, source string, n_chars long, length long, rank int, node string"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty texts, a long text, copies, near copies, repeated rows, ties, and columns with clashing names."""
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "one", "Two words", "zwölf Köpfe ☃ 😀 é", "x", sentence(rng, 6000), "a\nb\na\n\na b c a b c a b c"]
    base = sentence(rng, 120)
    texts += [base] * 7
    for k in range(1, 12):
        w = base.split()
        for p in rng.sample(range(len(w)), k):
            w[p] = "zz" + str(rng.randint(0, 99))
        texts.append(" ".join(w))
    texts += [sentence(rng, rng.randint(1, 200)) for _ in range(60)]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), 1, 2, "n") for i, t in enumerate(texts)]
    return [*out, out[9], out[9], out[1]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def test_prefix_sums(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.random(), rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, x double, v long")
    got = prefix(df, ["k"], F.floor(F.col("x") * 10), [F.col("x")], "before", F.col("v")).collect()
    for r in got:
        assert r["before"] == sum(v for k, x, v in data if k == r["k"] and x < r["x"])


def test_encoder_gives_the_tokenizers_ids():
    import numpy as np

    e = Encoder(TOKENIZER, most=50)
    rng = random.Random(3)
    parts = ["a", " ", "\n", "\t", " 's", "'s", "1", ".", "é", "b", "  ", "!", "\x1c", "\x85", "word", "<|endoftext|>", "日本", "😀", "\u3000"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert e(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_encoder_gives_the_ids_of_the_file_for_texts_with_added_tokens():
    from tokenizers import Tokenizer

    e, plain = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert list(memoryview(e("a <|endoftext|> b")).cast("I")) == [64, 220, 50256, 275]
    for t in ("<|endoftext|>", "a<|endoftext|>b c", "x <|endoftext|><|endoftext|>\n", "<|endoftext|", "one <| endoftext|> two"):
        assert list(memoryview(e(t)).cast("I")) == plain.encode(t, add_special_tokens=False).ids, t


def test_encoder_gives_the_ids_of_the_file_for_every_class_of_character():
    from tokenizers import Tokenizer

    e, plain = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    points = [*range(0x80, 0xD800, 7), *range(0xE000, 0x40000, 61), 0x558, 0x208F, 0x10940, 0x16EA0, 0x323B0]
    for c in map(chr, points):
        t = f"x{c}'s {c}1 y{c}"
        assert list(memoryview(e(t)).cast("I")) == plain.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_encoder_merges_a_word_once_and_cuts_no_word_of_letters():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    e, cut, merge = Encoder(TOKENIZER), [], []
    pattern, merged = e.cut, e._of_shown
    e.cut, e._of_shown = lambda t: cut.append(t) or pattern(t), lambda t: merge.append(t) or merged(t)
    text = "First blonthing übermär, blonthing. blonthing! übermär.\nNext blonthing-x слово 日本; word"
    assert list(memoryview(e(text)).cast("I")) == plain.encode(text, add_special_tokens=False).ids
    assert not any(t[0] == " " and t[1:].isalpha() for t in cut)
    assert len(merge) == len(set(merge))
    assert merge and not merge.clear() and e(text) and not merge


@pytest.mark.parametrize(("chunk", "held", "most"), [(1, 0, 9), (40, 200, 9), (300, 2000, 7), (1 << 20, 1 << 20, 1000)])
def test_encoder_gives_the_ids_of_a_column_in_any_chunks(chunk, held, most):
    import pyarrow as pa

    rng = random.Random(chunk)
    parts = ["a", "word", " word", " ", "  ", "\n", "Next", ", ", ".", "'s", " é", "é,", "1", "\u3000", "\x1c", "\u0378", "<|endoftext|>", "日本", "😀", "z" * 70]
    texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(1500)]
    e = Encoder(TOKENIZER, most)
    e.CHUNK, e.HELD = chunk, held
    ids = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for a, b in ((0, 1500), (7, 9), (700, 1400), (3, 3)):
            got = [list(memoryview(bytes(x)).cast("I")) for x in e.column(pa.array(texts, kind)[a:b])]
            assert got == ids[a:b]
            assert len(e.known) == len(e.ids) <= most and e.known.nbytes + e.ids.nbytes <= held + 100
    assert list(e.column(pa.array([], pa.string()))) == []


def test_encoder_gives_the_ids_of_the_file_for_every_letter():
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    e, plain = Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "L"]
    assert all(map(str.isalpha, letters)) and len(letters) > 100_000
    texts = ["".join(f" {c} a{c}b, {c}. '{c}" for c in letters[i : i + 200]) for i in range(0, len(letters), 200)]
    for t, ids in zip(texts, e.column(pa.array(texts)), strict=True):
        assert list(memoryview(ids).cast("I")) == plain.encode(t, add_special_tokens=False).ids, t[:2]


def test_quality_rules_against_plain_loops(docs, rows, nothing):
    got = sorted(map(tuple, quality_rules.ledger(docs).select("doc_id", *quality_rules.MEASURES).collect()))
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {p for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines)))
    assert got == sorted(want)
    assert quality_rules.ledger(nothing).count() == 0


def test_policies_and_ablations(docs):
    led = quality_rules.ledger(docs).cache()
    kept = led.filter(~quality_rules.rejected("v2")).count()
    for r in quality_rules.ablations(led, "v2").collect():
        others = sum(quality_rules.BIT[x] for x in quality_rules.POLICIES["v2"] if x != r["rule"])
        assert r["kept_without"] == led.filter(F.col("failed").bitwiseAND(F.lit(others)) == 0).count() == kept + r["failed_alone"]


def test_token_counts_against_plain_sums(docs, rows, nothing):
    e = Encoder(TOKENIZER)
    n = [len(e(t or "")) // 4 for _, t, *_ in rows]
    hist = token_counts.histogram(docs, TOKENIZER).cache()
    ans = token_counts.answers(hist, width=64).collect()
    assert {r["n_tokens"] for r in ans} == set(n)
    for r in ans:
        limit = r["n_tokens"]
        assert r["truncated_total"] == sum(min(x, limit) for x in n)
        assert r["tokens_over"] == sum(x for x in n if x > limit) and r["documents_over"] == sum(x > limit for x in n)
        assert r["share_upto"] == pytest.approx(sum(x <= limit for x in n) / len(n))
    got = {r["context_limit"]: r["tokens"] for r in token_counts.truncated_total(hist, [1, 7, 100]).collect()}
    assert got == {k: sum(min(x, k) for x in n) for k in (1, 7, 100)}
    assert token_counts.quantile(token_counts.answers(hist), 0.5).first()[0] == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.answers(token_counts.histogram(nothing, TOKENIZER)).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, rows, nothing, capacity):
    e = Encoder(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, capacity).collect()
    ids = {i: e(t or "") + bytes(4) for i, t, *_ in rows}
    sequences = defaultdict(list)
    for r in got:
        raw = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["ids_crc32"] == zlib.crc32(raw) and len(raw) == 4 * r["length"]
        assert r["piece"] == 0 or r["length"] == capacity
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(ids[r[0]]) // 4 for r in rows)
    assert sum(r["length"] for r in got) == total
    assert len(sequences) <= -(-total // capacity) * 11 // 9 + 1
    assert packing.pack(nothing, TOKENIZER, capacity).count() == 0


def test_plan_is_best_fit():
    assert packing.plan({}, 10) == []
    rows = packing.plan({6: 2, 4: 1, 3: 3, 1: 2}, 10)
    bins = defaultdict(int)
    for length, a, b, first, per, _ in rows:
        for j in range(b - a):
            bins[first + j // per] += length
    assert sorted(bins.values()) == [1, 10, 10, 10] or sorted(bins.values()) == [7, 10, 10] or sum(bins.values()) == 27
    assert max(bins.values()) <= 10 and len(bins) == 3


def test_url_filter_against_plain_rules(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    entries = [(url_filter.key_of(r), r, v) for r, v in rules] + [(url_filter.key_of("bad.example.org"), None, "block")]
    urls = [None, "", "no scheme.com/en/", "http://a.com/en/1", "HTTP://A.Example.COM/en/725?x=1", "https://example.com/en/7", "http://notexample.net/de/8", "http://x.example.net/de/8#t", "http://bad.example.org/es/1", "http://x.bad.example.org/fr", "http://com", "http://é.com/en/ü", "http://a.com?/en/", "x://", "http://xcom/en/1", "http://a.com/en/1"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
        fits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        if fits:
            return host, path, *max(fits)[1:]
        return host, path, None, "block" if host == "bad.example.org" or host.endswith(".bad.example.org") else "allow"

    want = [(i, *plain(u)) for i, u in enumerate(urls)]
    index = url_filter.Index.build(entries)
    assert sorted(map(tuple, url_filter.judge(df, index).select("page_id", "judged.*").collect())) == want
    table = spark.createDataFrame(entries, "key string, rule string, verdict string")
    assert sorted(map(tuple, url_filter.judge_by_join(df, table, index.lengths).select("page_id", "judged.*").collect())) == want
    assert {r["judged"]["verdict"] for r in url_filter.judge(df, url_filter.Index.build([])).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), index).count() == 0
    again = df.union(df).withColumn("_answer", F.lit("x"))
    for most in (100, 2):  # mapped, joined
        got = url_filter.judge_entries(again, table, most=most)
        assert sorted(map(tuple, got.select("page_id", "judged.*").collect())) == sorted([*want, *want])
        assert {"page_id", "url", "host", "_answer", "judged"} == set(got.columns)


def test_collisions_are_confirmed_by_string(tmp_path):
    from xxhash import xxh64_intdigest

    index = url_filter.Index.build([("a.com /x", "a.com/x", "block"), ("b.com /x", "b.com/x", "allow")])
    asked = index.entries[0][0]
    index.digests = [xxh64_intdigest(asked.encode())] * 2  # every key has the digest of the first
    (tmp_path / "index").write_bytes(index.file())
    host, path = asked.split(" ")
    assert url_filter.probe(url_filter.Mapped(str(tmp_path / "index")), index.lengths, [(host, path), ("c.com", "/x")]) == [index.entries[0], None]


def test_sharding(docs, rows, nothing):
    got = sharding.shard(docs, 4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(4))
    counts = [len(slots.get(s, [])) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    homes = {r["shard"] for r in got if r["size"] == len(rows[9][1]) + 1 and r["text_crc32"] == zlib.crc32(rows[9][1].encode())}
    assert len(homes) == 1  # nine copies of one text fit into a quarter of the rows
    assert sharding.shard(nothing, 4).count() == 0


def test_sharding_splits_what_no_shard_can_hold(spark):
    got = sharding.shard(spark.createDataFrame([(i, "same" if i % 10 else f"t{i}") for i in range(400)], "doc_id long, text string"), 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [100] * 4


def test_sharding_keeps_little_groups_whole_beside_a_hot_one(spark):
    rows = spark.range(30_000).selectExpr("id as doc_id", "case when id < 10000 then 'hot' when id < 16000 then concat('p', id div 2) when id < 17875 then 'full' else concat('t', id) end as text")
    got = sharding.shard(rows, 16).select("doc_id", "shard", "slot").join(rows, "doc_id").cache()
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [1875] * 16
    assert got.groupBy("shard").agg(F.countDistinct("slot").alias("n")).filter("n != 1875").count() == 0
    assert sharding.cut_links(got.filter("text != 'hot'"), ["text"]).first()["cut"] == 0  # one of them fills a shard


@pytest.mark.parametrize("texts,copies,most", [(2000, 4, 0), (200, 40, 8)])
def test_sharding_with_every_row_linked(spark, texts, copies, most):
    rows = spark.range(texts * copies).selectExpr("id as doc_id", f"concat('t', id % {texts}) as text")
    got = sharding.shard(rows, 16).join(rows, "doc_id").cache()
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [texts * copies // 16] * 16
    assert got.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() <= most


def test_sharding_moves_linked_documents_together(spark):
    rng = random.Random(12)
    rows = spark.createDataFrame([(i, f"text {i // 2 if i < 40 else i}") for i in range(400)] + [(7, "again"), (None, "x"), (500, None)], "doc_id long, text string")
    pairs = [(i, j, 1.0) for k in range(0, 400, 10) for i in range(k, k + 10) for j in range(i + 1, k + 10)] + [(rng.randrange(400), rng.randrange(400), 0.25) for _ in range(60)]
    links = spark.createDataFrame([*pairs, (3, 3, 9.0), (3, 999, 9.0), (500, 1, 9.0), (None, 1, 9.0)], "a long, b long, weight double")
    plain, led = (sharding.shard(rows, 4, links=x) for x in (None, links))
    known = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long, weight double")
    before, after = (sharding.cut_weight(x.dropDuplicates(["doc_id"]), known).first() for x in (plain, led))
    assert after["cut"] < 0.35 * before["cut"]
    counts = sorted(r["count"] for r in led.groupBy("shard").count().collect())
    assert sum(counts) == 403 and counts[-1] - counts[0] <= 1
    assert led.join(rows.filter("doc_id < 40"), "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1 and text != 'again'").count() <= 4
    assert sharding.shard(rows.limit(0), 4, links=links).count() == 0


def test_sharding_grants_what_comes_back_and_what_room_is_free():
    got = sharding.allowed({(0, 1): 10, (1, 0): 4, (2, 1): 6}, [0, 6, 0])
    assert got == {(0, 1): 4 + 3, (1, 0): 4, (2, 1): 3}


def test_sharding_plan_cuts_only_what_no_shard_holds():
    rng = random.Random(4)
    for _ in range(200):
        wishes = {(rng.randint(2, 60), rng.randrange(4)): rng.randint(1, 9) for _ in range(rng.randint(0, 25))}
        total = sum(size * n for (size, _), n in wishes.items()) + rng.randint(0, 40)
        quota = [total // 4 + (t < total % 4) for t in range(4)]
        rows, room = sharding.plan(wishes, quota)
        for key, n in wishes.items():
            assert sorted(k for size, to, a, b, _ in rows if (size, to) == key for k in range(a, b)) == list(range(n))
        assert room == [quota[t] - sum(size * (b - a) for size, _, a, b, home in rows if home == t) for t in range(4)] and min(room) >= 0
        cut = [size for size, _, a, b, home in rows if home is None for _ in range(a, b)]
        assert all(size > max(room) for size in cut) and len(cut) < 8
        parts = sharding.split(cut, room)
        assert [sum(b - a for k, a, b, _ in parts if k == i) for i in range(len(cut))] == cut
        assert all(sum(b - a for _, a, b, t in parts if t == home) <= room[home] for home in range(4))


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 1, "assistant", " \n lead <|end|> \\<| <\\| 😀é \n"), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", "x\\"), (2, 0, None, "<"), (2, 1, "assistant", "|turn|>"), (None, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df, TOKENIZER).cache()
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] or 0, *x[1:]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())
        assert got[c]["n_turns"] == len(turns)
    for r in made.collect():
        assert len(r["input_ids"]) == len(r["loss_mask"])
    assert chat.digests(chat.format_conversations(df.limit(0), TOKENIZER)).count() == 0


def test_media_round_trip(docs, rows, nothing):
    got = {r["doc_id"]: r for r in media.inspect(media.store_texts(docs)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == sha256(media.mux(payload)).hexdigest()
        assert [k["offset"] for k in r["keyframes"]] == [r["media_bytes"] - len(payload) + 64 * 64 * j for j in range(-(-len(payload) // 4096))]
    assert media.inspect(media.store_texts(nothing)).count() == 0


def test_damaged_media():
    good = media.mux(bytes(64 * 300))
    assert media.describe(good).codec == "raw " and len(media.describe(good).keyframes) == 5
    for bad in (b"", b"abc", good[:100], good[:-1], good[:4] + b"\xff\xff\xff\xff" + good[8:]):
        assert media.describe(bad) is None or media.demux(bad, media.describe(bad)) is not None


def patched(data, kind, at, *values):
    """`data` with numbers (32 bits) written `at` bytes into the first box of a kind."""
    i = data.index(kind) + 4 + at
    return data[:i] + struct.pack(f">{len(values)}I", *values) + data[i + 4 * len(values) :]


def test_media_tables_that_lie(spark):
    good = media.mux(bytes(range(64)) * 130)
    n = 130
    damaged = [patched(good, b"stsz", 8, 0xFFFFFFF0), patched(good, b"stsz", 4, 0, 0xFFFFFFF0), patched(good, b"stco", 4, 0xFFFFFFF0), patched(good, b"stsc", 4, 0xFFFFFFF0), patched(good, b"stss", 4, 0xFFFFFFF0), patched(good, b"stsz", 4, 0xFFFFFFF0), patched(good, b"stco", 8, 0xFFFFFFF0)]
    assert [media.describe_all(x) for x in damaged] == [None] * len(damaged)
    assert media.describe(patched(good, b"stsc", 12, 0xFFFFFFF0)).samples == media.describe(good).samples  # more a chunk than there are
    assert media.describe(patched(good, b"stss", 8, 0)).keyframes == [64, 128]  # entry 0 names no sample
    assert media.describe(patched(good, b"stss", 8, n + 1)).keyframes == [64, 128]
    still = patched(good, b"mdhd", 12, 0)  # timescale 0
    assert media.feature(media.describe(still)).split(";")[1] == f"{n * 64:.3f}s"
    got = media.inspect(spark.createDataFrame([(i, x) for i, x in enumerate([*damaged, still, None])], "id long, media binary")).collect()
    assert [r["codec"] for r in sorted(got, key=lambda r: r["id"])] == [None] * len(damaged) + ["raw ", None]


def test_media_with_64_bit_sizes_and_offsets():
    payload = bytes(range(256)) * 3
    good = media.mux(payload)
    i = good.index(b"mdat") - 4
    wide = good[:i] + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload
    moved = media.describe(patched(wide, b"stco", 8, i + 16))
    assert media.demux(wide, moved) == payload
    j, old = good.index(b"stco") - 4, media.describe(good).samples[0][0]
    co64 = media.full(b"co64", struct.pack(">IQ", 1, old + 4))
    data = good[:j] + co64 + good[j + 20 :]
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        k = data.index(kind) - 4
        data = data[:k] + struct.pack(">I", struct.unpack_from(">I", data, k)[0] + 4) + data[k + 4 :]
    assert media.demux(data, media.describe(data)) == payload


def test_media_with_two_tracks_and_with_fragments(spark):
    def track(number, codec, sizes, offsets, keys, duration):
        pack = lambda *v: struct.pack(f">{len(v)}I", *v)
        stbl = media.box(
            b"stbl", media.full(b"stsd", pack(1), media.box(codec, bytes(8))), media.full(b"stts", pack(1, len(sizes), 10) if sizes else pack(0)), media.full(b"stsc", pack(1, 1, 1, 1) if sizes else pack(0)),
            media.full(b"stsz", pack(0, len(sizes), *sizes)), media.full(b"stco", pack(len(offsets), *offsets)), *([media.full(b"stss", pack(len(keys), *keys))] if keys else []),
        )
        return media.box(b"trak", media.full(b"tkhd", pack(0, 0, number, 0, 0)), media.box(b"mdia", media.full(b"mdhd", pack(0, 0, 100, duration, 0)), media.box(b"minf", stbl)))

    def two(base):
        video, sound = track(1, b"avc1", [3, 4], [base, base + 5], [1], 20), track(2, b"mp4a", [2, 1], [base + 3, base + 9], [], 20)
        return media.box(b"ftyp", b"isom") + media.box(b"moov", video, sound)

    data = two(len(two(0)) + 8) + media.box(b"mdat", b"VVVssWWWWt")
    video, sound = media.describe_all(data)
    assert (video.codec, video.duration, video.keyframes, media.demux(data, video)) == ("avc1", 20, [0], b"VVVWWWW")
    assert (sound.codec, sound.track, sound.keyframes, media.demux(data, sound)) == ("mp4a", 2, [0, 1], b"sst")

    trex = [media.full(b"trex", struct.pack(">5I", n, 1, 10, 2, 0x10000 if n == 1 else 0)) for n in (1, 2)]
    head = media.box(b"ftyp", b"isom") + media.box(b"moov", track(1, b"avc1", [], [], [], 0), track(2, b"mp4a", [], [], [], 0), media.box(b"mvex", *trex))

    def moof(at):
        first = media.full(b"trun", struct.pack(">IiIIIII", 2, at, 0, 7, 3, 7, 1), flags=0x305)  # first sample is a keyframe; own durations and sizes
        second = media.full(b"trun", struct.pack(">I", 2))  # goes on after the track before, in the usual size
        mine = media.full(b"tfhd", struct.pack(">I", 1), flags=0x20000)
        return media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), media.box(b"traf", mine, first), media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 2)), second))

    part = moof(len(moof(0)) + 8)
    parts = head + part + media.box(b"mdat", b"VVVWabcd") + part + media.box(b"mdat", b"XXXYefgh")
    video, sound = media.describe_all(parts)
    assert (video.duration, video.keyframes, media.demux(parts, video)) == (28, [0, 2], b"VVVWXXXY")
    assert (sound.duration, sound.keyframes, media.demux(parts, sound)) == (40, [0, 1, 2, 3], b"abcdefgh")

    got = {r["id"]: r for r in media.inspect(spark.createDataFrame([(1, data), (2, parts), (3, b"no")], "id long, media binary")).collect()}
    assert [(t["track"], t["codec"], t["payload_sha256"]) for t in got[1]["tracks"]] == [(1, "avc1", sha256(b"VVVWWWW").hexdigest()), (2, "mp4a", sha256(b"sst").hexdigest())]
    assert got[1]["payload_sha256"] == got[1]["tracks"][0]["payload_sha256"] and got[3]["tracks"] is None
    assert [(t["n_samples"], t["duration_s"], t["payload_bytes"]) for t in got[2]["tracks"]] == [(4, 0.28, 8), (4, 0.4, 8)]


def brute_components(rows, words, percent):
    sets = [(i, neardup.shingles(t or "", words)) for i, t, *_ in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                label = [label[b] if v == label[a] else v for v in label]
    least = {}
    for k, (i, _) in zip(label, sets, strict=True):
        least[k] = min(i, least.get(k, i))
    return sorted((i, len(s), least[k], i == least[k]) for k, (i, s) in zip(label, sets, strict=True))


@pytest.mark.parametrize("slots,words", [(neardup.SLOTS, 4), (1, 4), (neardup.SLOTS, 5)])
def test_near_duplicates_against_all_pairs(docs, rows, nothing, slots, words, monkeypatch):
    monkeypatch.setattr(neardup, "SLOTS", slots)  # with one counter any order of shingles: the same pairs
    got = sorted(map(tuple, neardup.near_duplicates(docs, words, 80).collect()))
    assert got == brute_components(rows, words, 80)
    assert slots == 1 or neardup.near_duplicates(nothing, words, 80).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_rare_shingles_find_every_pair(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    texts = []
    for _ in range(30):  # families of texts that differ in a few words, next to the threshold
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 40))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for p in rng.sample(range(len(w)), rng.randint(0, 3)):
                w[p] = f"z{rng.randint(0, 9)}"
            texts.append(" ".join(w))
    texts = sorted(set(texts))
    node = lambda i: i.to_bytes(4, "big")
    table = spark.createDataFrame([(node(i), t) for i, t in enumerate(texts)], "node binary, text string")
    crowded = table.select("node", F.col("node").alias("component"))
    got = {tuple(sorted((bytes(a), bytes(b)))) for a, b in neardup._rare(crowded, table, 3, 80).collect()}
    sets = [neardup.shingles(t, 3) for t in texts]
    want = {(node(i), node(j)) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want and want <= got and len(got) < 6 * len(want)


def test_texts_that_share_what_is_common_never_meet(spark):
    core = "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = spark.range(3000).select(F.col("id").cast("string").cast("binary").alias("node"), F.concat(F.lit(f"{core} u"), F.col("id").cast("string")).alias("text"))
    assert neardup._rare(rows.select("node", F.col("node").alias("component")), rows, 4, 80).count() == 0
    linked = rows.withColumn("text", F.regexp_replace("text", "u1$", "u2"))  # the text of 1 is then that of 2
    assert neardup._rare(linked.select("node", F.col("node").alias("component")), linked, 4, 80).count() == 1


def test_registers_against_plain_loops():
    import numpy as np

    rng = np.random.default_rng(8)
    for n in (1, 5, 300, 5000):
        h = np.unique(rng.integers(0, 2**63, n, np.uint64) << np.uint64(1))
        smallest = {}
        for x in map(int, h):
            b = ((x >> 32) * neardup.REGISTERS) >> 32
            smallest[b] = min(x, smallest.get(b, x))
        got = neardup.registers(h)
        assert [i for i, v in enumerate(got) if v != neardup.EMPTY] == sorted(smallest)
        for b, x in smallest.items():
            rest = max(0, x - b * ((1 << 64) // neardup.REGISTERS)) >> 5
            bits = rest.bit_length()
            mantissa = (rest << neardup.MANTISSA + 1 >> bits) - (1 << neardup.MANTISSA) if bits else 0
            assert got[b] == (58 - bits) << neardup.MANTISSA | mantissa


def test_filled_registers_agree_as_often_as_sets_are_similar():
    import numpy as np

    rng = np.random.default_rng(3)
    agree = []
    for _ in range(400):
        h = rng.integers(0, 2**63, 12, np.uint64) << np.uint64(1)
        a, b = (neardup.registers(np.unique(x)) for x in (h[:10], h[2:]))
        filled = neardup._filled(np.array([a, b]))
        assert (filled != neardup.EMPTY).all()
        agree.append((filled[0] == filled[1]).mean())
    assert abs(np.mean(agree) - 8 / 12) < 0.03


def test_near_duplicates_link_rows_without_an_id_and_ids_with_many_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    far = " ".join(f"v{i}" for i in range(60))
    rows = [(None, base), (None, f"{base} x"), (7, f"{base} y"), (8, far), (8, "other words stand here now"), (8, f"{far} z"), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80)
    found = Counter(map(tuple, got.collect()))
    assert found == Counter([(None, 57, 7, False), (None, 58, 7, False), (7, 58, 7, True), (8, 57, 8, True), (8, 2, 8, True), (8, 58, 8, True), (None, 0, None, True)])


def test_estimates_are_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        common, own = rng.integers(0, 2**63, 800, np.uint64), rng.integers(0, 2**63, 200, np.uint64)
        a, b = np.unique(common << np.uint64(1)), np.unique(np.r_[common[:700], own] << np.uint64(1))
        true = 700 / 1000
        j, _ = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        errors.append(j[0] - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_mixing(spark, nothing):
    rng = random.Random(9)
    data = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["b", "a", "a", "a", "a", "a", None, "é", "tiny"]) if i else "tiny") for i in range(600)]
    data += [(600, None, "a"), (5, *data[5][1:]), (7, "other text", "b")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix(df, (5, 2, 1), 3).collect()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:  # share, stop, share the excess again
        left = total - sum(3 * sizes[s] for s in full)
        open_w = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / open_w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        epochs = int(r["target"] // r["source_size"])
        assert r["size"] == 0 or r["taken"] // r["size"] in (epochs, epochs + 1)
    for s in order:
        assert taken[s] <= target[s] + 1e-6 and taken[s] >= target[s] - 12, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5), (5, 2, 1), 3).collect()))
    assert mixing.mix(nothing, (5, 2, 1), 3).count() == 0


def test_mixing_deals_even_cells_whatever_the_weights(spark, monkeypatch):
    seen = []
    real = mixing.prefix

    def spy(df, keys, bucket, *rest):
        seen.append([r["n"] for r in df.groupBy(*keys, bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()])
        return real(df, keys, bucket, *rest)

    monkeypatch.setattr(mixing, "prefix", spy)
    df = spark.range(40_000).selectExpr("id as doc_id", "concat('w ', id) as text", "'a' as source").union(spark.range(40_000).selectExpr("-id", "'w w'", "'b'"))
    mixing.mix(df, (1, 1), 3, weight=F.when(F.col("source") == "a", 0.1).otherwise(F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.3)))
    assert all(max(n) < 1.3 * sum(n) / len(n) for n in seen) and seen


def test_mixing_query(spark):
    from tidemark.llm.queries import op10_mixing

    got = op10_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sizes = Counter()
    for r in docs.values():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len((docs[r["doc_id"]]["text"] or "").encode().split()) and r["source_size"] == sizes[source] and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
        longest[source] = max(longest[source], r["size"])
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(target[s] <= 3 * sizes[s] + 1e-6 and taken[s] <= target[s] + 1e-6 and taken[s] > target[s] - longest[s] for s in sizes)


def test_sharding_query(spark):
    from tidemark.llm.queries import op5_sharding

    got = op5_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    assert sorted({r["shard"] for r in got}) == list(range(16))


def test_packing_query(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.queries import op3_best_fit_packing

    plain = Tokenizer.from_file(TOKENIZER)
    got = op3_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    parts = defaultdict(list)
    for r in got:
        want = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(want)}I", *want)) and len(want) == r["length"] <= 2048
        parts[r["doc_id"]].append((r["start"], r["length"], r["piece"]))
    for i, found in parts.items():
        assert sum(n for _, n, _ in found) == len(ids[i]) and [k for *_, k in sorted(found)] == list(range(len(found)))
    assert set(parts) == set(ids)


def test_heavier_documents_come_first_more_often(spark):
    df = spark.createDataFrame([(i, "w " * 10 + ("### " * 8 if i % 2 else "good " * 8), "a" if i < 900 else "b") for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.mix(df, (1, 9), 3).filter("source = 'a' and taken > 0").select((F.col("doc_id") % 2).alias("junk")).groupBy("junk").count().collect()
    n = {r["junk"]: r["count"] for r in got}
    assert n.get(0, 0) > 1.5 * n.get(1, 0)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.train(docs, labels)
    assert 0.7 < model.prior < 0.95
    scored = docs.withColumn("score", classifier.score_column(model)("text")).join(labels, "doc_id").filter(classifier.held_out(F.col("doc_id")))
    right = scored.agg(F.avg(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95


def test_classifier_edges(spark, docs, nothing):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = classifier.train(docs, empty)
    got = docs.withColumn("score", classifier.score_column(model)("text")).collect()
    assert {r["score"] for r in got} == {0.5}
    assert classifier.train(nothing, empty).prior == 0.5
    assert classifier.features(None).tolist() == classifier.features("").tolist()


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == [i for i, _, _, kept in brute_components(rows, 5, 80) if kept]
    e = Encoder(TOKENIZER)
    assert docs.agg(F.sum("length")).first()[0] == sum(len(e(r["text"])) // 4 + 1 for r in before.collect())
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_pipeline_stages_with_clashing_columns_and_nulls(spark, rows):
    import corpus_pipeline

    names = ["_measures", "_failed", "_row", "_copy", "_times", "_score", "id", "size", "row", "group", "first", "failed", "judged", "copies", "_id", "text_crc32"]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").select("*", *(F.lit(n).alias(n) for n in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns, name
        assert {tuple(r[n] for n in names) for r in got.collect()} <= {tuple(names)}, name
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.columns == docs.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)


def test_quality_stage_against_plain_verdicts(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")

    def bad(t):
        n, chars, symbols, dup, repeat, lines = quality_rules.measures(t)
        return n < 50 or 100 * repeat > 50 * n or 2 * symbols > n or (lines >= 8 and 2 * dup > lines) or 2 * chars < 3 * n or chars > 40 * n

    got = Counter(r["text"] for r in corpus_pipeline.quality_rules_stage(spark, docs, "").collect())
    assert got == Counter(t for _, t, *_ in rows if not bad(t))


def test_classifier_stage_keeps_what_scores_high(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.read.parquet(f"{sf}/documents.parquet").limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    model = classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import numpy as np

    want = Counter()
    for r in docs.collect():
        x = classifier.features(r["text"]).astype(np.float16).astype(float)
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale, strict=True)) + model.bias
        want[r["doc_id"], r["text"]] += 1 / (1 + np.exp(-z)) >= 0.7
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.classifier_stage(spark, docs, sf).collect())
    assert got == +want


def test_scratch_tables_go(spark, docs):
    import glob

    from tidemark.tables import shared_dir

    before = set(glob.glob(f"{shared_dir(spark)}/tidemark-*"))
    got = neardup.near_duplicates(docs, 4, 80)
    left = set(glob.glob(f"{shared_dir(spark)}/tidemark-*")) - before
    assert len(left) == 1 and "near-duplicates" in left.pop() and got.count()


def test_near_dedup_stage_decides_by_row(spark):
    import corpus_pipeline

    near = [" ".join(f"{c}{i}" for i in range(80)) for c in "pqr"]
    data = [(1, near[0]), (2, "quite another text stands in this place"), (2, near[0] + " x"), (None, near[0] + " y"), (None, "words of a row that has no id"), (None, near[1]), (None, near[1] + " x"), (None, near[1] + " y"), (5, near[2] + " x"), (5, near[2]), (5, near[2]), (7, " "), (7, " "), (8, " "), (None, None), (None, None), (9, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    named = [r for r in got if not (r[1] or "").startswith(("q0", "r0"))]
    assert Counter(named) == Counter([data[0], data[1], data[4], (7, " "), (8, " "), (None, None), (9, "")])
    assert [i for i, t in got if t and t.startswith("q0")] == [None] and [i for i, t in got if t and t.startswith("r0")] == [5]


def test_mixing_stage_takes_rows_and_not_ids(spark):
    import corpus_pipeline

    rng = random.Random(6)
    data = [(None if i % 3 == 0 else i % 40 if i % 3 == 1 else 1000 + i, f"t{i} " + "w " * rng.randint(0, 30), "abc"[i % 2 + (i % 7 == 0)]) for i in range(400)]
    data += data[:30]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    taken = Counter()
    for r in corpus_pipeline.mixing_stage(spark, docs, "").collect():
        taken[r["source"]] += len(r["text"].split())
    rows = mixing.mix(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.MOST_EPOCHS).select("source", "target").distinct().collect()
    for r in rows:
        assert r["target"] - 32 <= taken[r["source"]] <= r["target"] + 1e-6
    again = corpus_pipeline.mixing_stage(spark, docs.repartition(5), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, corpus_pipeline.mixing_stage(spark, docs, "").collect()))


def test_classifier_counts_a_repeated_id_once(spark):
    rows = [(1, "a few plain words here")] * 40 + [(1, "### $$$ |||"), (4, "other words of another text"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = classifier.trusted(classifier.measured(docs), labels)
    assert {zlib.crc32(b"1") % 4, zlib.crc32(b"4") % 4, zlib.crc32(b"6") % 4}.isdisjoint({2})
    half = lambda t: classifier.features(t).astype("float16").tobytes()
    first = min(half(t) for t in {t for i, t in rows if i == 1})
    assert got.shape == (3, classifier.FEATURES)
    assert sorted(map(bytes, got.astype("float16"))) == sorted([first, half(rows[-2][1]), half(None)])


def test_risk_gradient_and_curvature_against_plain_loops():
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    p, u, w, prior = np.c_[rng.normal(1, 1, (40, 3)), np.ones(40)], np.c_[rng.normal(0, 1, (90, 3)), np.ones(90)], rng.normal(size=4), 0.4
    loss = lambda z: math.log1p(math.exp(-z))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    total = classifier.sums_at(w, u)
    own, negative = classifier.risk(w, p, total, prior)
    assert own == pytest.approx(prior * sum(loss(dot(w, x)) for x in p) / 40)
    unbiased = lambda w: sum(loss(-dot(w, x)) for x in u) / 90 - prior * sum(loss(-dot(w, x)) for x in p) / 40
    assert negative == pytest.approx(unbiased(w))
    whole = lambda w: prior * sum(loss(dot(w, x)) for x in p) / 40 + unbiased(w)
    gradient, curvature = total[2:6] / 90 - prior * p.mean(0), total[6:].reshape(4, 4) / 90
    for i in range(4):
        e = np.eye(4)[i] * 1e-4
        assert gradient[i] == pytest.approx((whole(w + e) - whole(w - e)) / 2e-4, abs=1e-6)
        for j in range(4):
            f = np.eye(4)[j] * 1e-3
            e3 = np.eye(4)[i] * 1e-3
            assert curvature[i, j] == pytest.approx((whole(w + e3 + f) - whole(w + e3 - f) - whole(w - e3 + f) + whole(w - e3 - f)) / 4e-6, abs=1e-4)


def test_descent_reaches_the_smallest_risk_that_is_not_negative():
    import numpy as np

    rng = np.random.default_rng(4)
    p, u = np.c_[rng.normal(1.5, 1, (300, 2)), np.ones(300)], np.c_[np.r_[rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (700, 2))], np.ones(1000)]
    at = lambda w: classifier.sums_at(w, u)
    w = classifier.descend(p, at, 0.3)
    ridge = np.diag([classifier.PENALTIES[0] / 300] * 2 + [1e-9])

    def objective(w):
        own, negative = classifier.risk(w, p, at(w), 0.3)
        return own + max(0.0, negative) + w @ ridge @ w / 2

    assert classifier.risk(w, p, at(w), 0.3)[1] >= 0
    assert all(objective(w) <= objective(w + d) + 1e-5 for d in rng.normal(scale=0.05, size=(200, 3)) if classifier.risk(w + d, p, at(w + d), 0.3)[1] >= 0)
    tight = classifier.descend(p, at, 0.9)  # a prior far too high: the clamp holds it
    assert classifier.risk(tight, p, at(tight), 0.9)[1] >= 0


def test_prior_against_plain_counts():
    import numpy as np

    rng = np.random.default_rng(6)
    for share in (0.2, 0.6, 0.9):
        p, u = rng.normal(3, 1, 4000), np.r_[rng.normal(3, 1, int(20000 * share)), rng.normal(-3, 1, int(20000 * (1 - share)))]
        cuts = classifier.cuts_of(p)
        above = np.array([sum(1 for x in u if x >= c) for c in cuts[::7]])
        counted = (u[:, None] >= cuts).sum(0)
        assert (counted[::7] == above).all()
        assert classifier.class_prior(p, counted, len(u)) == pytest.approx(share, abs=0.05)


def test_sums_over_tasks_are_those_of_all_rows(spark, docs, rows):
    import numpy as np

    stored = classifier.measured(docs)
    x = np.array([classifier.features(t).astype(np.float16) for _, t, *_ in rows], float)
    assert np.allclose(classifier.summed(stored, classifier.moments_of), classifier.moments_of(x))
    w = np.linspace(-1, 1, classifier.FEATURES)
    assert np.allclose(classifier.summed(stored, lambda x: classifier.sums_at(w, x)), classifier.sums_at(w, x))
    assert classifier.summed(stored.limit(0), classifier.moments_of) is None


def test_classifier_query(spark):
    from tidemark.llm.queries import op1_quality_classifier

    got = op1_quality_classifier(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    by_text = defaultdict(set)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        by_text[texts[r["doc_id"]]].add(r["score"])
    assert all(len(v) == 1 for v in by_text.values())
