"""Near-duplicates by HyperMinHash.

A document's set of word shingles is hashed into buckets; each bucket's smallest hash is stored compressed, as the
count of its leading zeros and a few mantissa bits. Bands of these registers propose candidates, the share of equal
registers, corrected for chance collisions of compressed values, estimates their Jaccard similarity, and pairs
that may reach the threshold are confirmed on their full sets. For the bands alone, a register without a hash borrows
that of the first filled bucket in an order of its own, so that a register of two sets agrees with a chance of their
similarity, however few shingles they have; the stored registers, which the estimate reads, stay empty.

Documents with equal sets are one node. In each band bucket a hub (the member that shares most buckets) is compared
with every other member, and the links found are joined into components. Pairs inside a component cannot change it;
only members of buckets that still hold different components meet, and they do so where the rarest shingles of one are
among the rarest of the other. Sets that are similar enough must share one of those, so no pair is lost, and texts that
share what is common and differ in what is rare seldom meet. Frequencies are counted in SLOTS slots: with far more shingles
than that the order of the rare ones blurs, which costs work and loses nothing.

Work grows with the number of pairs that are nearly similar, not with the square of a bucket, and components lose no
link between candidates.

With 24 bands of 4 registers a pair at similarity 0.8 is missed with a chance below 4 in a million, and the estimate
lets pass what is within five standard errors of the threshold.

Defined results: words are runs of other characters than ASCII white space, A-Z lower-cased; a text with fewer words
than a shingle is one shingle; a text without words or a null text has the empty set and is linked with nothing;
repeated rows are linked; two rows with one id stay two documents; rows without an id are linked like others, and a
component without any id has none; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.tables import durable, scratch

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10  # bits
EMPTY = 0xFFFF
BLOCK = 4096  # rows of a shared shingle that meet at once with so many others
PART = 4096  # pairs of one hub that are joined with its registers or text at once
SLOTS = 1 << 18  # counters of shingle frequencies
ERRORS = 5  # standard errors below the threshold that the estimate lets pass


def shingles(text: str, words: int) -> set:
    """The set itself, for confirmation."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < words else set(zip(*(w[i:] for i in range(words)), strict=False))


def hashes(text: str | None, words: int):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxh64_intdigest(b"\0".join(w), len(w))], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, w), np.uint64, len(w))
    n = len(w) - words + 1
    s = np.zeros(n, np.uint64)
    for i in range(words):  # a word's place counts
        s = (s ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def registers(sorted_hashes):
    """HyperMinHash registers: leading zeros and mantissa of the smallest hash in each bucket, EMPTY without one."""
    import numpy as np

    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(sorted_hashes):
        top = (sorted_hashes >> np.uint64(32)) * np.uint64(REGISTERS)
        bucket = (top >> np.uint64(32)).astype(np.int64)  # follows the hash, so a bucket's first is its smallest
        used, first = np.unique(bucket, return_index=True)
        low, start = sorted_hashes[first], used.astype(np.uint64) * np.uint64((1 << 64) // REGISTERS)
        share, bits = np.frexp((np.where(low > start, low - start, np.uint64(0)) >> np.uint64(5)).astype(np.float64))  # exact
        mantissa = np.maximum(0, (2 * share - 1) * (1 << MANTISSA)).astype(np.uint16)
        out[used] = (58 - bits).astype(np.uint16) << np.uint16(MANTISSA) | mantissa
    return out


def estimate(a, b, n_a, n_b):
    """Jaccard estimates of row pairs of registers, corrected for chance collisions, and the buckets in use."""
    import numpy as np

    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    k = np.arange(40)

    def first_zeros(n):  # the chance of k leading zeros
        rate = n[:, None] / REGISTERS
        return (1 - 0.5 ** (k + 1)) ** rate - np.where(k == 0, 0.0, (1 - 0.5**k) ** rate)

    chance = (first_zeros(n_a.astype(float)) * first_zeros(n_b.astype(float))).sum(1) / (1 << MANTISSA)
    share = equal / np.maximum(used, 1)
    return np.maximum(0, (share - chance) / (1 - chance)), used


def _may_link(a, b, n_a, n_b, percent: int):
    import numpy as np

    j, used = estimate(a, b, n_a, n_b)
    t = percent / 100
    return (j >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(used, 1))) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def sketch(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, of_text, n_shingles, node, registers): of_text is a hash of the text, node a 128-bit digest of the set, null for the empty set."""
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("of_text"), text.alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            n, node, regs = [], [], []
            for x in batch.column(2):
                h = hashes(x.as_py(), words)
                n.append(len(h))
                node.append(xxh3_128_digest(h.tobytes()) if len(h) else None)
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(regs, pa.binary())], names=["id", "of_text", "n_shingles", "node", "registers"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, of_text long, n_shingles long, node binary, registers binary")


_borrowed: list = []


def _filled(regs):
    """Rows of registers in which empty ones have borrowed (see above)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not _borrowed:
        _borrowed.append(np.array([sorted(range(REGISTERS), key=lambda b: (b != r, xxh64_intdigest(bytes((r, b))))) for r in range(REGISTERS)]))
    order = _borrowed[0]
    first = (regs != EMPTY)[:, order].argmax(2)
    return np.take_along_axis(regs, order[np.arange(REGISTERS), first], 1)


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, node, n): a row for each band of each node."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                regs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                x = (_filled(regs).view(np.uint64) ^ number) * np.uint64(0xBF58476D1CE4E5B9)
                x = ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) ^ number
                of = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view(np.int64)), part.column(0).take(of), part.column(1).take(of)], names=["band", "node", "n"])

    return nodes.select("node", "n", "registers").mapInArrow(run, "band long, node binary, n long")


def _sided(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b) with `column` of both nodes and n where the table has it. A hub's row is dealt to as many parts as its pairs need.

    Joins that carry texts or registers are merged at every size: what is shuffled grows in proportion.
    """
    side = lambda x: table.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in table.columns if c in (column, "n")))
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    hubs = side("a").join(parts.hint("merge"), "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return dealt.join(side("b").hint("merge"), "b").join(hubs.hint("merge"), ["a", "part"])


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers allow a link."""
    both = _sided(pairs, nodes, "registers")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("registers_a", "registers_b")]
                ok = _may_link(*regs, *(batch.column(c).to_numpy() for c in ("n_a", "n_b")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets. texts: (node, text)."""
    both = _sided(pairs, texts, "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, of_last = None, set()
        for batch in batches:
            ok = []
            for a, t_a, t_b in zip(*(batch.column(c) for c in ("a", "text_a", "text_b")), strict=True):
                if (key := a.as_py()) != last:
                    last, of_last = key, shingles(t_a.as_py(), words)
                other = shingles(t_b.as_py(), words)
                common = len(of_last & other)
                ok.append(100 * common >= percent * (len(of_last) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _similar_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _rare(mixed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) across components that may reach the threshold, of nodes (node, component).

    Each set is ordered from its rarest shingle to its most common; frequencies are counted in `SLOTS` slots of hashes,
    as any order that all sets share finds all pairs. Of two sets of sizes n <= m that share at least percent of their
    union, the first n - ceil(2 p n / (1 + p)) + 1 of the smaller and the first m - ceil(p m) + 1 of the larger have one
    in common (p: percent / 100), and beyond the first that they have in common there must be enough of both left. A
    shingle of many sets is dealt to blocks.
    """
    import numpy as np

    rows = durable(texts.join(mixed.hint("merge"), "node").select("node", "component", "text"), "mixed-texts")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, (hashes(t.as_py(), words) % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "c"])

    counted = rows.select("text").mapInArrow(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()  # SLOTS rows at most
    common = np.zeros(SLOTS, np.int64)
    common[counted["slot"].to_numpy()] = counted["c"].to_numpy()
    known = rows.sparkSession.sparkContext.broadcast(common)  # SLOTS numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        common = known.value
        for batch in batches:
            of, place, index, size, keys = [], [], [], [], []
            for k, t in enumerate(batch.column(2)):
                h = hashes(t.as_py(), words)
                n = len(h)
                probed, indexed = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                h = h[np.lexsort((h, common[(h % np.uint64(SLOTS)).astype(np.int64)]))[:probed]]
                of.append(np.full(len(h), k))
                size.append(np.full(len(h), n))
                place.append(np.arange(len(h)))
                index.append(np.arange(len(h)) < indexed)
                keys.append(h.view(np.int64))
            of, *columns = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (of, keys, place, size))
            flags = pa.array(np.concatenate(index) if index else np.empty(0, bool))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), flags, batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(columns[2])], names=["shingle", "place", "index", "node", "component", "n"])

    keys = durable(rows.mapInArrow(run, "shingle long, place long, index boolean, node binary, component binary, n long"), "keys")
    several = keys.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("index").alias("any"), F.count(F.lit(1)).alias("c"))
    blocks = several.filter("lo != hi and any").select("shingle", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    own, each = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = keys.join(blocks, "shingle").withColumn("own", own)
    small = dealt.filter("index").select("shingle", F.col("own").alias("i"), each.alias("j"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"), F.col("component").alias("of_a"))
    large = dealt.select("shingle", each.alias("i"), F.col("own").alias("j"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"), F.col("component").alias("of_b"))
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    enough = (100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b"))
    return small.join(large, ["shingle", "i", "j"]).filter(first & enough & (F.col("of_a") != F.col("of_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_shingles, component_id (the smallest id reachable by links) and kept (it is that one)."""
    with scratch(docs.sparkSession) as scope:
        return scope.keep(_grouped(docs, words, percent, id_col, text_col), "near-duplicates")


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    sketched = durable(sketch(docs, words, id_col, text_col), "sketch")
    known = sketched.filter(F.col("node").isNotNull())
    nodes = durable(known.groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("id", "of_text")).alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "nodes")
    bands = durable(_bands(nodes), "bands")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = durable(bands.join(shared, "band"), "members")

    degree = members.groupBy("node").agg(F.sum("c").alias("degree"))
    hubs = members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node", "n")).alias("h")).select("band", F.col("h.node").alias("a"), F.col("h.n").alias("n_a"))
    stars = durable(members.join(hubs, "band").filter((F.col("a") != F.col("node")) & _similar_size("n", "n_a", percent)).select("a", F.col("node").alias("b")).distinct(), "stars")

    met_nodes = durable(nodes.join(degree.select("node"), "node", "left_semi"), "met-nodes")
    # Found by id and hash of the text: an id may be missing or stand for many texts, and a text for many ids.
    rep = durable(met_nodes.select("node", F.col("rep.id").alias("_rep"), F.col("rep.of_text").alias("_rep_text")), "representatives")
    text = F.col(text_col).cast("string")
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_of_text"), text.alias("text"))
    texts = durable(_of_node(whole.join(rep.hint("merge"), F.col("_id").eqNullSafe(F.col("_rep")) & (F.col("_of_text") == F.col("_rep_text"))).select("node", "text"), words), "texts")

    links = durable(_confirmed(durable(_estimated(stars, met_nodes, percent), "near-stars"), texts, words, percent), "links")
    found = components(links)
    placed = members.join(found, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("band")
    mixed = durable(placed.join(several, "band", "left_semi").select("node", "component").distinct(), "mixed")
    met = _rare(mixed, texts, words, percent)
    pairs = durable(_estimated(durable(met, "met"), met_nodes, percent), "pairs")
    more = durable(_confirmed(pairs, texts, words, percent), "links")
    if more.limit(1).count():
        found = components(links.union(more))

    smallest = nodes.join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = durable(smallest.groupBy("component").agg(F.min("id").alias("component_id")), "least")  # apart, so that the join below can split a hot component
    of_node = smallest.join(least, "component").select("node", "component_id")
    linked = known.select("id", "n_shingles", "node").join(of_node, "node").select("id", "n_shingles", "component_id")
    alone = sketched.filter(F.col("node").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _of_node(texts: DataFrame, words: int) -> DataFrame:
    """Of (node, text), the rows whose text has the node's set: texts may share a hash. One row a node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            ok = [xxh3_128_digest(hashes(t.as_py(), words).tobytes()) == n.as_py() for n, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return texts.mapInArrow(run, "node binary, text string").dropDuplicates(["node"])
