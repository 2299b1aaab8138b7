"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; the conversations that start with it are its members, and its owner is the
smallest of them. Who is smallest at a node is smallest at every deeper node of its path, so a conversation owns a suffix
of its path, and one number a conversation, the depth at which its suffix starts, says all: a first group-by of paths
finds the owners, and a second one sums, over members, what a member's turns add below a node without those that it
owns, whether it owns the next node, and whether it owns the leaf it ends in. No node meets its occurrences again in a
join, so that a turn which starts a third of all conversations is summed where its rows are.

Paths are 128-bit digests: running exclusive-ors of two hashes of (depth, SHA-256 of the turn). A conversation is dealt
to cells of neighbouring turns and its running sums meet as one row a cell, so that one long conversation fills many tasks.
The conversations that end in a node are hashed as a stream of sorted blocks, by one task a node as SHA-256 demands, which
holds one batch at a time.

Built of DataFrame functions, but for that stream. Defined results: turns come in the order of their number, null first,
and turns of one number in that of the SHA-256 of the role's byte count, a colon, role and text; null roles and texts are
empty; repeated rows are turns of their own; rows without a conversation are ignored; an empty table has no node, not
even a root; columns besides the four are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cells_for, durable, prefix, scratch

NODE = ["depth", "a", "b"]
#: Nodes with more than a HOT-th of all conversations as children, and more than LEAST_HOT, are broadcast to them: fewer than HOT.
HOT, LEAST_HOT = 4096, 1000


def ordered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, pos, digest, bytes), stored: turns with their place in the conversation, from 0; part: a range of neighbours."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"))  # equal rows can be dealt to several ranges
    rows = durable(rows, "trie-rows")
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    ranged = rows.repartitionByRange(cells_for(rows.count()), F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    numbered = prefix(durable(ranged, "trie-ranges"), ["conv_id"], F.col("part"), order, "pos")
    return durable(numbered.select("conv_id", "part", "pos", "digest", "bytes"), "trie-turns")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (conv_id, cell, depth, digest, bytes) and conversations (conv_id, length) of `ordered` turns as they are."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return turns.select("conv_id", F.col("part").alias("cell"), (F.col("pos") + 1).alias("depth"), "digest", "bytes"), convs


def grafted(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The same, when each conversation c starts with the first h turns of c - c % every in place of its own first h.

    h: the unsigned crc32 of c in decimals, modulo `most`. The remainder has the sign of c. Where that conversation is
    shorter all its turns are taken, none where there is none.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    cells = durable(turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "trie-cells")
    own = cells.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = durable(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))).alias("length")), "trie-conversations")
    # Each of the few first turns goes to the conversations that share a base, fewer than twice `every`.
    first = turns.filter(F.col("pos") < most - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    taken = convs.filter("taken > 0").join(first, "base").filter(F.col("pos") < F.col("taken")).select("conv_id", F.lit(-1).alias("cell"), (F.col("pos") + 1).alias("depth"), "digest", "bytes")
    facts = durable(cells.join(convs.select("conv_id", "h", "taken"), "conv_id").select("conv_id", "part", "h", "taken"), "trie-facts")
    rest = turns.join(facts, ["conv_id", "part"]).filter(F.col("pos") >= F.col("h"))
    rest = rest.select("conv_id", F.col("part").alias("cell"), (F.col("pos") + 1 - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes")
    return taken.unionByName(rest), convs.select("conv_id", "length")


def _paths(found: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, cell, depth, a, b, before, bytes, length): every conversation at each node of its path, the root included.

    before: bytes of the turns above the last one. Stored.
    """
    tag = lambda k: F.xxhash64(F.lit(k), F.col("depth"), F.col("digest"))
    found = durable(found.select("conv_id", "cell", "depth", tag(1).alias("a"), tag(2).alias("b"), "bytes"), "trie-occurrences")
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    zero = F.lit(0).cast("long")
    cells = found.groupBy("conv_id", "cell").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("bytes"))
    cells = cells.select("conv_id", "cell", *(F.coalesce(f(c).over(earlier), zero).alias(f"_{c}") for f, c in ((F.bit_xor, "a"), (F.bit_xor, "b"), (F.sum, "bytes"))))
    cells = durable(cells.join(convs, "conv_id"), "trie-sums")
    w = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = found.withColumn("a", F.bit_xor("a").over(w)).withColumn("b", F.bit_xor("b").over(w)).withColumn("before", F.sum("bytes").over(w) - F.col("bytes"))
    rows = within.join(cells, ["conv_id", "cell"]).select(
        "conv_id", "cell", "depth", F.col("a").bitwiseXOR(F.col("_a")).alias("a"), F.col("b").bitwiseXOR(F.col("_b")).alias("b"), (F.col("before") + F.col("_bytes")).alias("before"), "bytes", "length")
    roots = convs.select("conv_id", F.lit(-2).alias("cell"), *(zero.alias(c) for c in ("depth", "a", "b", "before", "bytes")), "length")
    return durable(rows.unionByName(roots), "trie-paths")


def _starts(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, start, leaf, upto, a, b), a row a conversation: where its own suffix starts (past its end if it owns none),
    whether it owns the leaf it ends in, the bytes above the suffix, and the node above it. Stored."""
    nodes = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.bool_or(F.col("depth") < F.col("length")).alias("inner"))
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("start"), F.bool_or(~F.col("inner")).alias("leaf"))
    starts = convs.join(owned, "conv_id", "left").select("conv_id", F.coalesce("start", F.col("length") + 1).alias("start"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    above = paths.select("conv_id", (F.col("depth") + 1).alias("start"), "a", "b", (F.col("before") + F.col("bytes")).alias("upto"))
    return durable(starts.join(above, ["conv_id", "start"], "left").select("conv_id", "start", "leaf", F.coalesce("upto", F.lit(0).cast("long")).alias("upto"), "a", "b"), "trie-starts")


def _parents(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv_id, depth, parent): the owner of the node above the first that a conversation owns."""
    asked = starts.filter("start > 0").select("conv_id", F.col("start").alias("depth"), (F.col("start") - 1).alias("up"), "a", "b")
    most = max(LEAST_HOT, starts.count() // HOT)
    owners = nodes.select(F.col("depth").alias("up"), "a", "b", F.col("conv_id").alias("parent"), "n_children")
    hot = owners.filter(F.col("n_children") > most).drop("n_children")  # each conversation starts one suffix at most, so there are few
    crowded = asked.join(F.broadcast(hot), ["up", "a", "b"], "left")
    crowded = durable(crowded, "trie-crowded")
    others = crowded.filter("parent is null").drop("parent").join(owners.filter(F.col("n_children") <= most).drop("n_children"), ["up", "a", "b"])
    columns = ["conv_id", "depth", "parent"]
    return crowded.filter("parent is not null").select(columns).unionByName(others.select(columns))


def _streamed(batches: Iterator) -> Iterator:
    """SHA-256 of each node's blocks, which come in order, joined by commas."""
    from hashlib import sha256

    import pyarrow as pa

    at, hashed = None, None

    def done():
        return pa.RecordBatch.from_pylist([dict(zip(NODE, at, strict=True), ends_sha256=hashed.hexdigest())], schema=pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())]))

    for batch in batches:
        out = []
        for *key, said in zip(*(batch.column(c).to_pylist() for c in (*NODE, "said")), strict=True):
            if key == at:
                hashed.update(b",")
            else:
                if at is not None:
                    out.append(done())
                at, hashed = key, sha256()
            hashed.update(said.encode())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if at is not None:
        yield done()


def _ends(paths: DataFrame, n: int) -> DataFrame:
    """(node, ends_sha256) of nodes in which a conversation ends."""
    ends = paths.filter("depth = length").select("conv_id", *NODE).repartitionByRange(cells_for(n), "conv_id").withColumn("part", F.spark_partition_id())
    blocks = durable(ends, "trie-ends").groupBy(*NODE, "part").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("said"))  # a range's rows at most
    return durable(blocks.repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(_streamed, "depth long, a long, b long, ends_sha256 string"), "trie-digests")


def trie(turns: DataFrame, graft: tuple[int, int] | None = None, **columns: str) -> DataFrame:
    """A row a node: conv_id (its owner), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    (bytes of turns below and at the node that sharing saves), ends_sha256 (of the conversations that end there).

    graft: (every, most) of `grafted`. columns: names, as `ordered` takes them.
    """
    with scratch(turns.sparkSession) as scope:
        rows = ordered(turns, **columns)
        found, convs = plain(rows) if graft is None else grafted(rows, *graft)
        convs = durable(convs, "trie-lengths")
        paths = _paths(found, convs)
        starts = _starts(paths, convs)
        facts = durable(paths.select("conv_id", "cell").distinct().join(starts.select("conv_id", "start", "leaf", "upto"), "conv_id"), "trie-cell-starts")
        each = paths.join(facts, ["conv_id", "cell"])
        n = lambda x: F.count_if(x).cast("long")
        saved: Column = F.greatest(F.lit(0).cast("long"), F.col("upto") - F.col("before"))
        nodes = durable(each.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            n((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("start"))).alias("n_children"), n(F.col("leaf")).alias("n_leaves"), F.sum(saved).alias("saved_tokens")), "trie-nodes")
        above = durable(_parents(nodes, starts), "trie-parents")
        made = nodes.join(above, ["conv_id", "depth"], "left").join(_ends(paths, starts.count()), NODE, "left")
        parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
        none = F.sha2(F.lit("").cast("binary"), 256)
        return scope.keep(made.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")), "trie")
