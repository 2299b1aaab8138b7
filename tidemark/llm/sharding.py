"""Sharding by balanced label propagation.

Documents start in shards dealt by a hash of their id. Documents that share a key, here equal texts, are linked: those of
one shard are a node (so a group has as many nodes as shards at most, however many rows it has), each node is linked to the
group's largest, and links pull by the rows at their other end, against a node's own rows. Rounds of joins then move
nodes: they ask for the shard that most of their links lead to, and between two shards as much goes one way as the other,
what gains most first, plus what room is free. Rounds go on until nothing moves, or until the weight of cut links has not
fallen below its least for PATIENCE rounds; the labels with the least count.

Over a table of further links groups are the nodes, and half of them ask at a time, by a hash, as neighbours that pull each
other alike would change places for ever. Labels of single nodes only creep along long paths, so nodes are first
merged into clusters: in each round half of them propose to the neighbour that most links lead to, and are taken while the
cluster stays below a share of a shard, until nothing merges. Clusters are placed whole and the rounds start from there.

Then quotas are made exact. Groups go where most of their rows have been led. These wishes meet as counts by size and
shard, and are granted from large to small, each group whole, while a shard's quota lasts; a group that is refused goes to
the fullest shard that still holds it. Hot groups neither move nor wish: they go where they fit best, so that little ones
don't take the room that only they need. What no shard can hold, fewer than two groups a shard, is split last, over the
shards with most room. Unlinked rows stay while their shard has room and fill the others from there. Row counts of shards
differ by one at most (law `rows`).

Built of DataFrame functions only. Defined results: null texts are one group of size 1 each and links of theirs are
ignored; empty texts are equal texts; repeated rows are linked; a link to an id that no row has, or of a document to
itself, is ignored, repeated links add up, and a link of a repeated id is one of all its texts; an empty table gives no
rows; columns besides id and text are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cells_for, durable, prefix, scratch

#: A group with more than one in so many rows of a shard counts as hot.
HOT_SHARE = 8
#: Parts of a split group when its rows are ranked.
SALTS = 64
#: Rounds without a new least cut after which propagation ends, and rounds without a merge after which clusters are done.
PATIENCE, STILL = 4, 4
#: A cluster holds at most one in so many rows of a shard.
CLUSTER_SHARE = 4

PLAN = "_size long, _to int, _from long, _until long, _home int"
PARTS = "_cut int, _from long, _until long, _part int"


def _salt(n: int) -> Column:
    return F.pmod(F.xxhash64("_id", "_tie", "_row"), F.lit(n))


def plan(wishes: dict[tuple[int, int], int], quota: list[int]) -> tuple[list[tuple[int, int, int, int, int | None]], list[int]]:
    """Rows (see PLAN) and the room left by shard. wishes: groups by (members, shard asked for).

    Groups of a size that ask for a shard, with ranks from _from to _until - 1, go to _home; where it is None, no
    shard holds them. Rooms only shrink and sizes only fall, so none of them would fit later either.
    """
    room, rows, most = list(quota), [], max(quota) // HOT_SHARE
    for size in sorted({size for size, _ in wishes}, reverse=True):
        refused = []
        for to in range(len(room)):
            count = wishes.get((size, to), 0)
            granted = min(count, room[to] // size) if size <= max(1, most) else 0
            if granted:
                rows.append((size, to, 0, granted, to))
                room[to] -= granted * size
            if granted < count:
                refused.append((to, granted, count))
        for to, rank, count in refused:
            for t in sorted(range(len(room)), key=room.__getitem__):
                n = min(count - rank, room[t] // size)
                if n:
                    rows.append((size, to, rank, rank + n, t))
                    room[t] -= n * size
                    rank += n
            if rank < count:
                rows.append((size, to, rank, count, None))
    return rows, room


def split(members: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Parts (see PARTS) of groups that no shard holds, by their place in `members`, in the shards with most room."""
    room, rows = list(room), []
    for key, size in enumerate(members):
        at = 0
        for t in sorted(range(len(room)), key=lambda t: -room[t]):
            n = min(size - at, room[t])
            if n:
                rows.append((key, at, at + n, t))
                room[t] -= n
                at += n
    return rows


def allowed(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How much may go from shard to shard, of what wants to: as much as comes back, and a share of the room that is free."""
    more = {k: n - min(n, flows.get(k[::-1], 0)) for k, n in flows.items()}
    wanted = [sum(n for (_, to), n in more.items() if to == t) for t in range(len(room))]
    return {(f, t): n - more[f, t] + (more[f, t] * min(room[t], wanted[t]) // wanted[t] if wanted[t] else 0) for (f, t), n in flows.items()}


def _both_ways(links: DataFrame) -> DataFrame:
    """(node, other, weight) of links (a, b, weight), each way, repeated ones added up; stored."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").union(links.select("b", "a", "weight")).filter("node != other")
    return durable(both.groupBy("node", "other").agg(F.sum("weight").alias("weight")), "shards-links")


def propagate(nodes: DataFrame, both: DataFrame, quota: list[int], halves: int = 2) -> DataFrame:
    """Nodes (node, size, shard) with the shards that label propagation leads them to; stored.

    both: stored links (node, other, weight), by which `other` pulls `node`; a node may pull itself. One in `halves` nodes
    asks in a round.
    """
    spark = nodes.sparkSession
    nodes = best = durable(nodes, "shards-nodes")
    still, turn, least, since, alone = 0, 0, None, 0, None
    while still < halves:  # no part has anything to move
        labels = nodes.select(F.col("node").alias("other"), F.col("shard").alias("at"))
        pulls = both.join(labels, "other").groupBy("node", "at").agg(F.sum("weight").alias("pull")).join(nodes, "node")
        stay = F.when(F.col("at") == F.col("shard"), F.col("pull"))
        best_of = F.max(F.struct("pull", F.xxhash64("node", "at").alias("tie"), "at")).alias("best")
        pulls = durable(pulls.groupBy("node", "size", "shard").agg(best_of, F.coalesce(F.max(stay), F.lit(0.0)).alias("stay"), F.sum("pull").alias("all")), "shards-pulls")
        turn += 1
        asking = (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(halves)) == 0) & (F.col("best.pull") > F.col("stay"))
        seen = pulls.groupBy("shard", F.when(asking, F.col("best.at")).alias("to")).agg(F.sum("size").alias("n"), F.sum(F.col("all") - F.col("stay")).alias("cut")).collect()  # a row for two shards
        load = [sum(r["n"] for r in seen if r["shard"] == t) for t in range(len(quota))]
        if alone is None:  # nodes without a link stay where they are
            every = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
            alone = [every.get(t, 0) - n for t, n in enumerate(load)]
        cut = sum(r["cut"] for r in seen)
        least, best, since = (cut, nodes, 0) if least is None or cut < least else (least, best, since + 1)
        if since > PATIENCE:
            break
        flows = {(r["shard"], r["to"]): r["n"] for r in seen if r["to"] is not None}
        grants = allowed(flows, [max(0, q - a - n) for q, a, n in zip(quota, alone, load, strict=True)])
        still = 0 if any(grants.values()) else still + 1
        if not any(grants.values()):
            continue
        known = F.broadcast(spark.createDataFrame([(f, t, n) for (f, t), n in grants.items()], "out int, to int, most long").coalesce(1))  # a row for two shards
        asks = pulls.filter(asking).select("node", "size", F.col("shard").alias("out"), F.col("best.at").alias("to"), ((F.col("best.pull") - F.col("stay")) / F.col("size")).alias("gain"))
        level = F.floor(-F.log2(F.col("gain"))).cast("int")  # large gains first; a level's asks in any order
        before = prefix(asks, ["out", "to"], F.struct(level.alias("a"), F.pmod(F.xxhash64("node"), F.lit(64)).alias("b")), [F.col("node")], "_before", F.col("size"))
        moves = before.join(known, ["out", "to"]).filter(F.col("_before") + F.col("size") <= F.col("most")).select("node", F.col("to").alias("_to"))
        nodes = durable(nodes.join(moves, "node", "left").select("node", "size", F.coalesce("_to", "shard").alias("shard")), "shards-nodes")
    return best


def clusters(nodes: DataFrame, both: DataFrame, most: int) -> DataFrame:
    """(node, size, cluster) of nodes (node, size) over stored links (node, other, weight) each way: clusters of linked nodes,
    none merged beyond `most`; stored.

    A cluster is named by one of its nodes. In a round each cluster is, by a hash, one that proposes or one that takes, so
    that no proposals form a chain.
    """
    members = durable(nodes.select("node", "size", F.col("node").alias("cluster")), "shards-clusters")
    still, turn = 0, 0
    while still < STILL:
        turn += 1
        totals = durable(members.groupBy("cluster").agg(F.sum("size").alias("n")), "shards-totals")
        of = members.select("node", "cluster")
        between = both.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("cluster").alias("to")), "other").filter("cluster != to")
        proposes = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0  # noqa: B023, E731  used in this round
        between = between.filter(proposes("cluster") & ~proposes("to")).groupBy("cluster", "to").agg(F.sum("weight").alias("weight"))
        sized = between.join(totals, "cluster").join(totals.select(F.col("cluster").alias("to"), F.col("n").alias("there")), "to").filter(F.col("n") + F.col("there") <= most)
        asks = sized.groupBy("cluster", "n").agg(F.max(F.struct("weight", (-F.col("there")).alias("room"), F.xxhash64("to").alias("tie"), "to", "there")).alias("best"))
        asks = durable(asks.select("cluster", "n", "best.to", "best.there"), "shards-proposals")
        # A taker hears the first of its proposers in the order of a hash, as many as fit; it may have very many.
        before = prefix(asks, ["to"], F.pmod(F.xxhash64("cluster"), F.lit(64)), [F.col("cluster")], "_before", F.col("n"))
        moves = durable(before.filter(F.col("_before") + F.col("n") + F.col("there") <= most).select("cluster", F.col("to").alias("_to")), "shards-merges")
        if moves.limit(1).count():
            still = 0
            members = durable(members.join(moves, "cluster", "left").select("node", "size", F.coalesce("_to", "cluster").alias("cluster")), "shards-clusters")
        else:
            still += 1
    return members


def _homes(groups: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """(_group, _size, _home) of stored groups (_group, _size, _to), -1 where no shard holds them, stored; and the room left by shard."""
    spark = groups.sparkSession
    wishes = {(r["_size"], r["_to"]): r["count"] for r in groups.groupBy("_size", "_to").count().collect()}  # the sizes add up to the rows at most, so there are few
    granted, room = plan(wishes, quota)
    ranked = prefix(groups, ["_size", "_to"], F.pmod(F.xxhash64("_group"), F.lit(cells_for(sum(wishes.values())))), [F.col("_group")], "_nth")
    known = spark.createDataFrame(granted, PLAN).coalesce(1)
    within = (F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_until"))
    return durable(ranked.join(known, ["_size", "_to"]).filter(within).select("_group", "_size", F.coalesce("_home", F.lit(-1)).alias("_home")), "shards-homes"), room


def _led(by_shard: DataFrame, quota: list[int]) -> DataFrame:
    """Groups (_group, _size, _to) of more than one row, led together by propagation over their nodes (_group, shard, _n)."""
    hot = max(1, max(quota) // HOT_SHARE)
    groups = by_shard.groupBy("_group").agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_parts"), F.max_by("shard", F.struct(F.col("_n"), F.xxhash64("_group", "shard"))).alias("_to"))
    groups = durable(groups.filter("_size > 1"), "shards-groups")
    apart = groups.filter((F.col("_parts") > 1) & (F.col("_size") <= hot)).select("_group", F.col("_to").alias("_hub"))
    parts = durable(by_shard.join(apart, "_group"), "shards-parts")
    node = lambda at: F.struct("_group", F.col(at).alias("of"))
    hubs = parts.filter("shard = _hub").select("_group", (F.col("_n") + 0.5).alias("_weight"))  # of two alike the hub stays
    own, hub, n = node("shard"), node("_hub"), F.col("_n").cast("double")
    pull = lambda of, to, weight: F.struct(of.alias("node"), to.alias("other"), weight.alias("weight"))
    pulls = F.when(F.col("shard") == F.col("_hub"), F.array(pull(own, own, F.col("_weight")))).otherwise(F.array(pull(own, own, n), pull(own, hub, F.col("_weight")), pull(hub, own, n)))
    links = durable(parts.join(hubs, "_group").select(F.inline(pulls)), "shards-links")
    led = propagate(parts.select(own.alias("node"), F.col("_n").alias("size"), "shard"), links, quota, halves=1)
    fullest = led.select("node._group", "size", "shard").groupBy("_group", "shard").agg(F.sum("size").alias("_n")).groupBy("_group").agg(F.max_by("shard", F.struct(F.col("_n"), F.xxhash64("_group", "shard"))).alias("_led"))
    return durable(groups.join(fullest, "_group", "left").select("_group", "_size", F.coalesce("_led", "_to").alias("_to")), "shards-led")


def _linked(rows: DataFrame, by_shard: DataFrame, quota: list[int], links: DataFrame) -> DataFrame:
    """Groups (_group, _size, _to) that hold several rows or a link, led by clusters and propagation over links of ids."""
    fullest = F.max_by("shard", F.struct(F.col("_n"), F.xxhash64("_group", "shard")))
    of = rows.filter(F.col("_group").isNotNull() & F.col("_id").isNotNull()).select("_id", "_group").distinct()
    edges = links.join(of.select(F.col("_id").alias("a"), F.col("_group").alias("_a")), "a").join(of.select(F.col("_id").alias("b"), F.col("_group").alias("_b")), "b")
    edges = durable(edges.filter("_a != _b").groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("weight").cast("double").alias("weight")), "shards-edges")
    far = edges.select(F.col("a").alias("_group")).union(edges.select("b")).distinct().withColumn("_far", F.lit(True))
    groups = by_shard.groupBy("_group").agg(F.sum("_n").alias("_size"), fullest.alias("_to"))
    groups = durable(groups.join(far, "_group", "left").filter("_size > 1 or _far"), "shards-groups")
    both = _both_ways(edges)
    merged = clusters(groups.select(F.col("_group").alias("node"), F.col("_size").alias("size")), both, max(1, max(quota) // CLUSTER_SHARE))
    placed = merged.join(groups.select(F.col("_group").alias("node"), "_to"), "node")
    whole = placed.groupBy("cluster", "_to").agg(F.sum("size").alias("_n")).groupBy(F.col("cluster").alias("_group")).agg(F.sum("_n").alias("_size"), F.max_by("_to", F.struct(F.col("_n"), F.xxhash64("cluster", "_to"))).alias("_to"))
    homes, _ = _homes(durable(whole, "shards-whole-clusters"), quota)
    start = placed.join(homes.filter("_home >= 0").select(F.col("_group").alias("cluster"), "_home"), "cluster", "left")
    led = propagate(start.select("node", "size", F.coalesce("_home", "_to").alias("shard")), both, quota)
    return durable(led.select(F.col("node").alias("_group"), F.col("size").alias("_size"), F.col("shard").alias("_to")), "shards-led")


def _move(rows: DataFrame, quota: list[int], links: DataFrame | None) -> DataFrame:
    """Rows, linked ones in the shard of their group, with _linked. No shard gets more linked rows than its quota."""
    spark = rows.sparkSession
    by_shard = rows.filter(F.col("_group").isNotNull()).groupBy("_group", "shard").agg(F.count(F.lit(1)).alias("_n"))
    groups = _led(by_shard, quota) if links is None else _linked(rows, by_shard, quota, links)
    homes, room = _homes(groups, quota)
    cut = homes.filter("_home < 0").withColumn("_cut", F.row_number().over(Window.orderBy(F.desc("_size"), "_group")) - 1)  # fewer than two a shard
    cut = durable(cut.select("_group", "_size", "_cut"), "shards-cut")
    sizes = [r["_size"] for r in cut.orderBy("_cut").collect()]
    moved = rows.join(homes.select("_group", "_home"), "_group", "left").withColumn("_linked", F.col("_home").isNotNull())
    moved = moved.withColumn("shard", F.when(F.col("_home") >= 0, F.col("_home")).otherwise(F.col("shard")))
    if not sizes:
        return moved.drop("_home")
    moved = durable(moved, "shards-whole")
    whole = moved.filter("_home is null or _home >= 0")
    parts = F.broadcast(spark.createDataFrame(split(sizes, room), PARTS).coalesce(1))  # fewer than two groups a shard, each in as many parts as shards at most
    rest = prefix(moved.filter("_home < 0").join(F.broadcast(cut.drop("_size")), "_group"), ["_cut"], _salt(SALTS * cells_for(sum(sizes))), [F.col("_id"), F.col("_tie"), F.col("_row")], "_nth")
    rest = rest.join(parts, "_cut").filter((F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_until"))).withColumn("shard", F.col("_part"))
    return whole.unionByName(rest.select(whole.columns)).drop("_home")


def _deal(rows: DataFrame, quota: list[int]) -> DataFrame:
    """Exact quotas: rows that rank beyond their shard's quota, unlinked ones, fill the shards that have room. Adds slot."""
    rows = durable(rows, "shards-moved")
    shards = len(quota)
    count = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}  # one row a shard
    count = [count.get(t, 0) for t in range(shards)]
    over = [max(0, count[t] - quota[t]) for t in range(shards)]
    free = [max(0, quota[t] - count[t]) for t in range(shards)]
    of = lambda values, at: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), at.cast("int") + 1)
    n = cells_for(sum(count)) * 4
    bucket = F.when(F.col("_linked"), 0).otherwise(n) + _salt(n)
    ranked = prefix(rows, ["shard"], bucket, [F.col("_id"), F.col("_tie"), F.col("_row")], "_rank")
    beyond = F.col("_rank") - of(quota, F.col("shard"))
    nth = beyond + of([0, *accumulate(over)][:shards], F.col("shard"))
    ends = list(accumulate(free))
    fill = sum(((nth >= e).cast("int") for e in ends), F.lit(0))
    placed = ranked.withColumn("_fill", F.when(beyond >= 0, F.least(fill, F.lit(shards - 1)))).withColumn("_nth", nth)
    starts, kept = [0, *ends][:shards], [min(count[t], quota[t]) for t in range(shards)]
    slot = F.when(F.col("_fill").isNull(), F.col("_rank")).otherwise(of(kept, F.col("_fill")) + F.col("_nth") - of(starts, F.col("_fill")))
    return placed.select("_id", "size", "text_crc32", F.coalesce("_fill", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", group: Column | None = None, links: DataFrame | None = None) -> DataFrame:
    """Every row with size, text_crc32, shard and slot (its place in the shard, from 0 without gaps).

    `group`: the key that linked rows share, a Column over `docs`; equal texts where none is given. `links`: further
    links between ids (a, b, weight).
    """
    with scratch(docs.sparkSession) as scope:
        return scope.keep(_sharded(docs, shards, id_col, text_col, group, links), "shards")


def _sharded(docs: DataFrame, shards: int, id_col: str, text_col: str, group: Column | None, links: DataFrame | None) -> DataFrame:
    octets = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(octets), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(octets, F.lit("").cast("binary"))).alias("text_crc32"),
        (F.unhex(F.sha2(octets, 256)) if group is None else group).alias("_group"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = rows.withColumn("_tie", F.xxhash64("_group", "size")).withColumn("shard", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(shards)).cast("int"))
    rows = durable(rows, "shards-rows")
    total = rows.count()
    quota = [total // shards + (t < total % shards) for t in range(shards)]
    return _deal(_move(rows, quota, links), quota).withColumnRenamed("_id", id_col)


def cut_weight(placed: DataFrame, links: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Weight of all links between placed ids, and of those between shards."""
    side = lambda x: placed.select(F.col(id_col).alias(x), F.col("shard").alias(f"_{x}"))
    return links.join(side("a"), "a").join(side("b"), "b").agg(F.sum("weight").alias("weight"), F.sum(F.when(F.col("_a") != F.col("_b"), F.col("weight")).otherwise(0)).alias("cut"))


def cut_links(placed: DataFrame, group_cols: list[str]) -> DataFrame:
    """How many rows of groups stand outside the shard that holds most of their group."""
    by = placed.groupBy(*group_cols, "shard").agg(F.count(F.lit(1)).alias("n")).groupBy(*group_cols).agg((F.sum("n") - F.max("n")).alias("cut"), F.sum("n").alias("n"))
    return by.agg(F.sum("cut").alias("cut"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("linked"))
