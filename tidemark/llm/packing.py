"""Best-fit packing, planned over the histogram of lengths.

Documents are encoded and cut into pieces of at most `capacity` tokens. The plan works on counts: lengths from
long to short, each dealt to the open sequences with the least room that still holds it, whole groups of equal
sequences at a time. Pieces then find their place by joining on their rank within their length.

Defined results: a null or empty text is one piece that holds only the end mark; every row is packed, repeated
ones each on their own; an empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cells_for, durable, encoder, prefix

PLAN = "length long, rank_from long, rank_to long, first_sequence long, per_sequence long, first_offset long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows: see PLAN.

    Pieces of a length with ranks from rank_from to rank_to - 1 go, per_sequence each, to the sequences from
    first_sequence on, side by side from first_offset. A sequence that is the best fit for a length stays the
    best fit while it holds more of that length, so a group of equal sequences is served in one step.
    """
    rows, following = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: runs of sequences (first, number)
    sizes: list[int] = []  # the keys of room, in order

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                insort(sizes, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[at]
            else:
                left, first = capacity, following
                n = -(-(count - rank) // (capacity // length))
                following += n
            per = left // length
            whole = min(n, (count - rank) // per)
            if whole:
                rows.append((length, rank, rank + whole * per, first, per, capacity - left))
                put(left - per * length, first, whole)
                rank += whole * per
            if whole < n and rank < count:  # the rest goes into one sequence
                some = count - rank
                rows.append((length, rank, count, first + whole, some, capacity - left))
                put(left - some * length, first + whole, 1)
                rank, whole = count, whole + 1
            put(left, first + whole, n - whole)
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32. Only the first piece may be shorter."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    mark = end.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer).column
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, x in enumerate(encode(batch.column(1))):
                ids = bytes(x) + mark
                n = len(ids) // 4
                first = n - capacity * ((n - 1) // capacity)
                for k, (a, b) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n], strict=True)):
                    of.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset. The plan has a few rows a length, at most `capacity` lengths."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, tokenizer, capacity, end, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan(counts, capacity), PLAN).coalesce(1)
    rank_order = [F.col(id_col), F.col("piece"), F.col("ids_crc32"), F.col("start")]
    n_cells = cells_for(sum(counts.values()))
    ranked = prefix(cut, ["length"], F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(n_cells)), rank_order, "_rank")
    at = (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & at)
    nth = F.col("_rank") - F.col("rank_from")
    return placed.select(
        id_col,
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("per_sequence")) * F.col("length")).alias("offset"),
    )
