"""What several operators share: durable tables, distributed prefix sums, words, tokenizer ids."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.tables import discard, durable, fresh, scratch

__all__ = ["WORD", "Encoder", "cells_for", "discard", "durable", "encoder", "fresh", "prefix", "read", "scratch", "words_of"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prefix(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str, value: Column | None = None) -> DataFrame:
    """Add `out`: the sum of `value` (default: the count of rows) over the rows of the same `keys` that come before.

    Rows come in the order of (bucket, *order); `bucket` deals the rows of one key to many tasks, so that
    a hot key is never sorted in one. Only the totals of (keys, bucket) meet, one row for each. `df` is read
    twice, so hand in a durable table. Key columns must not be null.
    """
    what = F.lit(1).cast("long") if value is None else value
    rows = df.withColumn("_prefix_bucket", bucket)
    cells = rows.groupBy(*keys, "_prefix_bucket").agg(F.sum(what).alias("_prefix_cell"))
    earlier = Window.partitionBy(*keys).orderBy("_prefix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*keys, "_prefix_bucket", F.coalesce(F.sum("_prefix_cell").over(earlier), F.lit(0).cast("long")).alias("_prefix_before"))
    inner = Window.partitionBy(*keys, "_prefix_bucket").orderBy(*order)
    if value is None:
        within = F.row_number().over(inner).cast("long") - 1
    else:
        within = F.coalesce(F.sum(what).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    joined = rows.withColumn("_prefix_within", within).join(offsets, [*keys, "_prefix_bucket"])
    return joined.withColumn(out, F.col("_prefix_before") + F.col("_prefix_within")).drop("_prefix_bucket", "_prefix_within", "_prefix_before")


def cells_for(rows: int, per_cell: int = 100_000, least: int = 16, most: int = 1 << 16) -> int:
    """Into how many buckets `prefix` should deal a key that may hold all `rows`."""
    return max(least, min(most, rows // per_cell))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() splits at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_SPACES = re.compile(r" \s")


class _Kept(dict):
    """Values by key, computed when missing. Keys of up to `LONGEST` characters are kept; beyond `most` of them or
    `most_bytes`, those not used lately go, so that two tables of that size are held at most."""

    LONGEST = 64

    def __init__(self, compute, most: int, most_bytes: int = 20 << 20):
        super().__init__()
        self.compute, self.most, self.most_bytes, self.older, self.held = compute, most, most_bytes, {}, 0

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.compute(key)
            if len(key) > self.LONGEST:
                return value
        self.held += 200 + 2 * len(key)  # two objects and their places; longer ones differ by little
        if len(self) >= self.most or self.held > self.most_bytes:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, by a tokenizers file with byte-level BPE.

    The pre-tokenizer always breaks before a space that stands between two other characters, and after an ASCII letter
    before another ASCII character, so a text without " " before white space is the concatenation of its pieces cut
    there. A column's texts are cut and its pieces numbered in Arrow; the model of the tokenizer computes the ids of each
    different piece once. Pieces are kept in bounded tables, the last used ones longest. Other texts, those that contain
    an added token's string, and those with a character that Python's tables don't assign, whose class the pattern and
    the tokenizer may see differently, are encoded as a whole by the tokenizer.
    """

    CHUNK, HELD = 4 << 20, 12 << 20  # bytes of text looked at together, of pieces kept with their ids

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        added = sorted(t.content.encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile(b"|".join(map(re.escape, added)) or rb"(?!)").finditer
        self.model = self.tokenizer.model
        self.cut = regex.compile(PATTERN).findall
        # The printable form of byte-level BPE: printable bytes stand for themselves, others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        shown = {b: chr(256 + i) for i, b in enumerate(others)}
        self.printable = "".join(shown.get(b, chr(b)) for b in range(256))
        self.space = self.printable[32]
        self.letter = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
        self.other = np.array([not chr(b).isalpha() and b < 128 for b in range(256)])
        self.assigned = _Kept(lambda c: unicodedata.category(c) != "Cn", 0x20000)
        self.tokens = _Kept(self._of_pretoken, most)
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _of_shown(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _of_pretoken(self, text: str) -> bytes:
        return self._of_shown(text.encode("utf-8").decode("latin-1").translate(self.printable))

    def _of_piece(self, piece: str) -> bytes | None:
        """None: the text that holds it is encoded as a whole. Letters are one pre-token with the space before them."""
        if piece[0] == " ":
            word = piece[1:]
            if word.isalpha():
                return self._of_shown(self.space + word) if word.isascii() else self._of_pretoken(piece)
            if not word or _SPACES.match(piece):
                return None
        if not (piece.isascii() or all(map(self.assigned.__getitem__, set(piece)))):
            return None
        return b"".join(map(self.tokens.__getitem__, self.cut(piece)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def column(self, texts) -> Iterator[bytes | memoryview]:
        """Ids of every text of an Arrow array of strings; a null is empty. Its end gives back what Arrow holds for later:
        a worker lives on through the stages that follow."""
        import numpy as np
        import pyarrow as pa

        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + self.CHUNK, "right")) - 1)
            if ends[b] == ends[a]:
                yield from [b""] * (b - a)
            else:
                ids, edges, whole = self._chunk(texts.buffers()[2].slice(int(ends[a]), int(ends[b] - ends[a])), ends[a : b + 1] - ends[a])
                for i in range(b - a):
                    yield self._whole(texts[a + i].as_py()) if i in whole else ids[edges[i] : edges[i + 1]]
                del ids
            a = b
        pa.default_memory_pool().release_unused()

    def _chunk(self, data, bounds) -> tuple[memoryview, list[int], set[int]]:
        """The ids of texts that lie in `data` from bound to bound, where each text's begin, and the texts to encode whole."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        raw = np.frombuffer(data, np.uint8)
        starts = raw == 32
        starts[1:] |= self.letter[raw[:-1]] & self.other[raw[1:]]
        starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        at = np.append(np.flatnonzero(starts), len(raw)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data).dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy()
        table = 32 * len(pieces) >= len(self.known)  # to look few up in many costs more than to merge them again
        known, held = (self.known, self.ids) if table else (self.known[:0], self.ids[:0])
        place = pc.index_in(pieces, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(known) + np.arange(len(new))
        fresh = pieces.take(pa.array(new))
        ids = pa.concat_arrays([held, pa.array(map(self._of_piece, fresh.to_pylist()), pa.large_binary(), size=len(fresh))])
        taken = ids.take(pa.array(place[codes]))
        whole = {m.start() for m in self.added(data)}
        if taken.null_count:
            whole.update(at[:-1][taken.is_null().to_numpy(zero_copy_only=False)].tolist())
        rows = set((np.searchsorted(bounds, sorted(whole), "right") - 1).tolist())
        edges = np.frombuffer(taken.buffers()[1], np.int64)[np.searchsorted(at, bounds)].tolist()
        if table:
            self._keep(pa.concat_arrays([known, fresh]), ids, place)
        return memoryview(taken.buffers()[2] or b""), edges, rows

    def _keep(self, pieces, ids, used) -> None:
        """Keep short pieces up to the bounds; the used ones go behind the others, and the first ones are dropped."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rest = np.ones(len(pieces), bool)
        rest[used] = False
        order = np.concatenate([np.flatnonzero(rest), used])
        size = pc.binary_length(pieces).to_numpy()[order]
        held = pc.binary_length(ids).fill_null(-1).to_numpy()[order]
        fit = (held >= 0) & (size <= _Kept.LONGEST)
        order, size = order[fit], (size + held)[fit] + 12
        room = int(np.searchsorted(np.cumsum(size[::-1]), self.HELD, "right"))
        order = pa.array(order[max(0, len(order) - min(room, self.most)) :])
        self.known, self.ids = pieces.take(order), ids.take(order)

    def __call__(self, text: str) -> bytes:
        import pyarrow as pa

        return bytes(next(self.column(pa.array([text], pa.string()))))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; workers are reused, so a file is parsed once for each."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
