"""URL filters over a sorted digest array.

Rules and listed hosts are keys `host` + `path prefix`. The 64-bit xxhash of every key stands in one sorted array, in a
file that Spark sends to each machine once and that tasks map into memory, beside the stored strings; a URL probes the
keys that could fit it (its host and the host's parents, each with the path cut at the prefix lengths that occur) by
vectorised binary search, and each hit is confirmed against the stored full string, so that a collision of digests
never decides. The longest key that fits wins; a listed host (a key without a rule) counts only where no rule fits.

Defined results: the host is what stands between the first "://" and the next "/", "?", "#" or the end, A-Z
lower-cased; the path goes on up to "?", "#" or the end; a null URL or one without "://" has an empty host and
path, fits nothing and is allowed; repeated rows get the same answer, each its own; an empty index allows everything;
of several entries of a key the first counts (`judge_by_join`: the one that comes first in order); columns besides the
URL are kept as they are, but one named `judged` is replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.tables import durable, fresh, shared_dir

#: An index of more keys is not built on the driver; `judge_entries` then joins.
MOST_KEYS = 4_000_000


def lowered(host: str) -> str:
    """A-Z lower-cased and nothing else."""
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def key_of(rule: str) -> str:
    """A rule such as `example.com/en/7` as a key: the host, a blank, the path prefix."""
    host, slash, path = rule.partition("/")
    return f"{lowered(host)} {slash}{path}"


def split(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return lowered(host), path


@dataclass
class Index:
    """Sorted digests, and per digest the key's string, rule and verdict, in the same order."""

    digests: Sequence[int] = ()
    entries: list[tuple[str, str | None, str]] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, entries: Iterable[tuple[str, str | None, str]]) -> Index:
        """From (key, rule, verdict); the first entry of a key counts."""
        from xxhash import xxh64_intdigest

        first: dict[str, tuple[str, str | None, str]] = {}
        for entry in entries:
            first.setdefault(entry[0], entry)
        ordered = sorted((xxh64_intdigest(k.encode("utf-8", "surrogatepass")), k) for k in first)
        return cls([d for d, _ in ordered], [first[k] for _, k in ordered], lengths_of(first))

    def file(self) -> bytes:
        """Number of keys, digests, ends of the strings, strings: what `Mapped` reads."""
        import numpy as np

        strings = [json.dumps(e).encode() for e in self.entries]
        ends = np.cumsum([0, *map(len, strings)])
        return b"".join((np.array([len(strings)], "<u8").tobytes(), np.array(self.digests, "<u8").tobytes(), ends.astype("<u8").tobytes(), *strings))

    def send(self, spark: SparkSession) -> str:
        """Write the file to the shared folder and have Spark send it to every machine; its name there."""
        name = f"tidemark-urls-{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{name}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        data = self.file()
        for k in range(0, len(data), 1 << 22):
            out.write(data[k : k + (1 << 22)])
        out.close()
        spark.sparkContext.addFile(path)
        return name


class Mapped:
    """A sent file in mapped memory: pages are read when they are needed and shared by all workers of a machine."""

    def __init__(self, path: str):
        import numpy as np

        n = int(np.fromfile(path, "<u8", 1)[0])
        self.digests = np.memmap(path, "<u8", "r", 8, (n,)) if n else np.empty(0, "<u8")
        self.ends = np.memmap(path, "<u8", "r", 8 + 8 * n, (n + 1,))
        self.strings = np.memmap(path, np.uint8, "r", 16 + 16 * n) if n else b""

    def entry(self, at: int) -> tuple[str, str | None, str]:
        return tuple(json.loads(bytes(self.strings[int(self.ends[at]) : int(self.ends[at + 1])])))


_mapped: dict[str, Mapped] = {}


def mapped(name: str) -> Mapped:
    """The file of that name, mapped once in this worker."""
    if name not in _mapped:
        _mapped[name] = Mapped(SparkFiles.get(name))
    return _mapped[name]


def lengths_of(keys: Iterable[str]) -> list[int]:
    """The lengths of path prefixes that occur."""
    return sorted({len(k.partition(" ")[2]) for k in keys})


def candidates(host: str, path: str, lengths: Sequence[int]) -> list[str]:
    """Keys that could fit."""
    if not host:
        return []
    labels = host.split(".")
    return [f"{'.'.join(labels[i:])} {path[:n]}" for i in range(len(labels)) for n in lengths if n <= len(path)]


def probe(index: Mapped, lengths: Sequence[int], urls: list[tuple[str, str]]) -> list[tuple[str, str | None, str] | None]:
    """For each (host, path) the entry of the longest key that fits, None without one."""
    import numpy as np
    from xxhash import xxh64_intdigest

    per = [candidates(h, p, lengths) for h, p in urls]
    asked = [k for keys in per for k in keys]
    best: list = [None] * len(urls)
    rank = lambda e: (e[1] is not None, len(e[0])) if e else (False, -1)
    digests = index.digests
    if not asked or not len(digests):
        return best
    of = np.repeat(np.arange(len(urls)), [len(k) for k in per])
    d = np.fromiter((xxh64_intdigest(k.encode("utf-8", "surrogatepass")) for k in asked), np.uint64, len(asked))
    low = np.searchsorted(digests, d, "left")
    for i in np.flatnonzero((low < len(digests)) & (digests[np.minimum(low, len(digests) - 1)] == d)):
        at = int(low[i])
        while at < len(digests) and digests[at] == d[i]:  # equal digests of different keys stand side by side
            entry = index.entry(at)
            if entry[0] == asked[i] and rank(entry) > rank(best[of[i]]):
                best[of[i]] = entry
            at += 1
    return best


def judge(urls: DataFrame, index: Index, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`urls` with a struct `judged`: host, path, rule and verdict."""
    name, lengths = index.send(urls.sparkSession), index.lengths

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(column: pd.Series) -> pd.DataFrame:
        parts = [split(None if u is None or u != u else u) for u in column]
        found = [e or ("", None, default) for e in probe(mapped(name), lengths, parts)]
        return pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": pd.Series([e[1] for e in found], dtype=object), "verdict": [e[2] for e in found]})

    return urls.withColumn("judged", judged(F.col(url_col).cast("string")))


def judge_entries(urls: DataFrame, entries: DataFrame, url_col: str = "url", default: str = "allow", most: int = MOST_KEYS) -> DataFrame:
    """The same over a table of entries (key, rule, verdict) of any size: mapped up to `most` keys, joined beyond."""
    first = durable(entries.groupBy("key").agg(F.min(F.struct(F.col("rule").isNull(), "rule", "verdict")).alias("e")).select("key", "e.rule", "e.verdict"), "url-keys")
    if first.count() <= most:
        return judge(urls, Index.build(tuple(r) for r in first.toLocalIterator()), url_col, default)
    prefixes = first.select(F.length(F.regexp_extract("key", "(?s)^[^ ]* (.*)$", 1)).alias("n")).distinct().collect()  # lengths: few
    return judge_by_join(urls, first, sorted(r["n"] for r in prefixes), url_col, default)


def judge_by_join(urls: DataFrame, entries: DataFrame, lengths: Sequence[int], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same by a join of candidates with `entries` (key, rule, verdict) on digest and string.

    Each distinct URL is judged once and its answer goes back to all rows that have it. `lengths`: see lengths_of.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(u, *split(u), k) for u in batch.column(0).to_pylist() for k in candidates(*split(u), lengths) or [None]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(4)], names=["url", "host", "path", "key"])

    own = F.coalesce(F.col(url_col).cast("string"), F.lit(""))  # neither has a host
    asked = urls.select(own.alias("url")).distinct().mapInArrow(run, "url string, host string, path string, key string").withColumn("digest", F.xxhash64("key"))
    known = entries.select("key", "rule", "verdict", F.xxhash64("key").alias("digest"))
    hit = asked.join(known, ["digest", "key"], "left")
    found = F.struct(F.col("rule").isNotNull().alias("by_rule"), F.length("key").alias("n"), "rule", "verdict")
    best = hit.groupBy("url", "host", "path").agg(F.max(F.when(F.col("verdict").isNotNull(), found)).alias("best"))
    of = fresh("_of", urls)
    answer = best.select(F.col("url").alias(of), F.struct("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).alias("judged"))
    return urls.drop("judged").withColumn(of, own).join(answer, of).drop(of)
