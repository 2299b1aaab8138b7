"""The bitemporal store: idempotent upserts, guards, point-in-time reads."""

from __future__ import annotations

import json
import time
import uuid
import zlib
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.exceptions import StorageError
from tidemark.functions.columns import known_on
from tidemark.schemas import OBSERVATION_KEY, OBSERVATIONS, RELEASE_DATES
from tidemark.tables import durable, scratch

COLUMNS = [c.strip().split(" ")[0] for c in OBSERVATIONS.split(",")]


def upserted(stored: DataFrame, batch: DataFrame, key=OBSERVATION_KEY, order: Column | None = None) -> DataFrame:
    """`stored` with `batch` written over it: per key the batch's row counts, among several its last by `order`.

    The end of a window is no part of the key, so a revision closes the window that was open.
    """
    last = F.lit(0) if order is None else order
    both = stored.withColumn("_new", F.lit(0)).withColumn("_order", F.lit(None).cast(batch.select(last.alias("o")).schema["o"].dataType)).unionByName(batch.withColumn("_new", F.lit(1)).withColumn("_order", last))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc_nulls_last("_order")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_new", "_order", "_rank")


def release_upserted(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Release dates are a set: what is there stays."""
    return stored.unionByName(batch).dropDuplicates(["release_id", "release_date"])


def batch_report(batch: DataFrame, *by: str) -> DataFrame:
    """(by, n_rows, historical, inverted): rows, rows known before they were fetched, inverted windows; one row without `by`."""
    return batch.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("realtime_start") < F.col("fetched_at").cast("date")).alias("historical"),
        F.count_if(F.col("realtime_end") < F.col("realtime_start")).alias("inverted"),
    )


def refusal(report, guarded: bool = True) -> str | None:
    """Why rows with such a report may not be stored: an inverted window or, guarded, nothing but today's display."""
    if report["inverted"]:
        return f"{report['inverted']} validity windows end before they start"
    if guarded and report["n_rows"] and not report["historical"]:
        return "no row of the batch has a historical window; display-only values are not stored"
    return None


def check_batch(batch: DataFrame, guarded: bool = True) -> int:
    """Rows of a batch that may be stored; raises where there is a refusal."""
    report = batch_report(batch).first()
    if why := refusal(report, guarded):
        raise StorageError(why)
    return report["n_rows"]


#: Bucket of the release dates.
RELEASES = -1


def segments_to_merge(sizes: list[int], most: int) -> int:
    """How many of a bucket's newest segments (sizes, oldest first) to merge: none up to `most`, else the newest two and
    every older one of at most twice what is merged already.

    Sizes of what stays fall by half at least from one to the next, so a row is rewritten as often as the logarithm of its bucket.
    """
    if len(sizes) <= most:
        return 0
    n, merged = 2, sum(sizes[-2:])
    while n < len(sizes) and sizes[-n - 1] <= 2 * merged:
        merged += sizes[-n - 1]
        n += 1
    return n


class Store:
    """Observations and release dates below a folder, as a log of buckets.

    Observations are dealt to `series_parts` x `date_parts` buckets by hashes of the series and of the date, so one series
    is written and read by many tasks, and a series, or a series and a date, names the few buckets that hold it. An upsert
    adds a segment, the batch's own rows, to the buckets that it touches and rewrites nothing. A reader takes buckets
    of one segment as they are, and of others the newest row of each key, by an aggregation within the bucket. Buckets of
    more than `most_segments` have their newest ones merged, by sizes, in the commit that makes them so.

    A manifest, written last and under a new number, says which segments count, so a job that fails leaves what was there
    and readers never see half a batch. Segments that a merge replaced, and manifests, stay for `keep_hours` (a reader of
    any manifest of that time finds its files) and go at the first commit after. One writer at a time: a commit fails if
    another manifest has been put in place since its start.
    """

    def __init__(self, spark, path: str, series_parts: int = 8, date_parts: int = 8, most_segments: int = 6, keep_hours: float = 24.0):
        self.spark, self.path = spark, path.rstrip("/")
        self.parts = [series_parts, date_parts]  # of a new store; one that is there keeps its own
        self.most_segments, self.keep_hours = most_segments, keep_hours

    # Files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _list(self, path: str) -> list:
        fs, at = self._fs(path)
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def manifests(self) -> list[int]:
        """Numbers of the manifests that can be read, the newest last."""
        return sorted(int(f.getPath().getName()) for f in self._list(f"{self.path}/manifests") if f.getPath().getName().isdigit())

    def exists(self) -> bool:
        return bool(self.manifests())

    def manifest(self, number: int | None = None) -> dict:
        """The newest manifest, or that of a number: parts, segments by bucket (folder, bytes), replaced folders and since when."""
        found = self.manifests()
        if number is None and not found:
            return {"number": 0, "parts": self.parts, "segments": {}, "replaced": {}}
        if number is not None and number not in found:
            raise StorageError(f"manifest {number} is not kept; there are {found}")
        fs, at = self._fs(f"{self.path}/manifests/{number or found[-1]:012d}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _written(self, version: str) -> dict[str, int]:
        """Bytes by bucket of a version, from one listing."""
        fs, at = self._fs(f"{self.path}/versions/{version}")
        files, found = fs.listFiles(at, True), {}
        while files.hasNext():
            f = files.next()
            bucket = f.getPath().getParent().getName().partition("_b=")[2]
            if bucket:
                found[bucket] = found.get(bucket, 0) + f.getLen()
        return found

    def _commit(self, was: dict, added: dict[str, tuple[str, int, int]]) -> None:
        """Put a manifest in place: `added` has by bucket a folder, its bytes, and how many of the newest segments it replaces."""
        now, segments = time.time(), {b: list(s) for b, s in was["segments"].items()}
        replaced = dict(was["replaced"])
        for bucket, (folder, size, n) in added.items():
            own = segments.setdefault(bucket, [])
            replaced |= {f: now for f, _ in own[len(own) - n :]}
            segments[bucket] = own[: len(own) - n] + [[folder, size]]
        late = now - 3600 * self.keep_hours
        gone = [f for f, since in replaced.items() if since < late]
        made = {"number": was["number"] + 1, "parts": was["parts"], "segments": segments, "replaced": {f: t for f, t in replaced.items() if t >= late}}
        path = f"{self.path}/manifests/{made['number']:012d}"
        fs, at = self._fs(path)
        aside = self._fs(f"{path}.{uuid.uuid4().hex}")[1]
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(made).encode()))
        finally:
            stream.close()
        if fs.exists(at) or not fs.rename(aside, at):
            fs.delete(aside, False)
            raise StorageError(f"another writer has put the manifest {path} in place")
        for folder in gone:
            fs.delete(self._fs(f"{self.path}/versions/{folder}")[1], True)
        self._sweep(made, late, {f.split("/")[0] for f in gone})

    def _sweep(self, made: dict, late: float, gone: set[str]) -> None:
        """Remove manifests, and versions that no commit has named, older than the time that is kept, and of `gone` ones what is empty."""
        fs = self._fs(self.path)[0]
        for f in self._list(f"{self.path}/manifests"):
            if f.getPath().getName() != f"{made['number']:012d}" and f.getModificationTime() < 1000 * late:
                fs.delete(f.getPath(), False)
        named = {f.split("/")[0] for s in made["segments"].values() for f, _ in s} | {f.split("/")[0] for f in made["replaced"]}
        for f in self._list(f"{self.path}/versions"):
            name = f.getPath().getName()
            if name not in named and (name in gone or f.getModificationTime() < 1000 * late):
                fs.delete(f.getPath(), True)

    # Buckets

    def _bucket(self, parts: list[int]) -> Column:
        of = lambda c, n: F.crc32(F.col(c).cast("string").cast("binary")) % n
        return (of("series_id", parts[0]) * parts[1] + of("obs_date", parts[1])).cast("int")

    @staticmethod
    def _buckets_of(series: list[str] | None, parts: list[int]) -> list[int]:
        """Buckets that can hold rows of the series."""
        if series is None:
            return list(range(parts[0] * parts[1]))
        rows = sorted({zlib.crc32(s.encode()) % parts[0] for s in series})
        return [r * parts[1] + d for r in rows for d in range(parts[1])]

    def _segments(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{OBSERVATIONS}, _seq long").parquet(*(f"{self.path}/versions/{f}" for f in folders))

    def _write(self, rows: DataFrame, parts: list[int], order: list[Column], version: str) -> None:
        """The first row of each key by `order`, a folder a bucket: one exchange deals buckets to tasks and serves the ranks too."""
        dealt = rows.withColumn("_b", self._bucket(parts)).repartition("_b")
        rank = F.row_number().over(Window.partitionBy("_b", *OBSERVATION_KEY).orderBy(*order))
        first = dealt.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
        first.sortWithinPartitions("_b", *OBSERVATION_KEY).write.partitionBy("_b").parquet(f"{self.path}/versions/{version}")

    def observations(self, series_id: str | list[str] | None = None, as_of=None, start=None, manifest: int | None = None) -> DataFrame:
        """Rows of one, some or all series; as_of: known on a day; start: dates from a day on; manifest: as of an earlier commit."""
        was = self.manifest(manifest)
        series = [series_id] if isinstance(series_id, str) else series_id
        found = [[f for f, _ in was["segments"].get(str(b), [])] for b in self._buckets_of(series, was["parts"])]
        alone = [s[0] for s in found if len(s) == 1]
        several = [f for s in found if len(s) > 1 for f in s]
        tables = []
        if alone:
            tables.append(self._segments(alone).select(COLUMNS))
        if several:
            rest = [c for c in COLUMNS if c not in OBSERVATION_KEY]
            newest = self._segments(several).groupBy(*OBSERVATION_KEY).agg(F.max_by(F.struct(*rest), "_seq").alias("r"))
            tables.append(newest.select(*OBSERVATION_KEY, "r.*").select(COLUMNS))
        rows = tables[0] if tables else self.spark.createDataFrame([], OBSERVATIONS)
        for more in tables[1:]:
            rows = rows.unionByName(more)
        # Filters on the key go below the aggregation and into the scans; the end of a window is known after it.
        if series is not None:
            rows = rows.filter(F.col("series_id").isin(series))
        if as_of is not None:
            rows = rows.filter(known_on(F.lit(as_of).cast("date")))
        return rows if start is None else rows.filter(F.col("obs_date") >= F.lit(start).cast("date"))

    def upsert(self, batch: DataFrame, guarded: bool = True) -> int:
        """Rows written (submitted, not changed). The batch is stored first, so that its source is asked once.

        guarded: refuse a batch in which nothing was known before it was fetched, as a source that shows today's values
        only gives; windows that are known to be of revisions need no such guard.
        """
        with scratch(self.spark):
            batch = durable(batch.select(COLUMNS), "batch")
            n = check_batch(batch, guarded)
            if n:
                was, version = self.manifest(), uuid.uuid4().hex
                self._write(batch.withColumn("_seq", F.lit(was["number"] + 1).cast("long")), was["parts"], [F.desc_nulls_last("fetched_at")], version)
                self._commit(was, {b: (f"{version}/_b={b}", size, 0) for b, size in self._written(version).items()})
                self.compact()
        return n

    def compact(self, most_segments: int | None = None) -> list[int]:
        """Merge the newest segments of buckets with more than `most_segments`, in one job; the buckets that were merged."""
        was, version = self.manifest(), uuid.uuid4().hex
        most = self.most_segments if most_segments is None else most_segments
        due = {b: n for b, s in was["segments"].items() if int(b) != RELEASES and (n := segments_to_merge([size for _, size in s], most))}
        if due:
            folders = [f for b, n in due.items() for f, _ in was["segments"][b][-n:]]
            self._write(self._segments(folders), was["parts"], [F.desc("_seq")], version)
            self._commit(was, {b: (f"{version}/_b={b}", size, due[b]) for b, size in self._written(version).items()})
        return sorted(map(int, due))

    # Release dates

    def _release_rows(self, was: dict) -> DataFrame:
        folders = [f for f, _ in was["segments"].get(str(RELEASES), [])]
        return self.spark.read.schema(RELEASE_DATES).parquet(*(f"{self.path}/versions/{f}" for f in folders)) if folders else self.spark.createDataFrame([], RELEASE_DATES)

    def releases(self, release_id: int, upto=None) -> DataFrame:
        rows = self._release_rows(self.manifest()).filter(F.col("release_id") == release_id)
        return rows if upto is None else rows.filter(F.col("release_date") <= F.lit(upto).cast("date"))

    def upsert_releases(self, batch: DataFrame) -> int:
        """Dates submitted. There are a few a year, so each write makes their table anew."""
        with scratch(self.spark):
            batch = durable(batch.select("release_id", "release_date"), "release-dates")
            n = batch.count()
            if n:
                was, version = self.manifest(), uuid.uuid4().hex
                release_upserted(self._release_rows(was), batch).write.parquet(f"{self.path}/versions/{version}/_b={RELEASES}")
                self._commit(was, {str(RELEASES): (f"{version}/_b={RELEASES}", 0, len(was["segments"].get(str(RELEASES), [])))})
        return n


#: Origins sent to every task at most; beyond, the join is dealt by bin.
MOST_ORIGINS = 1 << 18
EPOCH = date(1970, 1, 1)


def at_origins(observed: DataFrame, origins: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Every origin's snapshot of every series in one join: an equality on time bins, and the window as a range within a bin.

    `origins` needs the column `as_of` and may carry more. Days are cut into about as many bins as there are origins. A
    validity window goes to the bins that it covers between the first and the last origin, and an origin to its own, so that
    a row is repeated about as often as it is an answer. Up to MOST_ORIGINS rows of origins, which are counted, go to
    every task, and observations stay where they are; more are dealt by bin, so that tasks grow with time.
    """
    n, first, last = origins.agg(F.count(F.lit(1)), F.min(as_of), F.max(as_of)).first()
    first, last = first or EPOCH, last or EPOCH
    width = -(-((last - first).days + 1) // max(1, n))
    bin_of = lambda d: F.floor(F.date_diff(d, F.lit(first)) / width).cast("int")
    start, end = F.col("realtime_start"), F.col("realtime_end")
    covered = observed.filter((start <= F.lit(last)) & (end >= F.lit(first)) & (start <= end))
    o = covered.withColumn("_bin", F.explode(F.sequence(bin_of(F.greatest(start, F.lit(first))), bin_of(F.least(end, F.lit(last)))))).alias("o")
    w = origins.withColumn("_bin", bin_of(F.col(as_of))).alias("w")
    on = (F.col("o._bin") == F.col("w._bin")) & known_on(F.col(f"w.{as_of}"), "o.realtime_start", "o.realtime_end")
    return o.join(F.broadcast(w) if n <= MOST_ORIGINS else w, on).select(*(f"o.{c}" for c in observed.columns), *(f"w.{c}" for c in origins.columns))
