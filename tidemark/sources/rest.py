"""The REST source of observations and release dates, as a Spark data source, and its JSON payloads.

One partition a series, or pages dealt to `readers` partitions; transient errors are tried again with a random wait,
permanent ones never. All partitions share a budget of requests a minute, each keeping to its part of it. Filters on
series and dates reach the request. With errors as rows, a series that fails is a row that says why. The key comes from
an environment variable of the executors and never enters a plan.
"""

from __future__ import annotations

import json
import logging
import os
import random
import time
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition

from tidemark import exceptions as X
from tidemark.functions.columns import value_of
from tidemark.schemas import OBSERVATIONS, RELEASE_DATES
from tidemark.sources.registry import EARLIEST, OPEN_END

log = logging.getLogger("tidemark")
PAGE = {"observations": 100_000, "release_dates": 10_000}
PAYLOAD = "count int, offset int, limit int, observations array<struct<realtime_start: string, realtime_end: string, date: string, value: string>>"


def error_text(body: str) -> str:
    try:
        return str(json.loads(body)["error_message"])
    except (ValueError, KeyError, TypeError):
        return body[:200]


def classify(status: int, body: str) -> X.IngestionError | None:
    """The error that an answer stands for; None for a good one."""
    if status < 400:
        return None
    text = error_text(body)
    if status == 429:
        return X.RateLimitError(text)
    if status >= 500:
        return X.TransientIngestionError(f"{status}: {text}")
    said = text.lower().replace("_", " ")
    if status == 400 and "api key" in said:
        return X.AuthenticationError(text)
    if status == 400 and ("does not exist" in said or "series id" in said):
        return X.SeriesNotFoundError(text)
    return X.PermanentIngestionError(f"{status}: {text}")


def body_of(status: int, body: str) -> dict:
    if (error := classify(status, body)) is not None:
        raise error
    try:
        found = json.loads(body)
    except ValueError as e:
        raise X.ResponseValidationError("the answer is no JSON") from e
    if not isinstance(found, dict):
        raise X.ResponseValidationError("the answer is no object")
    return found


def with_retry(call: Callable, tries: int = 3, base: float = 0.5, most: float = 8.0, sleep: Callable = time.sleep, rng: random.Random | None = None):
    """`call()`, again after transient errors: up to `tries` more times, each after a wait between 0 and a growing bound."""
    rng = rng or random.Random()
    for k in range(tries + 1):
        try:
            return call()
        except X.TransientIngestionError:
            if k == tries:
                raise
            sleep(rng.uniform(0, min(base * 2**k, most)))


def redacted(params: dict) -> dict:
    return {k: v for k, v in params.items() if k != "api_key"}


def check_key(key: str) -> str:
    """A key is 32 letters and digits."""
    if len(key) != 32 or not (key.isascii() and key.isalnum()):
        raise X.ConfigurationError("the API key is not 32 letters and digits")
    return key


def list_of(body: dict, field: str) -> list:
    rows = body.get(field)
    if not isinstance(rows, list):
        raise X.ResponseValidationError(f"the answer has no list {field}")
    return rows


def pages(get: Callable[[str, dict], tuple[int, str]], endpoint: str, field: str, params: dict, limit: int, **retry) -> Iterator[dict]:
    """Rows of all pages."""
    offset = 0
    while True:
        log.debug("%s %s", endpoint, redacted(params | {"offset": offset}))
        body = with_retry(lambda: body_of(*get(endpoint, params | {"offset": offset, "limit": limit})), **retry)
        rows = list_of(body, field)
        yield from rows
        offset += len(rows)
        if not rows or offset >= int(body.get("count", offset)):
            return


def number(text) -> float | None:
    if text is None or str(text).strip() in ("", "."):
        return None
    try:
        return float(text)
    except ValueError as e:
        raise X.ResponseValidationError(f"no number: {text!r}") from e


def day(text) -> date:
    try:
        return date.fromisoformat(text)
    except (TypeError, ValueError) as e:
        raise X.ResponseValidationError(f"no date: {text!r}") from e


def observation(row: dict, series_id: str, source: str, fetched: datetime, all_vintages: bool) -> tuple:
    for need in ("date", "value", "realtime_start", *(("realtime_end",) if all_vintages else ())):
        if need not in row:
            raise X.ResponseValidationError(f"an observation has no {need}")
    end = day(row["realtime_end"]) if all_vintages else date.fromisoformat(OPEN_END)
    return series_id, day(row["date"]), day(row["realtime_start"]), end, number(row["value"]), source, fetched


def _get(base_url: str, timeout: float) -> Callable[[str, dict], tuple[int, str]]:
    from urllib.error import HTTPError, URLError
    from urllib.parse import urlencode
    from urllib.request import urlopen

    def get(endpoint: str, params: dict) -> tuple[int, str]:
        try:
            with urlopen(f"{base_url}/{endpoint}?{urlencode(params)}", timeout=timeout) as r:
                return r.status, r.read().decode()
        except HTTPError as e:
            return e.code, e.read().decode(errors="replace")
        except (URLError, TimeoutError) as e:
            raise X.TransientIngestionError(str(e)) from e

    return get


class Pace:
    """Waits so that calls start `interval` seconds apart at least, the first after `wait`."""

    def __init__(self, interval: float, wait: float = 0.0, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.next = clock() + wait

    def __call__(self) -> None:
        if (wait := self.next - self.clock()) > 0:
            self.sleep(wait)
        self.next = max(self.next, self.clock()) + self.interval


class _Of(InputPartition):
    """(key, offset) of each page to read, or None in place of the offset for all pages; which partition of how many it is."""

    def __init__(self, pages: list[tuple[str, int | None]], nth: int = 0, of: int = 1):
        self.pages, self.nth, self.of = pages, nth, of


#: Requests a minute that the source allows (fixed value).
REQUESTS = 120


class VintageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.start = options.get("start")
        self.releases = options.get("table", "observations") == "release_dates"
        self.limit = int(options.get("page", PAGE["release_dates" if self.releases else "observations"]))

    def _params(self, key: str) -> tuple[str, str, dict]:
        """Endpoint, list of the answer, and parameters of a key."""
        common = {"file_type": "json", "api_key": check_key(os.environ.get(self.options.get("key_variable", "VINTAGE_API_KEY"), ""))}
        if self.releases:
            return "release/dates", "release_dates", common | {"release_id": key, "include_release_dates_with_no_data": "true"}
        params = common | {"series_id": key, "sort_order": "asc"} | ({"realtime_start": EARLIEST, "realtime_end": OPEN_END} if self._everything() else {})
        return "series/observations", "observations", params | ({"observation_start": self.start} if self.start else {})

    def _everything(self) -> bool:
        return self.options.get("all_vintages", "true") == "true"

    def _get(self, nth: int = 0, of: int = 1) -> Callable[[str, dict], tuple[int, str]]:
        """Requests of one partition, at its part of the rate; partitions start one after the other."""
        rate = float(self.options.get("requests_per_minute", REQUESTS))
        get, pace = _get(self.options["base_url"], float(self.options.get("timeout", 15))), Pace(60 * of / rate, 60 * nth / rate)

        def paced(endpoint: str, params: dict) -> tuple[int, str]:
            pace()
            return get(endpoint, params)

        return paced

    def partitions(self):
        """A partition a key; with `readers`, so many, to which the pages are dealt by what a first small request of each key counts."""
        if not (readers := int(self.options.get("readers", 0))):
            return [_Of([(k, None)], i, len(self.keys)) for i, k in enumerate(self.keys)]
        get, found = self._get(), []
        for key in self.keys:
            endpoint, _, params = self._params(key)
            try:
                count = int(with_retry(lambda: body_of(*get(endpoint, params | {"offset": 0, "limit": 1}))).get("count", 0))  # noqa: B023  called at once
            except X.IngestionError:
                count = 0  # the task that reads the key's first page says what is wrong
            found += [(key, offset) for offset in range(0, max(1, count), self.limit)]
        n = min(readers, len(found))
        return [_Of(found[i::n], i, n) for i in range(n)]

    def _rows(self, key: str, offset: int | None, get: Callable) -> Iterator[dict]:
        endpoint, field, params = self._params(key)
        if offset is None:
            return pages(get, endpoint, field, params, self.limit)
        return iter(list_of(with_retry(lambda: body_of(*get(endpoint, params | {"offset": offset, "limit": self.limit}))), field))

    def read(self, partition):
        get, as_rows = self._get(partition.nth, partition.of), self.options.get("errors", "raise") == "rows"
        fetched = datetime.now(UTC)
        for key, offset in partition.pages:
            try:
                known = 0
                for row in self._rows(key, offset, get):
                    known += 1
                    yield (*self._parsed(row, key, fetched), *([None] if as_rows else []))
                if self.releases and not known:
                    log.warning("no release dates for %s", key)
            except X.IngestionError as e:
                if not as_rows:
                    raise
                secret = os.environ.get(self.options.get("key_variable", "VINTAGE_API_KEY"), "")
                said = f"{type(e).__name__}: {e}".replace(secret, "...")[:1000]
                yield (int(key), None, said) if self.releases else (key, *[None] * 6, said)

    def _parsed(self, row: dict, key: str, fetched: datetime) -> tuple:
        if not self.releases:
            return observation(row, key, self.options.get("source", "api"), fetched, self._everything())
        if "date" not in row:
            raise X.ResponseValidationError("a release has no date")
        return int(key), day(row["date"])


class FilteredReader(VintageReader):
    def pushFilters(self, filters):  # noqa: N802  the interface's name
        """Series and first date narrow the request; Spark tests all filters again."""
        for f in filters:
            if not self.releases and getattr(f, "attribute", None) == ("series_id",) and isinstance(f, EqualTo | In):
                wanted = f.value if isinstance(f, In) else [f.value]
                self.keys = [k for k in self.keys if k in wanted] if self.keys else [k for k in wanted if k is not None]
            elif not self.releases and getattr(f, "attribute", None) == ("obs_date",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.start = max(self.start or "", f.value.isoformat())
            yield f


class VintageSource(DataSource):
    """spark.read.format("vintages").option("base_url", ...).option("keys", "A,B")

    Further options: table=release_dates; start; all_vintages=false; readers and page (pages dealt to so many tasks, of so many
    rows); requests_per_minute; errors=rows (adds a column `error`; a row that has one holds nothing else but its key). Filters
    on series_id and obs_date reach the request where spark.sql.python.filterPushdown.enabled is set; without keys, the
    series of the filter are read.
    """

    @classmethod
    def name(cls) -> str:
        return "vintages"

    def schema(self) -> str:
        base = RELEASE_DATES if self.options.get("table") == "release_dates" else OBSERVATIONS
        return f"{base}, error string" if self.options.get("errors") == "rows" else base

    def reader(self, schema) -> DataSourceReader:
        kind = FilteredReader if self.options.get("filters") == "push" else VintageReader
        return kind(dict(self.options))


REJECTS = "series_id string, date string, realtime_start string, realtime_end string, value string, reason string"


def parsed_payloads(spark, path: str, series_id: str, fetched_at, all_vintages: bool = True, source: str = "file") -> tuple[DataFrame, DataFrame]:
    """Observations from stored JSON answers, and the rows that are none (see REJECTS) with the reason; neither stops the other."""
    raw = spark.read.schema(PAYLOAD).option("multiLine", True).json(path).select(F.explode("observations").alias("o")).select("o.*")
    trimmed = F.trim("value")
    blank = F.col("value").isNull() | trimmed.isin("", ".")
    dates = {"obs_date": "date", "realtime_start": "realtime_start"} | ({"realtime_end": "realtime_end"} if all_vintages else {})
    parsed = {name: F.try_to_date(F.col(c), "yyyy-MM-dd") for name, c in dates.items()}
    value = trimmed.try_cast("double")
    no_dates = [F.when(p.isNull(), F.concat(F.lit(f"no date: {dates[name]} is "), F.coalesce(F.col(dates[name]), F.lit("missing")))) for name, p in parsed.items()]
    reason = F.coalesce(*no_dates, F.when(~blank & value.isNull(), F.concat(F.lit("no number: "), F.col("value"))))
    end = parsed["realtime_end"] if all_vintages else F.lit(OPEN_END).cast("date")
    judged = raw.select("*", reason.alias("reason"), parsed["obs_date"].alias("_obs"), parsed["realtime_start"].alias("_start"), end.alias("_end"), F.when(~blank, value).alias("_value"))
    own = F.lit(series_id).alias("series_id")
    good = judged.filter("reason is null").select(own, F.col("_obs").alias("obs_date"), F.col("_start").alias("realtime_start"), F.col("_end").alias("realtime_end"), F.col("_value").alias("value"), F.lit(source).alias("source"), F.lit(fetched_at).cast("timestamp").alias("fetched_at"))
    return good, judged.filter("reason is not null").select(own, "date", "realtime_start", "realtime_end", "value", "reason")


def from_payloads(spark, path: str, series_id: str, fetched_at, all_vintages: bool = True, source: str = "file") -> DataFrame:
    """Observations from stored JSON answers."""
    rows = spark.read.schema(PAYLOAD).option("multiLine", True).json(path).select(F.explode("observations").alias("o"))
    end = F.to_date("o.realtime_end") if all_vintages else F.lit(OPEN_END).cast("date")
    return rows.select(F.lit(series_id).alias("series_id"), F.to_date("o.date").alias("obs_date"), F.to_date("o.realtime_start").alias("realtime_start"), end.alias("realtime_end"), value_of("o.value").alias("value"), F.lit(source).alias("source"), F.lit(fetched_at).cast("timestamp").alias("fetched_at"))
