"""Streaming ingest (an extension: the batch store is what callers need): whole observations, or revisions without windows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.store import COLUMNS, Store
from tidemark.schemas import OBSERVATIONS
from tidemark.sources.registry import OPEN_END

#: What `windows_stream` needs: the only state store that has maps.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def upsert_stream(batches: DataFrame, store: Store, checkpoint: str, guarded: bool = True):
    """Write each micro-batch of observations to the store; a batch that comes again changes nothing. guarded: see Store.upsert."""
    def write(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            store.upsert(batch, guarded)

    return batches.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)


class Revisions(StatefulProcessor):
    """Of a series and date every revision by its first day; what a revision changes is its own window and the one before."""

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "realtime_start date", "value double, source string, fetched_at timestamp")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        none = lambda x: None if pd.isna(x) else x
        held = {start[0]: tuple(map(none, value)) for start, value in self.known.iterator()}
        changed = set()
        for batch in rows:
            for start, value, source, fetched in zip(*(batch[c] for c in ("realtime_start", "value", "source", "fetched_at")), strict=True):
                new = none(value), none(source), none(fetched)
                if start not in held or self._rank(new) > self._rank(held[start]):
                    held[start] = new
                    self.known.updateValue((start,), (new[0], new[1], None if new[2] is None else new[2].to_pydatetime()))
                    changed.add(start)
        starts = sorted(held)
        out = []
        for start, following in zip(starts, [*starts[1:], None], strict=True):
            if start in changed or following in changed:
                end = date.fromisoformat(OPEN_END) if following is None else following - timedelta(1)
                value, source, fetched = held[start]
                out.append((key[0], key[1], start, end, value, source, fetched))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    @staticmethod
    def _rank(row: tuple) -> tuple:
        value, source, fetched = row
        return fetched is not None, fetched or 0, value is not None, value or 0.0, source or ""


def windows_stream(revisions: DataFrame) -> DataFrame:
    """A stream of observations from a stream of revisions (see operators.revisions) that may come late, in any order and again.

    Emits the windows that a revision opens or closes, so that a store which is upserted with them holds what
    `operators.revisions.windows` makes of all revisions that have come. State: the revisions of each series and date, kept by the state
    store and restored with the query. The session needs STATE_STORE.
    """
    return revisions.groupBy("series_id", "obs_date").transformWithStateInPandas(statefulProcessor=Revisions(), outputStructType=OBSERVATIONS, outputMode="Update", timeMode="None")
