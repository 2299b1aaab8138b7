"""Tables that end lineage: written to the folder that all machines share, read back, removed when no longer needed."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return folder.rstrip("/")


#: Bounds of an Arrow batch while a durable table is written: a Python worker and its executor hold a few batches at once,
#: whatever the length of the texts in them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}

#: Paths written in each scope that this thread has open, the innermost last. A thread sees its own scopes only, so that the
#: end of one thread's scope never removes a table of another, as of a stream's batches beside a query.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open scopes", default=())
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: By session: writers at work, and the settings to come back when the last is done.
_writing: dict[int, tuple[int, dict[str, str]]] = {}
_turn = threading.Lock()


@contextmanager
def _bounded(spark: SparkSession) -> Iterator[None]:
    """The session's own bounds come back when its last writer ends; where they are tighter they stay."""
    key = id(spark._jsparkSession)
    with _turn:
        n, before = _writing.get(key) or (0, {name: spark.conf.get(name) for name in BATCH})
        if not n:
            _tighten(spark)
        _writing[key] = n + 1, before
    try:
        yield
    finally:
        with _turn:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            else:
                for name, value in before.items():
                    spark.conf.set(name, value)


def _tighten(spark: SparkSession) -> None:
    for name, most in BATCH.items():
        if not 0 < bytes_of(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def bound(spark: SparkSession) -> None:
    """The bounds of an Arrow batch hold in this session from now on, tighter ones stay. For results that Python computes
    when a reader asks for them: what is set then counts, not what was set when they were made."""
    key = id(spark._jsparkSession)
    with _turn:
        _tighten(spark)
        if key in _writing:  # its writers don't bring the former bounds back
            _writing[key] = _writing[key][0], {name: spark.conf.get(name) for name in BATCH}


def bytes_of(setting: str) -> int:
    """A number, with or without a unit such as `64MB`."""
    number = setting.strip().lower().removesuffix("b")
    power = "kmgt".find(number[-1:]) + 1 if number[-1:] else 0
    return int(number[:-1] if power else number) << 10 * power


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it back: a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    if scopes := _open.get():
        scopes[-1].append(path)
    with _bounded(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _path_of[found] = path
    return found


def discard(df: DataFrame) -> None:
    """Remove the table that `durable` returned as `df`, once nothing reads it; other tables stay."""
    if path := _path_of.pop(df, None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scope:
    def __init__(self, around: tuple[list[str], ...], paths: list[str]):
        self.around, self.paths = around, paths

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df`, so that it stays when the scope's tables go; it belongs to the scope around, if there is one."""
        token = _open.set(self.around)
        try:
            return durable(df, name)
        finally:
            _open.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scope]:
    """A scope whose tables are removed at its end; what is read later is written by `keep`."""
    paths: list[str] = []
    around = _open.get()
    token = _open.set((*around, paths))
    try:
        yield Scope(around, paths)
    finally:
        _open.reset(token)
        for path in paths:
            remove(spark, path)
        if paths:
            # Spark removes a plan's shuffle files once the plan is collected; without a collection they pile up on disk
            # until the driver's heap fills. It takes 30 to 80 ms.
            gc.collect()
            spark._jvm.java.lang.System.gc()


def tidy(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query (spark, ...) whose result is written where it reads tables that the query wrote, which then go; others stay lazy."""
    @wraps(query)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        with scratch(spark) as scope:
            found = query(spark, *args, **options)
            return scope.keep(found, query.__name__) if scope.paths else found

    return run


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has: `name`, with underscores before it where needed."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
