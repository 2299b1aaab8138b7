"""Validity windows from revisions: a value holds from the day it is known to the day before the next value of its date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.registry import OPEN_END

REVISIONS = "series_id string, obs_date date, realtime_start date, value double, source string, fetched_at timestamp"


def windows(revisions: DataFrame) -> DataFrame:
    """Observations from revisions (see REVISIONS) in any order and any number of times: of one start the last fetched counts, then the greatest value."""
    keys = ["series_id", "obs_date"]
    last = F.max(F.struct(F.col("fetched_at").isNotNull().alias("known"), "fetched_at", "value", "source")).alias("r")
    each = revisions.groupBy(*keys, "realtime_start").agg(last).select(*keys, "realtime_start", "r.value", "r.source", "r.fetched_at")
    following = F.lead("realtime_start").over(Window.partitionBy(*keys).orderBy("realtime_start"))
    end = F.coalesce(F.date_sub(following, 1), F.lit(OPEN_END).cast("date"))
    return each.select(*keys, "realtime_start", end.alias("realtime_end"), "value", "source", "fetched_at")
