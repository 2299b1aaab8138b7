"""Revised series derived from order tables, so that every operator runs on data at any scale.

A month's level becomes known in three revisions: revision r holds the orders whose key modulo 3 is at most r, and is
published 4 days into the (1 + r)th month after it. Weekly series do likewise, a week after the week's end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import month_of
from tidemark.sources.registry import OPEN_END

TARGET = "1-URGENT"
WEEKLY = "SHIPPED"
#: Excluded regime of the derived series.
REGIME = ("1998-03-01", "1998-08-01")
#: id, role, frequency, label, units, scale, lag, description; see tidemark.sources.registry.
SERIES = (
    (TARGET, "target", "M", "Urgent orders", "Persons", 0.001, 1, "Urgent orders, level"),
    ("2-HIGH", "feature", "M", "High orders", "Persons", 0.001, 1, "High-priority orders"),
    ("3-MEDIUM", "feature", "M", "Medium orders", "Persons", 0.001, 1, "Medium-priority orders"),
    ("4-NOT SPECIFIED", "feature", "M", "Other orders", "Persons", 0.001, 2, "Orders without priority"),
    ("5-LOW", "feature", "M", "Low orders", "Persons", 0.001, 1, "Low-priority orders"),
    (WEEKLY, "feature", "W", "Weekly shipments", "Number", 0.001, 0, "Quantity shipped by week ending"),
)


def _revisions(table: DataFrame, keys: list[str], number, amount, first_known) -> DataFrame:
    """Three revisions from one pass: conditional sums by key, then a row for each."""
    sums = table.groupBy(*keys).agg(*(F.sum(F.when(number % 3 <= r, amount)).alias(f"r{r}") for r in range(3)))
    each = F.array(*(F.struct(first_known(r).alias("realtime_start"), (F.date_sub(first_known(r + 1), 1) if r < 2 else F.lit(OPEN_END).cast("date")).alias("realtime_end"), F.col(f"r{r}").cast("double").alias("value")) for r in range(3)))
    return sums.select(*keys, F.explode(each).alias("v")).select(*keys, "v.*")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, obs_date, realtime_start, realtime_end, value)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    monthly = orders.select(F.col("o_orderpriority").alias("series_id"), month_of("o_orderdate").alias("obs_date"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    known = lambda r: F.date_add(F.add_months("obs_date", 1 + r), 4)
    monthly = _revisions(monthly, ["series_id", "obs_date"], F.col("o_orderkey"), F.col("amount"), known)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    weekly = lines.select(F.lit(WEEKLY).alias("series_id"), F.date_add(day, 7 - F.dayofweek(day)).alias("obs_date"), "l_orderkey", F.col("l_quantity").cast("decimal(18,2)").alias("amount"))
    known = lambda r: F.date_add("obs_date", 5 + 7 * r)
    return monthly.unionByName(_revisions(weekly, ["series_id", "obs_date"], F.col("l_orderkey"), F.col("amount"), known))


def releases(observed: DataFrame, target: str = TARGET) -> DataFrame:
    """Release dates: when a month of the target is first known."""
    return observed.filter(F.col("series_id") == target).groupBy("obs_date").agg(F.min("realtime_start").alias("origin")).select("origin").distinct()
