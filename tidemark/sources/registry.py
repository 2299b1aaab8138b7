"""The series registry: a small dimension, sent to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.exceptions import ConfigurationError
from tidemark.schemas import REGISTRY

#: Id, role, frequency, label, units, scale to thousands, publication lag in months, description.
SERIES = (
    ("ADPMNUSNERSA", "target", "M", "Private payrolls", "Persons", 0.001, 1, "Private employment, level"),
    ("ICSA", "feature", "W", "Initial claims", "Number", 0.001, 0, "Initial unemployment claims"),
    ("CCSA", "feature", "W", "Continued claims", "Number", 0.001, 0, "Continued unemployment claims"),
    ("USPRIV", "feature", "M", "Private payrolls, official", "Thousands of Persons", 1.0, 1, "Official private employment"),
    ("PAYEMS", "feature", "M", "Total payrolls", "Thousands of Persons", 1.0, 1, "Official total employment"),
    ("UNRATE", "feature", "M", "Unemployment rate", "Percent", 1.0, 1, "Unemployment rate"),
    ("JTSJOL", "feature", "M", "Job openings", "Level in Thousands", 1.0, 2, "Job openings"),
)
RELEASE_ID = 194
REGIME = ("2020-03-01", "2022-06-01")
INGEST_START = "2009-01-01"
OPEN_END = "9999-12-31"
EARLIEST = "1776-07-04"


def registry(spark: SparkSession, rows=SERIES) -> DataFrame:
    return spark.createDataFrame(list(rows), REGISTRY)


def ids(role: str | None = None, rows=SERIES) -> list[str]:
    """Ids of a role, or all with the target first."""
    found = [r[0] for r in rows if role is None or r[1] == role]
    return sorted(found, key=lambda i: next(r[1] for r in rows if r[0] == i) != "target")


def lookup(series_id: str, rows=SERIES) -> tuple:
    for r in rows:
        if r[0] == series_id:
            return r
    raise ConfigurationError(f"unknown series {series_id}; known: {', '.join(r[0] for r in rows)}")


def is_count(units: str | Column) -> Column:
    """Whether a unit counts persons or claims, so that a value in thousands makes sense."""
    u = F.lower(F.lit(units)) if isinstance(units, str) else F.lower(units)
    return u.isin("persons", "number", "thousands of persons", "level in thousands")


def unit_label(units: str | Column) -> Column:
    u = F.lit(units) if isinstance(units, str) else units
    return F.when(is_count(units), F.lit("thousands of persons")).otherwise(F.lower(u))


def to_canonical(observations: DataFrame, dimension: DataFrame) -> DataFrame:
    """Values in thousands, null where the value is null; an unknown series is an error. The one place that scales.

    The registry has one row a series; Spark sends it to every task where its size is below the session's threshold.
    """
    known = dimension.select("series_id", "scale_to_thousands", F.lit(True).alias("_known"))
    joined = observations.join(known, "series_id", "left")
    scale = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown series "), "series_id")).cast("double")).otherwise(F.col("scale_to_thousands"))
    return joined.withColumn("value", F.col("value") * scale).drop("scale_to_thousands", "_known")
