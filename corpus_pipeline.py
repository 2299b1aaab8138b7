"""A training corpus from `documents`: rules, classifier, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it decides takes effect.
All but the last return the columns of `docs`. Names of columns added on the way are made so that `docs` has none of
them. Ids may be missing or repeat; nulls, empty tables and further columns are as the operators define. Stages whose
result Python computes when it is read bound the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import classifier, mixing, neardup, packing, quality_rules
from tidemark.llm.common import WORD, discard, durable, fresh, read, scratch
from tidemark.llm.queries import ACCEPT, CONTEXT, MOST_EPOCHS, POLICY, TOKENIZER, WEIGHTS
from tidemark.tables import bound


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    bound(spark)
    measures = fresh("_measures", docs)
    judged = quality_rules.measure(docs, out=measures)
    failed = fresh("_failed", judged)
    return judged.withColumn(failed, quality_rules.failures(measures)).filter(~quality_rules.rejected(POLICY, failed)).select(*docs.columns)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the acceptance level go."""
    bound(spark)
    score = classifier.score_column(classifier.train(docs, read(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text").cast("string")) >= ACCEPT)


def _numbered(docs: DataFrame, row: str, name: str) -> DataFrame:
    """With `row`, a number for each row. Ids may be missing or repeat. Stored, so that all readers see the same numbers."""
    return durable(docs.withColumn(row, F.monotonically_increasing_id()), name)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest id; of repeated rows one.

    Rows without an id come last. Texts without words are linked with nothing, so of those only repeated rows go.
    """
    row = fresh("_row", docs)
    rows = _numbered(docs, row, "near-dedup-rows")
    found = neardup.near_duplicates(rows, words=5, percent=80, id_col=row)
    found = found.select(F.col(row).alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    text = F.col("text").cast("string")
    short = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("tie"), F.when(~text.rlike(WORD), text).alias("blank"))
    alone = F.col("group").isNull()
    first = F.min(F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("tie").alias("c"), "row"))
    kept = found.join(short, "row").groupBy("group", F.when(alone, F.col("id")).alias("id"), F.when(alone, F.col("blank")).alias("text")).agg(first.alias("first"))
    kept = durable(kept.select(F.col("first.row").alias(row)), "near-dedup-kept")
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that it does not take go."""
    row = fresh("_row", docs)
    rows = _numbered(docs, row, "mixing-rows")
    draw = F.xxhash64("doc_id", F.col("text").cast("string"))
    times = fresh("_times", rows)
    copies = mixing.mix(rows, WEIGHTS, MOST_EPOCHS, id_col=row, draw=draw).filter("copies > 0").select(row, F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")).alias(times))
    each = fresh("_copy", rows)
    return rows.join(copies.hint("merge"), row).withColumn(each, F.explode(times)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the context length."""
    return packing.pack(docs, TOKENIZER, CONTEXT)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizer ids and a trained classifier are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as scope:
            made = scope.keep(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
