"""Token counts from an exact length histogram.

Documents are encoded once and counted by encoded length; sums over the suffixes of that histogram then answer
totals, quantiles and truncated totals for every context limit, without a second look at the documents.

Defined results: a null or empty text has length 0; repeated rows count each time; an empty table gives an empty
histogram; columns besides the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, encoder


def lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Encoded length (`n_tokens` long) of every row's whole text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer).column
        for batch in batches:
            n = [len(x) // 4 for x in encode(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Documents by encoded length; one row for each length that occurs. Stored, so that readers never encode again."""
    return durable(lengths(docs, tokenizer, text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents")), "lengths")


def answers(hist: DataFrame, width: int = 4096) -> DataFrame:
    """Suffix sums for every length that occurs, as the context limit `n_tokens`.

    Columns: documents of exactly that length; documents_over and tokens_over, of longer documents;
    documents_upto, tokens_upto; truncated_total, the tokens if every document is cut at this limit; share_upto,
    the share of documents not longer (n_tokens is the quantile of that share). Between two rows the truncated
    total is linear: see `truncated_total`. Suffix sums are added up within blocks of `width` lengths first, and
    only the blocks' totals meet.
    """
    cell = hist.withColumn("_block", F.floor(F.col("n_tokens") / width)).withColumn("_tokens", F.col("n_tokens") * F.col("documents"))
    blocks = cell.groupBy("_block").agg(F.sum("documents").alias("_bd"), F.sum("_tokens").alias("_bt"))
    over_blocks = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_bd").over(over_blocks), zero).alias("_od"),
        F.coalesce(F.sum("_bt").over(over_blocks), zero).alias("_ot"),
        F.sum("_bd").over(everything).alias("_alld"),
        F.sum("_bt").over(everything).alias("_allt"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = cell.withColumn("_id", F.coalesce(F.sum("documents").over(inside), zero)).withColumn("_it", F.coalesce(F.sum("_tokens").over(inside), zero)).join(blocks, "_block")
    documents_over, tokens_over = F.col("_od") + F.col("_id"), F.col("_ot") + F.col("_it")
    return out.select(
        "n_tokens",
        "documents",
        documents_over.alias("documents_over"),
        tokens_over.alias("tokens_over"),
        (F.col("_alld") - documents_over).alias("documents_upto"),
        (F.col("_allt") - tokens_over).alias("tokens_upto"),
        (F.col("_allt") - tokens_over + F.col("n_tokens") * documents_over).alias("truncated_total"),
        ((F.col("_alld") - documents_over) / F.col("_alld")).alias("share_upto"),
    )


def truncated_total(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens that remain if documents are cut at each of `limits`, also between the lengths that occur."""
    each = F.explode(F.array(*(F.lit(x).cast("long") for x in limits)))
    return hist.select("n_tokens", "documents", each.alias("context_limit")).groupBy("context_limit").agg(F.sum(F.least("n_tokens", "context_limit") * F.col("documents")).alias("tokens"))


def quantile(ans: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least `share` of the documents do not exceed."""
    return ans.filter(F.col("share_upto") >= share).agg(F.min("n_tokens").alias("n_tokens"))
