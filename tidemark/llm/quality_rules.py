"""Quality rules as a bitmask ledger.

Every rule is evaluated once over the whole text. The ledger keeps the measurements and one failure bit a
rule; policies are named masks over those bits, so that a new policy, or what a policy would keep without one
of its rules, is answered from the ledger with bitwise operations and never reads a text again.

Defined results: a null or empty text has no words and fails `few_words`; a repeated row is judged like the
first; columns besides id and text are ignored, whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def rules(of: str = "") -> dict[str, Column]:
    """Rules by name, in the order of their bits: each is true where a document fails. `of`: the struct of MEASURES."""
    n = {m: F.col(f"{of}.{m}" if of else m) for m in MEASURES}
    return {
        "few_words": n["n_words"] < 50,
        "repeated_windows": n["n_repeat_words"] * 100 > n["n_words"] * 50,
        "many_symbols": n["n_symbols"] * 2 > n["n_words"],
        "duplicate_lines": (n["n_lines"] >= 8) & (n["n_dup_lines"] * 2 > n["n_lines"]),
        "odd_word_length": (n["n_words"] > 0) & ((n["word_chars"] * 2 < n["n_words"] * 3) | (n["word_chars"] > n["n_words"] * 40)),
    }


RULE_NAMES = ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "odd_word_length")
BIT = {name: 1 << i for i, name in enumerate(RULE_NAMES)}

#: Versioned policies: the rules that reject a document. Versions are never changed, only added.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols"),
    "v2": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "odd_word_length"),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measures(text: str | None) -> tuple[int, ...]:
    """All measurements of one whole text, in the order of MEASURES."""
    words = words_of(text)
    if not words:
        symbols = sum(map((text or "").count, "#*$%&|<>"))
        return 0, 0, symbols, 0, 0, 0
    n_symbols = sum(map(text.count, "#*$%&|<>"))
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905  the lengths differ on purpose
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict = {}
        again = bytearray(len(windows))
        for i, w in enumerate(windows):
            if (first := seen.setdefault(w, i)) != i:
                again[i] = again[first] = 1
        covered = -1
        i = again.find(1)
        while i >= 0:
            repeated += i + 2 - max(covered, i - 1)
            covered = i + 2
            i = again.find(1, i + 1)
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measure(docs: DataFrame, text_col: str = "text", out: str = "_measures") -> DataFrame:
    """`docs` with the struct `out` of MEASURES, each a long."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.struct([(m, pa.int64()) for m in MEASURES])
        for batch in batches:
            found = [dict(zip(MEASURES, measures(x.as_py()), strict=True)) for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(out, StructType([StructField(m, LongType()) for m in MEASURES]))]))


def failures(of: str = "") -> Column:
    """The failure bits (see BIT) from the measurements."""
    bits = F.lit(0).cast("long")
    for name, rule in rules(of).items():
        bits = bits.bitwiseOR(F.when(rule, F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, MEASURES and `failed`, the failure bits."""
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return measure(narrow).select(id_col, "_measures.*").withColumn("failed", failures())


def rejected(policy: str, failed: str = "failed") -> Column:
    """True where the policy rejects a document of the ledger."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: how many documents it fails, fails alone, and the policy keeps without it.

    The ledger is first counted by distinct bits (2 to the number of rules at most), so the rest is small.
    """
    bits = led.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    whole = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return (
        bits.select("failed", "n", F.inline(each))
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed_docs"),
            F.coalesce(F.sum(F.when(whole == F.col("bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
            F.coalesce(F.sum(F.when(whole.bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
    )
