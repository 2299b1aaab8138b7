r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, `<|turn|>role<|says|>text<|end|>` for each turn, and encoded once with
offsets. The three control strings are tokens of their own, so a text begins and ends at a token's edge; sorted turn
spans meet the sorted token spans by binary search, and tokens inside an assistant's text are under the loss mask.
Control strings inside texts and roles are escaped reversibly: a backslash doubles and `<|` becomes `<\|`.

Turns come in the order of `turn`, then role and text; a null text or role is empty; repeated rows are turns of
their own; a null conversation id is one conversation; an empty table gives no rows; other columns are ignored.
One conversation is one sequence to encode and to hash, so a task holds one conversation at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[int], list[int], list[str]]:
    """The formatted conversation; begin and end of each turn's text in it; roles."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        parts += [head, body, END]
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        at = ends[-1] + len(END)
    return "".join(parts), starts, ends, [r for r, _ in turns]


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text), read back from a formatted conversation."""
    turns = formatted.split(TURN)[1:]
    pairs = (t.removesuffix(END).split(SAYS) for t in turns)
    return [(unescape(role), unescape(text)) for role, text in pairs]


_tokenizers: dict = {}


def chat_tokenizer(path: str):
    """The tokenizer with the control strings as tokens after its own, and offsets that keep white space."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
        tok.add_tokens([AddedToken(x, normalized=False, special=False) for x in (TURN, SAYS, END)])
        tok.encode_special_tokens = True
        _tokenizers[path] = tok
    return _tokenizers[path]


def mask(offsets, starts: Sequence[int], ends: Sequence[int], wanted: Sequence[bool]):
    """For each token span, whether it lies in a wanted turn's text; spans and turns are in order."""
    import numpy as np

    spans = np.array(offsets, np.int64).reshape(-1, 2)
    if not len(starts):
        return np.zeros(len(spans), bool)
    turn = np.searchsorted(np.array(starts), spans[:, 0], "right") - 1
    inside = (turn >= 0) & (spans[:, 1] <= np.array(ends)[turn]) & (spans[:, 1] > spans[:, 0])
    return inside & np.array(wanted, bool)[turn]


def masked_spans(offsets, under) -> list[tuple[int, int]]:
    """The parts of the formatted text that the tokens under the mask cover, in order, touching ones joined.

    A character of several tokens has its span in each of them, so spans may overlap.
    """
    out: list[tuple[int, int]] = []
    for (a, b), m in zip(offsets, under, strict=True):
        if m:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return out


def format_conversations(turns: DataFrame, tokenizer: str, loss_roles: Sequence[str] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: id, formatted, input_ids, loss_mask (one 0 or 1 a token), loss_spans (in `formatted`)."""
    narrow = turns.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = narrow.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.select("id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = chat_tokenizer(tokenizer)
        fields = [pa.field("formatted", pa.string()), pa.field("input_ids", pa.list_(pa.int32())), pa.field("loss_mask", pa.list_(pa.int8())), pa.field("loss_spans", pa.list_(pa.list_(pa.int64())))]
        for batch in batches:
            for k in range(batch.num_rows):
                roles, texts = (batch.column(c)[k].as_py() for c in (1, 2))
                text, starts, ends, _ = render(list(zip(roles, texts, strict=True)))
                e = tok.encode(text, add_special_tokens=False)
                under = mask(e.offsets, starts, ends, [r in loss_roles for r in roles])
                row = [[text], [e.ids], [under.astype("int8").tolist()], [[list(s) for s in masked_spans(e.offsets, under)]]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array(v, f.type) for v, f in zip(row, fields, strict=True))], names=["id", *(f.name for f in fields)])

    kind = narrow.schema["id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"id {kind}, formatted string, input_ids array<int>, loss_mask array<byte>, loss_spans array<array<long>>").withColumnRenamed("id", id_col)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the output says, read back from it: turns, and the text under the loss mask."""

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = []
            for f, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(f)
                loss = "".join(unescape(f[a:b]) for a, b in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), sha256(said.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(f)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["id", *names])

    narrow = formatted.select(F.col(id_col).alias("id"), "formatted", "loss_spans")
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
