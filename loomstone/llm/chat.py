"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, encoded once with character offsets, and the token spans are intersected with
the sorted spans of the trained turns by binary search. A token is trained if its span overlaps a trained span, so the
whole of every trained turn, its end marker included, is covered.

Markers of turn starts and ends are control ids of their own, two above the vocabulary. In the rendered string each is
one private-use character; such characters in a turn's text are replaced by U+FFFD first, and strings that look like
control tokens are ordinary text, so no text can forge a control id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import slices

START, END = "\ue000", "\ue001"
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "conv_id bigint, n_turns int, n_tokens int, n_trained int, input_ids array<int>, loss_mask array<tinyint>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The encoder with both markers added after its vocabulary; read once in a Python worker."""
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    tok.add_tokens([AddedToken(m, normalized=False, special=False) for m in (START, END)])
    return tok


def render(turns: list[tuple[str, str]], trained: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the sorted, disjoint character spans of its trained turns (text and end marker)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{_plain(role)}\n"
        body = _plain(text) + END
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "\n"]
        at += len(head) + len(body) + 1
    return "".join(parts), spans


def _plain(text: str) -> str:
    return text.replace(START, "\ufffd").replace(END, "\ufffd")


def overlap_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each (start, stop) token span that shares a character with a span. Spans are sorted and disjoint: the first
    span that ends after the token's start is the only one to look at."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), dtype=np.int8)
    begins, ends = np.array(spans, dtype=np.int64).T
    i = np.searchsorted(ends, offsets[:, 0], side="right")
    inside = i < len(ends)
    return (inside & (begins[np.minimum(i, len(ends) - 1)] < offsets[:, 1])).astype(np.int8)


def format_chats(turns: DataFrame, path: str | None = None, trained: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, n_tokens, n_trained, input_ids, loss_mask.

    Turns come in the order of `turn` (nulls first), ties by role and text; repeated rows are turns of their own. A null
    role or text counts as empty; a null conv_id is one conversation of its own; whole texts of any length are encoded;
    an empty table gives no rows. Only conv_id, turn, role and text are read."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in slices(batches, 2):
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                chats = [[(t["role"], t["text"]) for t in c] for c in part.column(1).to_pylist()]
                drawn = [render(c, trained) for c in chats]
                encoded = tok.encode_batch([text for text, _ in drawn], add_special_tokens=False)
                masks = [overlap_mask(np.array(e.offsets, dtype=np.int64).reshape(-1, 2), spans) for e, (_, spans) in zip(encoded, drawn)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(map(len, chats), pa.int32()), pa.array((len(e) for e in encoded), pa.int32()),
                        pa.array((int(m.sum()) for m in masks), pa.int32()), pa.array((e.ids for e in encoded), pa.list_(pa.int32())),
                        pa.array(list(masks), pa.list_(pa.int8())),
                    ],
                    names=["conv_id", "n_turns", "n_tokens", "n_trained", "input_ids", "loss_mask"],
                )

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.sum(F.octet_length("t.text")).alias("n_bytes"))
    return chats.mapInArrow(formatted, SCHEMA)
