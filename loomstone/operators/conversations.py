"""Instruction pairs, masked examples and batches. Ids are code points, with control ids above them, or a vocabulary's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import code_points
from loomstone.operators.bpe import Bpe

IM_START, IM_END, PAD, IGNORE = 0x110000, 0x110001, 0x110002, -100


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, user, assistant): each user turn with the assistant turn right after it, both non-empty."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.select("conv_id", "turn", "role", F.col("text").alias("user"), F.lead("role").over(w).alias("r"), F.lead("text").over(w).alias("assistant"))
    return after.where("role = 'user' AND r = 'assistant' AND user <> '' AND assistant <> ''").select("conv_id", "turn", "user", "assistant")


def prompt(instruction: Column, extra: Column) -> Column:
    """The instruction, and a blank line and the input where there is one."""
    return F.when(F.coalesce(extra, F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), extra)).otherwise(instruction)


def template(user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>"))
    return F.concat(turn("user", user), F.lit("\n"), turn("assistant", assistant))


def examples(pairs: DataFrame, max_len: int, min_answer: int = 4, newline_between_turns: bool = False) -> DataFrame:
    """(conv_id, turn, ids, mask): the context has mask 0, the answer and its end marker 1; cut to max_len ids, and
    dropped if fewer than min_answer ids of the answer are left. User text can't become a control id."""
    one = lambda i: F.array(F.lit(i))
    text = pairs.select("conv_id", "turn", F.concat(F.lit("user\n"), "user").alias("u"), "assistant", F.lit("assistant\n").alias("head"))
    coded = text.select("conv_id", "turn", code_points("u").alias("u"), code_points("assistant").alias("a"), code_points("head").alias("h"))
    gap = [one(10)] if newline_between_turns else []
    made = coded.select("conv_id", "turn", F.concat(one(IM_START), "u", one(IM_END), *gap, one(IM_START), "h").alias("ctx"), F.concat("a", one(IM_END)).alias("ans"))
    cut = made.select("conv_id", "turn", F.size("ctx").alias("c"), F.slice(F.concat("ctx", "ans"), 1, max_len).alias("ids"))
    kept = cut.where(F.size("ids") >= F.col("c") + min_answer)
    mask = F.concat(F.array_repeat(F.lit(0), F.col("c")), F.array_repeat(F.lit(1), F.size("ids") - F.col("c")))
    return kept.select("conv_id", "turn", "ids", mask.alias("mask"))


def token_examples(pairs: DataFrame, model: Bpe, max_len: int, min_answer: int = 4) -> DataFrame:
    """(conv_id, turn, ids, mask) as examples() gives them, with the vocabulary's ids in place of code points: text is
    encoded plainly, so special strings in it don't become control ids. Pairs are encoded where they are."""
    held = pairs.sparkSession.sparkContext.broadcast(Bpe(model.merges, model.special))  # bounded by the vocabulary

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held.value
        opening, closing = bpe.special_ids["<|im_start|>"], bpe.special_ids["<|im_end|>"]
        reply = [closing, opening, *bpe.encode("assistant\n")]
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                rows = []
                for conv, turn, user, answer in zip(*(c.to_pylist() for c in batch.slice(s, 512).columns)):
                    given = [opening, *bpe.encode(f"user\n{user}"), *reply]
                    trained = [*bpe.encode(answer), closing][: max(0, max_len - len(given))]
                    if len(trained) >= min_answer:
                        rows.append((conv, turn, given + trained, [0 for _ in given] + [1 for _ in trained]))
                columns = list(zip(*rows)) or [(), (), (), ()]
                kinds = (batch.schema.field(0).type, batch.schema.field(1).type, pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "turn", "ids", "mask"])

    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn")]
    return pairs.select("conv_id", "turn", "user", "assistant").mapInArrow(encoded, ", ".join([*kinds, "ids array<int>", "mask array<int>"]))


def batches(made: DataFrame, size: int, order: list[str]) -> DataFrame:
    """(batch, conv_id, turn, x, y): consecutive groups of `size` examples, an incomplete last one dropped, padded to the
    batch's longest; y is IGNORE where nothing is trained. The number of a row is a global running sum."""
    from loomstone.operators.prefix import global_running_sum

    numbered = global_running_sum(made.withColumn("_one", F.lit(1)), order, "_one", "_rn").withColumn("batch", F.expr(f"_rn div {size}"))
    w = Window.partitionBy("batch")
    full = numbered.withColumn("_n", F.count("*").over(w)).withColumn("_len", F.max(F.size("ids")).over(w)).where(F.col("_n") == size)
    fill = lambda value: F.array_repeat(F.lit(value), F.col("_len") - F.size("ids"))
    x = F.concat(F.expr("slice(ids, 1, size(ids) - 1)"), fill(PAD))
    y = F.concat(F.expr(f"zip_with(slice(ids, 2, size(ids) - 1), slice(mask, 2, size(ids) - 1), (i, m) -> CASE WHEN m = 1 THEN i ELSE {IGNORE} END)"), fill(IGNORE))
    return full.select("batch", "conv_id", "turn", x.alias("x"), y.alias("y"))


def history(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, history): everything said up to and with each turn, in the chat template."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    said = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(said).over(w), "").alias("history"))


def printable(text: Column, end: str = "<|eos|>", shown: str = "[end of document]") -> Column:
    """Generated text for reading: the end token as a marker."""
    return F.replace(text, F.lit(end), F.lit(shown))
