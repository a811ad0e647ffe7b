"""Sharding by jump consistent hashing.

The jump function maps a 64-bit key to one of n shards without a ring table: it draws the key's successive jump
positions from a linear congruential sequence and takes the last one below n. When shards are appended, a key either
stays or moves to a new shard, and only the necessary fraction, (n' - n) / n' on average, moves.

Keys are the first 16 hex digits of the MD5 of a stable id, so any id type gives equally spread keys, the same on every
platform and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import quoted

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers of uint64 keys; all keys advance together, those that have landed drop out."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = np.array(keys, dtype=np.uint64)
    landed = np.zeros(len(state), dtype=np.int64)
    going = np.arange(len(state))
    while len(going):
        with np.errstate(over="ignore"):
            state[going] = state[going] * _STEP + np.uint64(1)
        odds = ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        after = np.floor((landed[going] + 1).astype(np.float64) * (float(1 << 31) / odds))
        stay = after >= shards
        going, after = going[~stay], after[~stay]
        landed[going] = after.astype(np.int64)
    return landed


def stable_key(column: str | Column) -> Column:
    """64-bit key of an id as 16 hex digits; a null id has the key of the empty string."""
    text = F.coalesce((F.col(quoted(column)) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.substring(F.md5(text), 1, 16)


def assign(df: DataFrame, key: str, counts: list[int], names: list[str] | None = None) -> DataFrame:
    """The columns of df and an int column for each shard count in `counts` (names: shard_<count>), without a shuffle.

    Null keys are one key; equal keys, repeated rows among them, share a shard; an empty table gives no rows. `names`
    must not be columns of df; if one is, an error says so."""
    names = names or [f"shard_{n}" for n in counts]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")

    @F.pandas_udf("struct<" + ",".join(f"s{i}:int" for i in range(len(counts))) + ">")
    def shards_of(hexes):
        import pandas as pd

        raw = np.frombuffer(bytes.fromhex("".join(hexes)), dtype=">u8").astype(np.uint64)
        return pd.DataFrame({f"s{i}": jump(raw, n).astype(np.int32) for i, n in enumerate(counts)})

    found = "_found"
    while found in df.columns:
        found += "_"
    held = df.withColumn(found, shards_of(stable_key(key)))
    return held.select(*(F.col(quoted(c)) for c in df.columns), *(F.col(quoted(found))[f"s{i}"].alias(n) for i, n in enumerate(names)))


def sharded(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """df with its shard, moved so that each shard is one partition of the same number; whole rows are shuffled once.
    Null and equal keys, repeated rows and clashing names are as in assign(); an empty table gives no rows."""
    return assign(df, key, [shards], [name]).repartitionById(shards, F.col(name))


def reshard(df: DataFrame, key: str, old: int, new: int) -> DataFrame:
    """(key, shard, new_shard) of the rows that an enlarged layout moves: the only ones to copy when shards are
    appended. Null keys are one key; repeated rows come each; an empty table, or new equal to old, gives no rows; other
    columns aren't read. The key can't be called shard or new_shard."""
    both = assign(df.select(quoted(key)), key, [old, new], ["shard", "new_shard"])
    return both.where("shard <> new_shard")


def duck_sql(columns: list[str], shards: int, grown: int) -> str:
    """DuckDB statement: the columns of documents, shard, and the shard in a layout of `grown` shards."""

    def walk(n: int) -> str:
        return f"""
        walk{n} AS (SELECT k0 AS k, k0, 0::BIGINT AS b, 0::BIGINT AS j, 0 AS step FROM keys
            UNION ALL SELECT k1, k0, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k1 >> 33) + 1)::DOUBLE)) AS BIGINT), step + 1
            FROM (SELECT *, ((k::HUGEINT * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT)::UBIGINT AS k1 FROM walk{n} WHERE j < {n})),
        s{n} AS (SELECT k0, CAST(arg_max(b, step) AS INTEGER) AS shard FROM walk{n} GROUP BY k0)"""

    cols = ", ".join(f"d.{c}" for c in columns)
    return f"""
    WITH RECURSIVE hashed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT AS k0 FROM documents),
        keys AS (SELECT DISTINCT k0 FROM hashed), {walk(shards)}, {walk(grown)}
    SELECT {cols}, a.shard AS shard, b.shard AS shard_grown FROM hashed d JOIN s{shards} a USING (k0) JOIN s{grown} b USING (k0)"""
