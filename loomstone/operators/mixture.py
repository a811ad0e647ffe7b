"""Mixing of sources under token budgets: turns, budgets, validation prefix, repeats.

Definitions are those of a loop without lag: sources take turns, one document each; a rejected document uses a turn but
no budget; a source stops before the first document at which its kept tokens have reached its budget; the head of the
joint stream is validation until it holds its share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.lineage import cut
from loomstone.operators.prefix import global_running_sum

MIX_SCHEMA = "source string, source_idx int, ratio double, threshold double, repeat int, korean boolean, dedup boolean, instruction boolean"


@dataclass(frozen=True)
class Source:
    """A row of the mix: share of the token target, quality threshold (None: not asked), passes over the source."""

    source: str
    ratio: float
    threshold: float | None = None
    repeat: int = 1
    korean: bool = True
    dedup: bool = True
    instruction: bool = False


def mix_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The mix as a dimension table. Repeating a source that is also deduplicated would drop every repeat, so that's an
    error; so are names that occur twice."""
    if len({s.source for s in sources}) < len(sources):
        raise ValueError("a source occurs twice in the mix")
    for s in sources:
        if s.repeat > 1 and s.dedup:
            raise ValueError(f"{s.source}: repeat > 1 needs dedup=False")
    rows = [(s.source, i, s.ratio, s.threshold, s.repeat, s.korean, s.dedup, s.instruction) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, MIX_SCHEMA)


def repeated(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """Each source's documents once for every pass, with `pass_idx`; sources that aren't in the mix are left out."""
    return docs.join(F.broadcast(mix), "source").withColumn("pass_idx", F.explode(F.sequence(F.lit(0), F.col("repeat") - 1)))


def turns(docs: DataFrame, order: list[str]) -> DataFrame:
    """`rn`: the turn at which a document comes up in its source. The joint order is (rn, source_idx)."""
    numbered = global_running_sum(docs.withColumn("_one", F.lit(1)), order, "_one", "rn", inclusive=True, keys=["source"])
    return numbered.drop("_one").withColumn("rn", F.col("rn").cast("int"))


def passes_quality(keep: Column, score: Column) -> Column:
    """Instruction rows bypass the filters; others need `keep`, and the score where the source has a threshold."""
    return F.col("instruction") | (keep & (F.col("threshold").isNull() | (score >= F.col("threshold"))))


def within_budget(docs: DataFrame, target: int, order: list[str]) -> DataFrame:
    """Documents admitted while their source's earlier kept tokens are below int(target * ratio); the last may overshoot."""
    spent = global_running_sum(docs, order, "n_tok", "spent", keys=["source"])
    return spent.where(F.col("spent") < F.floor(F.lit(target) * F.col("ratio")))


def unique_within_budget(docs: DataFrame, bands: DataFrame, target: int, max_rounds: int = 30) -> DataFrame:
    """Duplicate filter and budgets, which depend on each other: a document that isn't read, as its source's budget is
    met, can't register its keys.

    docs: (ord, source, ratio, n_tok) with `ord` the unique joint order; bands: (ord, band, key), none for documents
    that aren't subject to the filter. Starting with all documents read, the filter decides which are kept, the kept
    tokens decide which are read, until that doesn't change; every round settles at least one more document in order.
    Returns the kept rows of docs; raises if max_rounds aren't enough."""
    from loomstone.operators.minhash import greedy_keep

    docs, bands = cut(docs), cut(bands)
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("ord"))).first())
    free = docs.select("ord").join(bands, "ord", "left_anti")
    read, before = docs.select("ord"), None
    for _ in range(max_rounds):
        kept = greedy_keep(bands.join(read, "ord", "left_semi"), "ord").unionByName(free.join(read, "ord", "left_semi"))
        marked = docs.join(kept.withColumn("kept", F.lit(True)), "ord", "left")
        marked = marked.withColumn("_n", F.when(F.col("kept"), F.col("n_tok")).otherwise(0))
        marked = cut(global_running_sum(marked, ["ord"], "_n", "spent", keys=["source"]).where(F.col("spent") < F.floor(F.lit(target) * F.col("ratio"))))
        read = marked.select("ord")
        if (after := digest(read)) == before:
            return marked.where("kept").select(docs.columns)
        before = after
    raise RuntimeError(f"budgets and duplicates didn't settle in {max_rounds} rounds")


def validation_prefix(docs: DataFrame, target: int, ratio: float, order: list[str]) -> DataFrame:
    """`split`: 'val' while the stream's earlier tokens are below target * ratio, then 'train'; `before` is that sum."""
    summed = global_running_sum(docs, order, "n_tok", "before")
    return summed.withColumn("split", F.when(F.col("before") < F.lit(target * ratio), "val").otherwise("train"))


def byte_budget(docs: DataFrame, budget: int, order: list[str], size: Column) -> DataFrame:
    """Documents of each source up to and with the one that reaches `budget` bytes."""
    return global_running_sum(docs.withColumn("_n", size), order, "_n", "_b", keys=["source"]).where(F.col("_b") < budget).drop("_n", "_b")
