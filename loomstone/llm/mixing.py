"""Mixing sources to target weights that vary over training.

A schedule gives every source integer weights at common knots of training progress 0..1. At a knot a source's share is
its weight over the sum of all sources' weights; between knots shares are interpolated linearly, so they add up to 1
everywhere. Integrating a source's share gives its cumulative token demand D(t), piecewise quadratic and rising.

The documents of a source are put in a hashed order; a document with c tokens of its source before it gets the progress
t where D(t) = c, by the closed inverse of the quadratic. A source whose demand exceeds its supply is passed through
again (up to `max_epochs` times), one with a larger supply stops where its demand ends. Sorting by position gives the
training order, in which every window has the mixture of the schedule at that time.

The running token sums are two-level: documents fall in 16 ** `prefix` buckets by the first digits of their hash, bucket
totals are summed over buckets, and only within a (source, bucket) is there an ordered window. So a source of any size
is spread over many tasks; the number of buckets follows the number of documents and doesn't change the result.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import quoted

#: Source `src0` is eased out, `src19` and `src18` are raised towards the end, all others keep the same weight.
SCHEDULE = {"src0": [90, 60, 30], "src18": [5, 10, 20], "src19": [5, 10, 40]}
KNOTS = [0.0, 0.5, 1.0]
DEFAULT = [10, 10, 10]


def token_estimate(text: str = "text") -> Column:
    """Four UTF-8 bytes count as a token; at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / F.lit(4))).cast("bigint")


def segments(supply: DataFrame, schedule: dict[str, list[int]], knots: list[float], default: list[int], total: int | None = None) -> DataFrame:
    """From (src, supply), src as _src() makes it: (src, t0, t1, p0, p1, d0, d1, span, demand, total) for each source and stretch between knots: shares at both
    ends, tokens demanded before both ends, tokens demanded of all sources in the stretch, of this source in all."""
    spark = supply.sparkSession
    if not len(knots) >= 2 or knots[0] != 0 or knots[-1] != 1 or sorted(set(knots)) != knots:
        raise ValueError("knots must rise from 0 to 1")
    if any(len(w) != len(knots) or min(w) < 0 for w in [default, *schedule.values()]):
        raise ValueError("each source needs one non-negative integer weight for each knot")
    planned = spark.createDataFrame([(f"={k}", w) for k, w in schedule.items()] or [("", default)], "src string, w array<bigint>")
    if not schedule:
        planned = planned.limit(0)
    weights = supply.join(planned, "src", "left").select("src", "supply", F.coalesce("w", F.array(*map(F.lit, default))).alias("w"))
    sums = weights.agg(
        *(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(knots))),
        (F.sum("supply") if total is None else F.lit(total)).cast("bigint").alias("total"),
    )
    share = lambda i: F.coalesce(F.try_divide(F.col("w")[i].cast("double"), F.col(f"s{i}").cast("double")), F.lit(0.0))
    both = weights.crossJoin(sums)  # one row
    stretches, before = [], F.lit(0.0)
    for i in range(len(knots) - 1):
        span = F.col("total").cast("double") * F.lit(knots[i + 1] - knots[i])
        after = before + span * ((share(i) + share(i + 1)) / F.lit(2.0))
        stretches.append(F.struct(
            F.lit(knots[i]).alias("t0"), F.lit(knots[i + 1]).alias("t1"), share(i).alias("p0"), share(i + 1).alias("p1"),
            before.alias("d0"), after.alias("d1"), span.alias("span"),
        ))
        before = after
    return both.select("src", "supply", "total", before.alias("demand"), F.explode(F.array(*stretches)).alias("g")).select(
        "src", "supply", "total", "demand", "g.*"
    )


def _src(source: str | Column) -> Column:
    """A source as a key: a null source isn't the empty one."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def unmet_demand(
    docs: DataFrame, schedule: dict[str, list[int]] = SCHEDULE, knots: list[float] = KNOTS, default: list[int] = DEFAULT,
    total: int | None = None, max_epochs: int | None = 4, n_tokens: Column | None = None,
) -> DataFrame:
    """(source, supply, demand, unmet), a row for each source of docs: its tokens, those that the schedule asks for, and
    how many of these mix() leaves out with the same arguments because `max_epochs` passes don't give them; 0 where the
    weights are met. Nulls and edge rows count as in mix(); an empty table gives no rows."""
    rows = docs.select(_src("source").alias("src"), (token_estimate() if n_tokens is None else n_tokens).alias("n"))
    plan = segments(rows.groupBy("src").agg(F.sum("n").alias("supply")), schedule, knots, default, total).select("src", "supply", "demand").distinct()
    missing = F.lit(0.0) if max_epochs is None else F.greatest(F.lit(0.0), F.col("demand") - F.lit(max_epochs) * F.col("supply"))
    source = F.when(F.col("src") != "", F.expr("substring(src, 2)"))
    return plan.select(source.alias("source"), "supply", "demand", missing.alias("unmet"))


def mix(
    docs: DataFrame, schedule: dict[str, list[int]] = SCHEDULE, knots: list[float] = KNOTS, default: list[int] = DEFAULT,
    total: int | None = None, max_epochs: int | None = 4, seed: str = "mix", prefix: int | None = None, n_tokens: Column | None = None,
    positions: bool = True,
) -> DataFrame:
    """The columns of docs and, with `positions`, _tokens, _epoch and _position (in tokens of the whole run), sorted by
    position.

    `total` is the run's length in tokens, by default the tokens of docs. A source not in the schedule gets the default
    weights; a null source is a source of its own, not the empty one; a null or empty text counts one token; null ids and
    repeated rows are documents of their own (rows equal in hash, id and tokens follow each other in any order; null ids
    are hashed by their tokens). A source whose demand takes more than `max_epochs` passes ends early, and its positions
    stay empty: unmet_demand() tells how much that is; None sets no limit. Ties of position are
    ordered by source and id. A source of weight 0 throughout places nothing; an empty table gives no rows. The
    caller's columns travel in one struct, so their names can't clash with those used here."""
    if prefix is None:  # some thousand documents of a source in a bucket, were all of one source; a count of Parquet reads only footers
        prefix = max(1, ceil(log(max(1, docs.count()) / 8192, 16)))
    rows = docs.select(
        F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), _src("source").alias("src"), F.col("source").alias("named"), F.col("doc_id").alias("id"),
        (token_estimate() if n_tokens is None else n_tokens).alias("tokens"),
    ).withColumn("hash", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit(":"), "tokens"))))).withColumn("bucket", F.substring("hash", 1, prefix))
    totals = rows.groupBy("src", "bucket").agg(F.sum("tokens").alias("n"))
    running = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("src", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))
    plan = segments(totals.groupBy("src").agg(F.sum("n").alias("supply")), schedule, knots, default, total)
    per_source = plan.groupBy("src", "supply", "total", "demand").agg(F.collect_list(F.struct("t0", "t1", "p0", "p1", "d0", "d1", "span")).alias("plan"))
    starts = bases.join(per_source, "src")  # a row for each source and bucket: no larger than the sources, whatever the corpus
    inside = Window.partitionBy("src", "bucket").orderBy("hash", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("earlier", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(starts, ["src", "bucket"])
        .withColumn("passes", F.least(F.lit(max_epochs), F.ceil(F.col("demand") / F.col("supply"))).cast("int"))  # least() leaves nulls out
        .where("passes > 0")
        .withColumn("epoch", F.explode(F.expr("sequence(0, passes - 1)")))
        .withColumn("c", (F.col("epoch") * F.col("supply") + F.col("base") + F.col("earlier")).cast("double"))
        .where("c < demand")
        .withColumn("g", F.expr("element_at(filter(plan, g -> g.d0 <= c AND c < g.d1), 1)"))
    )
    y = "((c - g.d0) / g.span)"
    u = f"CASE WHEN {y} <= 0 THEN 0.0D ELSE 2.0D * {y} / (g.p0 + sqrt(greatest(g.p0 * g.p0 + 2.0D * (g.p1 - g.p0) * {y}, 0.0D))) END"
    at = F.expr(f"CAST(floor((g.t0 + ({u}) * (g.t1 - g.t0)) * CAST(total AS DOUBLE)) AS BIGINT)")
    ordered = placed.withColumn("position", at).orderBy("position", "named", "id")
    own = [F.col("row")[c].alias(c) for c in docs.columns]
    return ordered.select(*own, *([F.col("tokens").alias("_tokens"), F.col("epoch").alias("_epoch"), F.col("position").alias("_position")] if positions else []))


def duck_sql(schedule: dict[str, list[int]] = SCHEDULE, knots: list[float] = KNOTS, default: list[int] = DEFAULT, max_epochs: int | None = 4, seed: str = "mix") -> str:
    """DuckDB statement for mix() on `documents`: doc_id, source, n_tokens, epoch, position."""
    weight = lambda i: "CASE src " + " ".join(f"WHEN '={s}' THEN {w[i]}" for s, w in schedule.items()) + f" ELSE {default[i]} END"
    parts, before = [], "0.0::DOUBLE"
    for i in range(len(knots) - 1):
        span = f"(total::DOUBLE * {knots[i + 1] - knots[i]!r}::DOUBLE)"
        after = f"({before} + {span} * ((p{i} + p{i + 1}) / 2.0::DOUBLE))"
        parts.append(f"SELECT src, supply, total, demand, {knots[i]!r}::DOUBLE t0, {knots[i + 1]!r}::DOUBLE t1, p{i} pa, p{i + 1} pb, {before} d0, {after} d1, {span} span FROM demanded")
        before = after
    shares = ", ".join(f"(w{i}::DOUBLE / (sum(w{i}) OVER ())::DOUBLE) p{i}" for i in range(len(knots)))
    return f"""
    WITH counted AS (SELECT doc_id, source, coalesce('=' || source, '') src, CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 4.0::DOUBLE)) AS BIGINT) n FROM documents),
        rows AS (SELECT *, md5(concat('{seed}:', coalesce(doc_id::VARCHAR, ':' || n))) h FROM counted),
        ordered AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY src ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) c0 FROM rows),
        supplies AS (SELECT src, CAST(sum(n) AS BIGINT) supply FROM rows GROUP BY src),
        weights AS (SELECT src, supply, CAST(sum(supply) OVER () AS BIGINT) total, {", ".join(f"{weight(i)} w{i}" for i in range(len(knots)))} FROM supplies),
        shares AS (SELECT src, supply, total, {shares} FROM weights),
        demanded AS (SELECT *, {before} demand FROM shares),
        stretches AS ({" UNION ALL ".join(parts)}),
        passes AS (SELECT o.*, p.demand, p.supply, e.epoch, (e.epoch * p.supply + o.c0)::DOUBLE c FROM ordered o JOIN demanded p USING (src)
            JOIN (SELECT unnest(range({max_epochs or "(SELECT CAST(max(ceil(demand / supply::DOUBLE)) AS BIGINT) FROM demanded)"})) epoch) e ON e.epoch < ceil(p.demand / p.supply::DOUBLE)),
        placed AS (SELECT a.*, g.t0, g.t1, g.pa, g.pb, g.total, (a.c - g.d0) / g.span y FROM passes a JOIN stretches g ON a.src = g.src AND g.d0 <= a.c AND a.c < g.d1 WHERE a.c < a.demand)
    SELECT doc_id, source, n AS n_tokens, CAST(epoch AS INTEGER) AS epoch,
        CAST(floor((t0 + (CASE WHEN y <= 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * y / (pa + sqrt(greatest(pa * pa + 2.0::DOUBLE * (pb - pa) * y, 0.0::DOUBLE))) END) * (t1 - t0)) * total::DOUBLE) AS BIGINT) AS position
    FROM placed"""
