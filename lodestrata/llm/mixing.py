"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power ``tau``, normalised. ``tau`` is bisected (32 intervals a round)
between 0 and 1: the largest that keeps the weights' entropy at ``entropy`` of its maximum (or, with ``lift``, that share of the way
from the entropy of the shares themselves to the maximum, a target that binds whatever the shares are), but not so small
that any source is passed over more than ``passes`` times. Both change in one direction with ``tau``. The token budget
is given, or else the least that passes over every source once.

Weights are realised as block permutations: a source's documents are dealt by hash into blocks of about ``block``
documents, each block is permuted anew for every pass by hash, whole passes take all of it, and the last takes
documents in permuted order while the middle of each lies within the block's share of the rest of the budget. Blocks
are independent, so a source of any size is spread over many tasks, and no task orders more than a block.

Defined results: a null source is one unnamed source; null or empty text counts as one token; null ids and repeated
rows are ordered by their row; a budget beyond ``passes`` times all tokens is cut to that; an empty table gives an
empty result; extra columns are kept by :func:`mixed`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import packed, written

ENTROPY = 0.95
PASSES = 2.0
BLOCK = 1024
SECTIONS = 32
ROUNDS = 4


def words(text: Column) -> Column:
    """Tokens of a text: its words, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def dealt(salt: str, *parts: Column) -> Column:
    """60 bits by MD5, so that any engine deals the same."""
    name = F.concat_ws("/", F.lit(salt), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def exponent(totals: DataFrame, *, entropy: float = ENTROPY, passes: float = PASSES, budget: float | None = None, lift: float | None = None) -> float:
    """``tau`` for source totals (source, tokens): only a few numbers for each exponent tried reach the driver."""
    whole = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not whole[0] or whole[1] < 2:
        return 1.0
    share = totals.select((F.col("tokens") / float(whole[0])).alias("p"))
    most, given = entropy * math.log(whole[1]), (budget or 0) / whole[0]
    if lift is not None:
        natural = -share.agg(F.sum(F.col("p") * F.log("p"))).first()[0]
        most = natural + lift * (math.log(whole[1]) - natural)

    def tried(taus: list[float]) -> list[tuple[bool, bool]]:
        """For each exponent, ascending: is its entropy high enough, are there few enough passes?"""
        each = share.select("p", F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"))
        x = F.pow("p", F.col("tau"))
        sums = each.groupBy("tau").agg(F.sum(x).alias("z"), F.sum(x * F.log("p")).alias("l"), F.max(x / F.col("p")).alias("high"), F.min(x / F.col("p")).alias("low")).orderBy("tau").collect()
        return [(float(r.l * -r.tau / r.z) + math.log(r.z) >= most - 1e-12, (given * r.high / r.z if budget else r.high / r.low) <= passes + 1e-9) for r in sums]

    def edge(ok: int, low: float, high: float) -> float:
        """ok 0: the largest exponent of enough entropy; ok 1: the smallest of few enough passes."""
        for _ in range(ROUNDS):
            taus = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            good = [t[ok] for t in tried(taus)]
            if ok == 0:
                i = max((i for i, g in enumerate(good) if g), default=0)
                low, high = taus[i], taus[min(i + 1, SECTIONS)]
            else:
                i = min((i for i, g in enumerate(good) if g), default=SECTIONS)
                low, high = taus[max(i - 1, 0)], taus[i]
            if low == high:
                break
        return low if ok == 0 else high

    return max(edge(0, 0.0, 1.0), edge(1, 0.0, 1.0))


def plan(totals: DataFrame, *, entropy: float = ENTROPY, passes: float = PASSES, budget: float | None = None, block: int = BLOCK, lift: float | None = None) -> DataFrame:
    """source, weight, passes (a real number) and blocks of each source of ``totals`` (source, tokens, documents)."""
    if budget is not None:
        budget = min(budget, passes * float(totals.agg(F.sum("tokens")).first()[0] or 0))
    tau = F.lit(exponent(totals, entropy=entropy, passes=passes, budget=budget, lift=lift))
    raw = totals.select("source", "tokens", "documents", F.pow(F.col("tokens").cast("double"), tau).alias("x"))
    sums = raw.agg(F.sum("x").alias("z"), F.min(F.col("x") / F.col("tokens")).alias("low")).first()
    scale = (budget / sums["z"] if budget is not None else 1 / sums["low"]) if sums["z"] else 1.0
    return raw.select("source", (F.col("x") / F.lit(sums["z"] or 1.0)).alias("weight"), (F.col("x") / F.col("tokens") * F.lit(scale)).alias("passes"), F.ceil(F.col("documents") / block).cast("long").alias("blocks"))


def copies(rows: DataFrame, *, seed: int = 0, **how: float) -> DataFrame:
    """row, source, weight, block, pass_no and place of each copy of the rows (row, source, tokens, and name, else the row's number).

    Rows are dealt and ordered by their name; rows of one name by their row.
    Sorting all copies by ``place`` gives the mixture: every stretch of it has about the target weights."""
    totals = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "source-totals")
    planned = written(plan(totals, **how), "source-plan")
    named = rows if "name" in rows.columns else rows.withColumn("name", F.col("row").cast("string"))
    blocks = named.join(planned, "source").withColumn("block", F.pmod(dealt(f"{seed}/block", F.col("name")), F.col("blocks")))
    last = F.floor(F.col("passes") + 1e-9).cast("int")
    mine = Window.partitionBy("source", "block")
    order = mine.orderBy(dealt(f"{seed}/order", last, F.col("name")), "name", "row")
    middle = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2
    more = (middle <= (F.col("passes") - last) * F.sum("tokens").over(mine)).cast("int")
    numbered = blocks.withColumn("n", last + more).filter("n > 0")
    each = numbered.select("row", "name", "source", "weight", "tokens", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pass_no"))
    return each.withColumn("place", dealt(f"{seed}/place", F.col("pass_no"), F.col("name"))).drop("name")


def mixed(docs: DataFrame, *, source: str = "source", text: str = "text", **how: float) -> DataFrame:
    """``docs`` in mixture: rows repeated and left out as their sources' weights ask, dealt at random over tasks."""
    columns = docs.columns
    held = written(docs.select(packed(docs).alias("doc"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), words(F.col(f"`{text}`")).alias("tokens"), F.monotonically_increasing_id().alias("row")), "mixing-docs")
    chosen = written(copies(held.select("row", "source", "tokens"), **how).select("row", "place"), "mixing-copies")
    out = held.select("row", "doc").join(chosen, "row").sortWithinPartitions("place")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in columns])
