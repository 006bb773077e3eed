"""Running values over ordered groups of any size, without a group in one task.

Rows are range-partitioned by group and order, so a hot group lies in as many parts as its rows need. Each part of a group is scanned by an
ordinary window; one summary of it is taken by an aggregate; the summaries of a group's earlier parts are combined into what the part carries in, and
that is joined to its rows. A part boundary splits one group at most, so there are at most twice as many carries as parts, and only those are broadcast."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestrata.sources.scratch import written

PART = "_part"


@dataclass(frozen=True)
class Running:
    """``within`` a part's rows so far, of a ``whole`` part, over the parts ``before`` (of the summary's column), and ``both`` of within and before."""

    within: Callable[[WindowSpec], Column]
    whole: Column
    before: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def place() -> Running:
    """1, 2, 3, …"""
    return Running(lambda w: F.row_number().over(w), F.count("*"), F.sum, lambda own, carried: (own + F.coalesce(carried, F.lit(0))).cast("int"))


def largest(value: Column) -> Running:
    """The largest so far, this row included; nulls don't count."""
    return Running(lambda w: F.max(value).over(_upto(w)), F.max(value), F.max, F.greatest)


def latest_before(value: Column, order: list[str]) -> Running:
    """The last value that isn't null of the rows before, this row excluded."""
    known = F.when(value.isNotNull(), F.struct(*order))
    last = lambda c: F.last(c, ignorenulls=True)
    return Running(lambda w: last(value).over(_earlier(w)), F.max_by(value, known), last, F.coalesce)


def parted(rows: DataFrame, key: str, order: list) -> DataFrame:
    """``rows`` with the number of their part: ranges of key and order. Written once, since ranges are drawn anew whenever they are computed."""
    return written(rows.repartitionByRange(key, *order).withColumn(PART, F.spark_partition_id()), "parts")


def running(rows: DataFrame, key: str, order: list, values: dict[str, Running]) -> DataFrame:
    """Adds the running ``values``. ``order`` must be total within a group, or ties are in any order. Rows that :func:`parted` has dealt by this
    order stay as they are and keep their part's number; all others are dealt here. A null key is one group."""
    known = PART in rows.columns
    rows = rows if known else parted(rows, key, order)
    at = Window.partitionBy(key, PART).orderBy(*order)
    own = rows.withColumns({f"_own_{n}": v.within(at) for n, v in values.items()})
    sums = rows.groupBy(F.col(key).alias("_key"), F.col(PART).alias("_of")).agg(*[v.whole.alias(f"_sum_{n}") for n, v in values.items()])
    group, earlier = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_key", "_of", F.count("*").over(group).alias("_parts"), *[v.before(F.col(f"_sum_{n}")).over(earlier).alias(f"_in_{n}") for n, v in values.items()]).filter("_parts > 1")
    joined = own.join(F.broadcast(carried), F.col(key).eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_of")), "left")
    out = joined.withColumns({n: v.both(F.col(f"_own_{n}"), F.col(f"_in_{n}")) for n, v in values.items()})
    return out.drop("_key", "_of", "_parts", *[f"_{kind}_{n}" for n in values for kind in ("own", "in")], *([] if known else [PART]))
