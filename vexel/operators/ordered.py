"""Ordered operators: stable sorts, top-k, runs, eviction, draw order, deduplication, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import cut


def sort_rank(df: DataFrame, key: Column, order: str, by: list[str], reverse_ties: bool = False) -> DataFrame:
    """A place from 1 within each group by key; failures (null) count as 0, NaN comes last. Equal keys keep the order
    of the source, or reverse it."""
    tie = F.col(order).desc() if reverse_ties else F.col(order).asc()
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.coalesce(key, F.lit(0.0)), tie)))


def top_k(df: DataFrame, by: list[str], key: Column, k: int, tie: str) -> DataFrame:
    """The k rows of greatest key in each group, ties to the smaller tie value."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(key.desc(), F.col(tie)))).where(F.col("place") <= k)


def runs(df: DataFrame, by: list[str], order: str, key: list[Column]) -> DataFrame:
    """Numbers the runs of neighbors with equal keys: only what is adjacent merges, equal keys farther off don't."""
    w = W.partitionBy(*by).orderBy(order)
    k = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)])
    changed = F.coalesce((~F.lag(k).over(w).eqNullSafe(k)).cast("int"), F.lit(1))
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def over_capacity(df: DataFrame, size: Column, newest_first: list[Column], capacity: int, by: list[str]) -> DataFrame:
    """Rows that must go, as the running sum from the newest on exceeds the capacity."""
    w = W.partitionBy(*by).orderBy(*newest_first).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") > capacity)


def deduplicated(df: DataFrame, key: list[str], identity: str, order: list[Column]) -> DataFrame:
    """The first row of each key; rows without an identity are all kept."""
    w = W.partitionBy(*key, identity, F.when(F.col(identity).isNull(), F.monotonically_increasing_id())).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def draw_order(df: DataFrame, passes: Column, order: list[str]) -> DataFrame:
    """Rows unfolded into their passes, with a dense slot within each layer."""
    return numbered(df.withColumn("pass", F.explode(passes)), ["pass", *order], "slot", ["layer"]).withColumn("slot", F.col("slot").cast("int"))


def thinned(circles: Column) -> Column:
    """Circles (x, y, r) along a line: one that lies within sqrt(2) r of the last kept one goes, never two in a row."""

    def step(a: Column, c: Column) -> Column:
        last = F.element_at(a["kept"], -1)
        dx, dy = c["x"] - last["x"], c["y"] - last["y"]
        close = (F.size(a["kept"]) > 0) & ~a["dropped"] & (dx * dx + dy * dy < 2 * c["r"] * c["r"])
        close = F.coalesce(close, F.lit(False))
        return F.struct(F.when(close, a["kept"]).otherwise(F.concat(a["kept"], F.array(c))).alias("kept"), close.alias("dropped"))

    kind = "array<struct<x:double,y:double,r:double>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(False).alias("dropped"))
    return F.aggregate(circles.cast(kind), start, step, lambda a: a["kept"])


def entered_and_left(before: DataFrame, now: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a cover has gained, and what it has lost."""
    return now.join(before.select(*key), key, "left_anti"), before.join(now.select(*key), key, "left_anti")


def counters(df: DataFrame, key: list[str]) -> DataFrame:
    """Counts by key, and whether something was counted twice."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).withColumn("duplicated", F.col("n") > 1)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df dealt by ranges of an order and written, with the number of its part: parts stay what they are for all that
    reads them."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def starts(dealt: DataFrame, size: Column) -> DataFrame:
    """_part and the sum of all sizes in the parts before it: as many rows as there are parts."""
    sums = dealt.groupBy("_part").agg(F.sum(size).alias("_size"))
    return sums.select("_part", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))


def carried(dealt: DataFrame, by: list[str], made: Column, fold, name: str) -> DataFrame:
    """in_ranges() rows, dealt by `by` first, with what all earlier parts hold of their group: `made` sums a part's rows of a
    group up, fold (a window function of a Column) joins these. A group that reaches over parts is no task of its own; null
    where no earlier part has any of the group."""
    sums = dealt.groupBy("_part", *by).agg(made.alias("_made"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_part", *by, fold(F.col("_made")).over(earlier).alias(name))
    same = F.col("_l._part") == F.col("_r._part")
    for c in by:
        same = same & F.col(f"_l.`{c}`").eqNullSafe(F.col(f"_r.`{c}`"))
    return dealt.alias("_l").join(sums.alias("_r").hint("merge"), same).select("_l.*", f"_r.{name}")


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] = ()) -> DataFrame:
    """Rows numbered from 1 in an order, over the whole table or within each group, in two passes: sizes of ranges, then rows
    within each."""
    by = list(by)
    dealt = in_ranges(df, *[F.col(c) for c in (*by, *order)])
    own = F.row_number().over(W.partitionBy("_part", *by).orderBy(*order))
    if by:
        rows = carried(dealt, by, F.count("*"), F.sum, "_before")
        return rows.withColumn(name, (own + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)
    return dealt.join(F.broadcast(starts(dealt, F.lit(1))), "_part").withColumn(name, (own + F.col("_start")).cast("long")).select(*df.columns, name)
