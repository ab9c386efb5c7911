"""What is kept from frame to frame: rings, commits, states of features, displaced content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import carried, in_ranges, starts


def fifo(records: DataFrame, order: str, size: Column, capacity: int) -> DataFrame:
    """Records through a ring that loses none: offset, the bytes written before a record, and waits_for, how far the consumer
    must have read before it can be written (0 and less: at once). A running sum in two passes."""
    dealt = in_ranges(records, F.col(order))
    own = F.sum(size).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = dealt.join(F.broadcast(starts(dealt, size)), "_part").withColumn("_end", (own + F.col("_start")).cast("long"))
    return rows.withColumns({"offset": (F.col("_end") - size).cast("long"), "waits_for": (F.col("_end") - capacity).cast("long")}).select(*records.columns, "offset", "waits_for")


def flushed(slots: DataFrame, consumed: int, room: int, size: Column) -> DataFrame:
    """What a flush does with each slot (key, dirty, in_flight_until): clean, deferred (what was written before is still on its
    way), written, or blocked (the ring has no room for it any more), in order of key."""
    ready = F.col("dirty") & (F.col("in_flight_until") <= consumed)
    dealt = in_ranges(slots.withColumn("_size", F.when(ready, size).otherwise(0)), F.col("key"))
    own = F.sum("_size").over(W.partitionBy("_part").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    rows = dealt.join(F.broadcast(starts(dealt, F.col("_size"))), "_part").withColumn("_through", own + F.col("_start"))
    what = F.when(~F.col("dirty"), "clean").when(F.col("in_flight_until") > consumed, "deferred").when(F.col("_through") <= room, "written").otherwise("blocked")
    return rows.withColumn("what", what).select(*slots.columns, "what")


def committed(records: DataFrame, group: str = "frame") -> DataFrame:
    """Records of groups that are committed; a group without a commit, or one that is aborted, leaves nothing."""
    marks = records.groupBy(group).agg(F.max((F.col("kind") == "commit").cast("int")).alias("_c"), F.max((F.col("kind") == "abort").cast("int")).alias("_a"))
    whole = marks.where("_c = 1 and _a = 0").select(group)
    return records.where(~F.col("kind").isin("begin", "commit", "abort")).join(whole, group, "left_semi")


def traffic(heads: DataFrame, order: str, head: str) -> DataFrame:
    """Bytes a frame: how far the ring's head has moved since the frame before; the first frame has all."""
    dealt = in_ranges(heads, F.col(order))
    before = F.lag(head).over(W.partitionBy("_part").orderBy(order))
    rows = carried(dealt, [], F.max_by(head, order), lambda c: F.last(c, ignorenulls=True), "_carried")
    return rows.withColumn("bytes", (F.col(head) - F.coalesce(before, F.col("_carried"), F.lit(0))).cast("long")).select(*heads.columns, "bytes")


def feature_states(changes: DataFrame) -> DataFrame:
    """The states that changes leave: source, id, state (a JSON object). A change (seq, source, id, key, value as JSON text) sets
    a key; a null value clears it, a null key clears all keys of the feature that were set before."""
    cleared = changes.where("key is null").groupBy("source", "id").agg(F.max("seq").alias("_cleared"))
    last = changes.where("key is not null").groupBy("source", "id", "key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    kept = last.join(cleared, ["source", "id"], "left").where("value is not null and (_cleared is null or seq > _cleared)")
    pair = F.concat(F.expr("substring(to_json(array(key)), 2, length(to_json(array(key))) - 2)"), F.lit(":"), F.col("value"))
    return kept.groupBy("source", "id").agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(pair)), ","), F.lit("}")).alias("state"))


def restated(before: DataFrame, now: DataFrame) -> DataFrame:
    """Features (source, id) whose state differs between two tables of states: all whose properties must be read again."""
    b, n = before.select("source", "id", F.col("state").alias("_b")), now.select("source", "id", F.col("state").alias("_n"))
    return b.join(n, ["source", "id"], "full").where(~F.col("_b").eqNullSafe(F.col("_n"))).select("source", "id")


def displaceable(live: DataFrame, announced: DataFrame, slabs: DataFrame, view: int, threshold: float) -> DataFrame:
    """Live content (key, id, users, refs: slabs it lies in) that may move: not announced in this frame, used by this view
    alone, and in a slab of which less than the threshold, but something, is alive (slabs: slab, fraction)."""
    own = live.join(announced.select("key"), "key", "left_anti").where((F.size("users") == 1) & F.array_contains("users", view))
    thin = slabs.where((F.col("fraction") > 0) & (F.col("fraction") < threshold)).select("slab")
    return own.withColumn("slab", F.explode("refs")).join(thin, "slab", "left_semi").select("key", "id").distinct()


def current(indexes: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index rows of buckets that are still there, the ids that the others release)."""
    return indexes.join(buckets.select("bucket"), "bucket", "left_semi"), indexes.join(buckets.select("bucket"), "bucket", "left_anti").select("cross_id")


def acknowledged(content: DataFrame, position: int) -> DataFrame:
    """Content (written_until) that the consumer has read."""
    return content.where(F.col("written_until") <= position)


def depth_slot(layer: Column, layers: Column) -> Column:
    """A layer's place in depth: the first layer is farthest back and has the highest slot; what lies beyond the count has the
    last one."""
    top = F.greatest(layers - 1, F.lit(0))
    return top - F.least(F.greatest(layer, F.lit(0)), top)


def published(cameras: DataFrame) -> DataFrame:
    """The camera that a reader gets: the newest one whose writing has ended. While a camera is written its sequence is odd."""
    whole = cameras.where(F.col("seq") % 2 == 0)
    return whole.join(whole.agg(F.max("seq").alias("seq")), "seq", "left_semi")
