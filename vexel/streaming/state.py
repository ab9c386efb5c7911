"""Stateful operators over keyed records (key columns, seq, kind, ...). Order is by sequence number, not event time; state is
freed by release and retire records, so there is no watermark to invent.

Each operator has a batch form over a whole log, and a streaming form that gives the same rows in the end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import carried, in_ranges, numbered

# -- latest wins


def latest(records: DataFrame, key: list[str], payload: list[str], seq: str = "seq") -> DataFrame:
    """The newest record of each key. Works on streams too (update or complete mode): the state is one record a key."""
    return records.groupBy(*key).agg(F.max(seq).alias(seq), F.max_by(F.struct(*payload), seq).alias("p")).select(*key, seq, *[F.col(f"p.{c}").alias(c) for c in payload])


def upsert_sink(path: str, key: list[str], payload: list[str], seq: str = "seq"):
    """A foreachBatch function that keeps the newest record of each key in snapshots path/v=<batch>: a batch that runs
    again writes the same snapshot anew."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.select(*key, seq, *payload)
        if batch_id > 0:
            now = now.unionByName(spark.read.schema(now.schema).parquet(f"{path}/v={batch_id - 1}"))
        latest(now, key, payload, seq).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return run


# -- landings by dispatch sequence


def landed(records: DataFrame, key: list[str], arrival: str, seq: str) -> DataFrame:
    """Records that land: one whose seq is below what its key holds already is late and dropped."""
    dealt = in_ranges(records, *[F.col(c) for c in (*key, arrival)])
    here = F.max(seq).over(W.partitionBy("_part", *key).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    rows = carried(dealt, key, F.max(seq), F.max, "_carried").withColumn("_held", F.greatest(here, "_carried"))
    return rows.where(F.col("_held").isNull() | (F.col(seq) >= F.col("_held"))).select(*records.columns)


def landing_stream(records: DataFrame, key: list[str], arrival: str, seq: str) -> DataFrame:
    names = records.columns

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(arrival)
        before = rows[seq].cummax().shift(1)
        if held is not None:
            before = before.fillna(held).clip(lower=held)
        state.update((int(max(rows[seq].max(), held if held is not None else rows[seq].max())),))
        yield rows[before.isna() | (rows[seq] >= before)][names]

    return records.groupBy(*key).applyInPandasWithState(run, records.schema, "held long", "append", GroupStateTimeout.NoTimeout)


# -- announcements and uses


JOINED = "geometry long, view long, use_seq long, payload string"


def unretired(records: DataFrame) -> DataFrame:
    """The records that count: a retirement ends all of its geometry so far, a release only its own use."""
    ended = records.where("kind = 'retire'").groupBy("geometry").agg(F.max("seq").alias("_ended"))
    return records.hint("merge").join(ended.hint("merge"), "geometry", "left").where("_ended is null or seq > _ended").drop("_ended")


def joined(records: DataFrame) -> DataFrame:
    """Batch form over a log (seq, kind, geometry, view, payload): which announced payload each live use has at the end.
    A use lasts until its release; a retirement ends a geometry's announcement and all its uses so far. Either side may
    come first."""
    r = unretired(records)
    announced = r.where("kind = 'announce'").groupBy("geometry").agg(F.max_by("payload", "seq").alias("payload"))
    uses = r.where("kind in ('use', 'release')").groupBy("geometry", "view").agg(F.max("seq").alias("use_seq"), F.max_by("kind", "seq").alias("last")).where("last = 'use'")
    return uses.join(announced, "geometry").select("geometry", "view", "use_seq", "payload")


def joining_stream(records: DataFrame) -> DataFrame:
    """Streaming form: a row whenever a use and an announcement meet, also again for all uses after a new announcement.
    State is one announcement and the live uses of a geometry."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        payload, uses = (state.get[0], json.loads(state.get[1])) if state.exists else (None, {})
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            view = None if pd.isna(r.view) else str(int(r.view))
            if r.kind == "announce":
                payload = r.payload
                out += [(key[0], int(v), s, payload) for v, s in uses.items()]
            elif r.kind == "use":
                uses[view] = int(r.seq)
                if payload is not None:
                    out.append((key[0], int(view), int(r.seq), payload))
            elif r.kind == "release":
                uses.pop(view, None)
            elif r.kind == "retire":
                payload, uses = None, {}
        if payload is None and not uses:
            if state.exists:
                state.remove()
        else:
            state.update((payload, json.dumps(uses)))
        yield pd.DataFrame(out, columns=["geometry", "view", "use_seq", "payload"])

    return records.groupBy("geometry").applyInPandasWithState(run, JOINED, "payload string, uses string", "append", GroupStateTimeout.NoTimeout)


# -- change gates


def _bits(c: Column) -> Column:
    """A double by its bits: NaN equals itself, and -0 isn't 0."""
    return F.when(F.isnan(c), F.lit("nan")).when((c == 0) & F.signum(1 / F.when(c != 0, c)).isNull() & c.cast("string").startswith("-"), F.lit("-0")).otherwise(c.cast("string"))


def gated(frames: DataFrame, by: list[str], seq: str, camera: list[str], dirty: str) -> DataFrame:
    """Frames that emit: a view's first one, those with a dirty flag, and those whose camera differs bit by bit from the
    frame before. The others emit nothing."""
    now = F.struct(*[_bits(F.col(c)).alias(c) for c in camera])
    dealt = in_ranges(frames.withColumn("_now", now), *[F.col(c) for c in (*by, seq)])
    rows = carried(dealt, by, F.max_by("_now", seq), lambda c: F.last(c, ignorenulls=True), "_carried")
    before = F.coalesce(F.lag("_now").over(W.partitionBy("_part", *by).orderBy(seq)), F.col("_carried"))
    return rows.withColumn("_before", before).where(F.col(dirty) | F.col("_before").isNull() | ~F.col("_now").eqNullSafe(F.col("_before"))).select(*frames.columns)


def gating_stream(frames: DataFrame, by: list[str], seq: str, camera: list[str], dirty: str) -> DataFrame:
    names = frames.columns

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, keep = pd.concat(list(batches)).sort_values(seq), []
        for r in rows[[*camera, dirty]].itertuples(index=False):
            now = json.dumps([float(v).hex() if v == v else "nan" for v in r[:-1]])
            keep.append(bool(r[-1]) or now != last)
            last = now
        state.update((last,))
        yield rows[keep][names]

    return frames.groupBy(*by).applyInPandasWithState(run, frames.schema, "last string", "append", GroupStateTimeout.NoTimeout)


# -- fades

FADE_SECONDS = 0.3


def faded(opacity: float, placed: bool, elapsed_ms: float) -> float:
    """The next opacity: towards 1 while placed, else towards 0."""
    step = elapsed_ms / 1000.0 / FADE_SECONDS
    return min(1.0, opacity + step) if placed else max(0.0, opacity - step)


def fades(frames: DataFrame) -> DataFrame:
    """Batch form over (key, seq, placed, elapsed_ms): opacity after each frame. A label starts hidden; one that is fully
    hidden and not placed is evicted (evicted = true) and starts anew when it comes back.

    Frames are dealt by ranges of key and seq. What a range's frames make of the opacity before it is a shift held between
    two bounds; a row a range comes to the driver, which carries the opacity of a key that reaches over ranges from one to the
    next. Then each range is run through in order."""
    plain = frames.select("key", F.col("seq").cast("long").alias("seq"), F.col("placed").cast("boolean").alias("placed"), F.col("elapsed_ms").cast("double").alias("elapsed_ms"))
    dealt = in_ranges(plain, F.col("key"), F.col("seq")).repartition("_part").sortWithinPartitions("_part", "key", "seq")
    key_type = frames.schema["key"].dataType
    kind = key_type.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(part, key, seqs, placed, steps) for each run of a key's frames in a batch."""
        for batch in batches:
            d = batch.to_pandas()
            parts, keys = d["_part"].tolist(), d["key"].tolist()
            placed, steps, seqs = d["placed"].fillna(False).tolist(), (d["elapsed_ms"].fillna(0.0) / 1000.0 / FADE_SECONDS).tolist(), d["seq"].tolist()
            a = 0
            for b in range(1, len(d) + 1):
                if b == len(d) or parts[b] != parts[a] or not _same(keys[b], keys[a]):
                    yield parts[a], keys[a], seqs[a:b], placed[a:b], steps[a:b]
                    a = b

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for part, key, _, placed, steps in runs(batches):
            held = found.get(part)
            if held is None:
                held = found[part] = [part, key, key, True, 0.0, 0.0, 1.0]
            elif not _same(held[2], key):
                held[2:] = [key, False, 0.0, 0.0, 1.0]
            for p, s in zip(placed, steps):
                s = s if p else -s
                held[4:] = [held[4] + s, min(1.0, max(0.0, held[5] + s)), min(1.0, max(0.0, held[6] + s))]
        for h in found.values():
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "first", "last", "one", "shift", "low", "high"), h))], schema=out_schema)

    out_schema = to_arrow_schema(T.StructType().add("part", "integer").add("first", key_type).add("last", key_type).add("one", "boolean").add("shift", "double").add("low", "double").add("high", "double"))
    carry, key, value = {}, None, None
    for r in sorted(dealt.mapInArrow(summed, f"part int, first {kind}, last {kind}, one boolean, shift double, low double, high double").collect(), key=lambda r: r.part):
        start = value if value is not None and _same(r.first, key) else 0.0
        if start:
            carry[r.part] = start
        before = start if r.one else 0.0
        key, value = r.last, min(r.high, max(r.low, before + r.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, opacity = None, None, 0.0
        for part, key, seqs, placed, steps in runs(batches):
            if part != at:
                at, now, opacity = part, key, carry.get(part, 0.0)
            elif not _same(now, key):
                now, opacity = key, 0.0
            out = []
            for s, p, step in zip(seqs, placed, steps):
                opacity = min(1.0, opacity + step) if p else max(0.0, opacity - step)
                out.append({"key": key, "seq": s, "opacity": opacity, "evicted": not p and opacity == 0})
            yield pa.RecordBatch.from_pylist(out, schema=rows_schema)

    rows_schema = to_arrow_schema(T.StructType().add("key", key_type).add("seq", "long").add("opacity", "double").add("evicted", "boolean"))
    return dealt.mapInArrow(run, f"key {kind}, seq long, opacity double, evicted boolean")


def _same(a, b) -> bool:
    """Null keys, which pandas may show as NaN, are equal."""
    return a == b or (a is None or a != a) and (b is None or b != b)


def fading_stream(frames: DataFrame) -> DataFrame:
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opacity, out = state.get[0] if state.exists else 0.0, []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            opacity = faded(opacity, bool(r.placed), float(r.elapsed_ms))
            out.append((key[0], int(r.seq), opacity, not r.placed and opacity == 0))
        if out and out[-1][3]:
            if state.exists:
                state.remove()
        else:
            state.update((opacity,))
        yield pd.DataFrame(out, columns=["key", "seq", "opacity", "evicted"])

    schema = f"key {frames.schema['key'].dataType.simpleString()}, seq long, opacity double, evicted boolean"
    return frames.groupBy("key").applyInPandasWithState(run, schema, "opacity double", "append", GroupStateTimeout.NoTimeout)


# -- dirty rectangles

MOST_RECTS = 4


def merged_rects(rects: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """A bounded list of dirty rectangles (x0, y0, x1, y1): what is contained is absorbed; more than a few become their
    bounding box."""
    out: list[tuple[int, int, int, int]] = []

    def holds(a, b) -> bool:
        return a[0] <= b[0] and a[1] <= b[1] and a[2] >= b[2] and a[3] >= b[3]

    for r in rects:
        if any(holds(o, r) for o in out):
            continue
        out = [o for o in out if not holds(r, o)] + [r]
        if len(out) > MOST_RECTS:
            out = [(min(o[0] for o in out), min(o[1] for o in out), max(o[2] for o in out), max(o[3] for o in out))]
    return out


# -- zoom latch


def latched(zooms: list[float], margin: float = 0.1) -> list[int]:
    """Integer levels with hysteresis: a level is left only once the zoom lies beyond it by a margin."""
    out: list[int] = []
    for z in zooms:
        level = out[-1] if out else None
        if level is None or z >= level + 1 + margin or z < level - margin:
            level = int(z // 1)
        out.append(level)
    return out


# -- identities that last


def stable_ids(now: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    """Ids for keys: a key keeps the id it had (prior: key columns, id), new keys get the next free ones in order of key."""
    known = now.select(*key).distinct().join(prior, key, "left")
    top = prior.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    fresh = numbered(known.where("id is null").select(*key), key, "n")
    new = fresh.join(F.broadcast(top)).select(*key, (F.col("top") + F.col("n")).cast("long").alias("id"))
    return known.where("id is not null").unionByName(new)


def frame_changes(before: DataFrame, now: DataFrame, key: list[str], content: str) -> DataFrame:
    """Per key of two frames: released (gone), announced (new), changed or kept."""
    b, n = before.select(*key, F.col(content).alias("_b"), F.lit(True).alias("_in_b")), now.select(*key, F.col(content).alias("_n"), F.lit(True).alias("_in_n"))
    j = b.join(n, key, "full")
    change = F.when(F.col("_in_n").isNull(), "released").when(F.col("_in_b").isNull(), "announced").when(~F.col("_b").eqNullSafe(F.col("_n")), "changed").otherwise("kept")
    return j.select(*key, change.alias("change"))
