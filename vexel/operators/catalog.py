"""The cache catalog as tables: responses (url, bytes, status, expires, accessed, must_revalidate), regions (id, ...) and
claims (region_id, url). Each operation returns the new table; pins are counted from the claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import in_ranges, numbered, starts


def upserted(table: DataFrame, rows: DataFrame, key: list[str], newest: Column | None = None) -> DataFrame:
    """rows take the place of the table's rows of equal key; of several new ones the newest counts."""
    if newest is not None:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(newest.desc()))).where("_n = 1").drop("_n")
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*table.columns))


def refreshed(responses: DataFrame, answers: DataFrame) -> DataFrame:
    """New expiry (url, expires) for resources that were still valid."""
    j = responses.join(answers.select("url", F.col("expires").alias("_e")), "url", "left")
    return j.withColumn("expires", F.coalesce("_e", "expires")).select(*responses.columns)


def fresh(now: Column) -> Column:
    """Whether a response may be served without asking: not expired, or pinned and not bound to be revalidated."""
    unexpired = F.col("expires").isNotNull() & (F.col("expires") > now)
    return unexpired | (F.coalesce(F.col("pins"), F.lit(0)) > 0) & ~F.coalesce(F.col("must_revalidate"), F.lit(False))


def served(requests: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """What to do for each url: serve, revalidate or fetch. Equal requests count once."""
    j = requests.select("url").distinct().join(responses.withColumn("_have", F.lit(True)), "url", "left")
    return j.withColumn("action", F.when(F.col("_have").isNull(), "fetch").when(fresh(now), "serve").otherwise("revalidate")).drop("_have")


def claimed(claims: DataFrame, new: DataFrame) -> DataFrame:
    return claims.unionByName(new.select("region_id", "url")).distinct()


def unclaimed(claims: DataFrame, gone: DataFrame) -> DataFrame:
    return claims.join(gone, ["region_id", "url"], "left_anti")


def pruned(claims: DataFrame, region_id: int, keep: DataFrame) -> DataFrame:
    """A region's claims reduced to those in keep (url)."""
    own = claims.where(F.col("region_id") == region_id).join(keep.select("url"), "url", "left_semi")
    return claims.where(F.col("region_id") != region_id).unionByName(own.select(*claims.columns))


def pinned(responses: DataFrame, claims: DataFrame) -> DataFrame:
    """responses with pins, the regions that claim each."""
    return responses.drop("pins").join(claims.groupBy("url").agg(F.count("*").alias("pins")), "url", "left").withColumn("pins", F.coalesce("pins", F.lit(0)))


def region_deleted(regions: DataFrame, claims: DataFrame, region_id: int) -> tuple[DataFrame, DataFrame]:
    return regions.where(F.col("id") != region_id), claims.where(F.col("region_id") != region_id)


def progress(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """For each region: required resources, those complete, and their bytes."""
    j = claims.join(responses.select("url", "bytes", F.lit(1).alias("_have")), "url", "left")
    return j.groupBy("region_id").agg(F.count("*").alias("required"), F.count("_have").alias("completed"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def sizes(responses: DataFrame) -> DataFrame:
    """Resources and bytes, of all and of pinned ones."""
    is_pinned = F.col("pins") > 0
    return responses.agg(F.count("*").alias("resources"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.when(is_pinned, 1)).alias("pinned"), F.coalesce(F.sum(F.when(is_pinned, F.col("bytes"))), F.lit(0)).alias("pinned_bytes"))


def evicted(responses: DataFrame, capacity: int) -> DataFrame:
    """The unpinned responses that must go so that the most recently used ones fit. The running sum is global but is
    made in two passes: sums of ranges of access time, then rows within each range."""
    newest = [F.col("accessed").desc(), F.col("url").desc()]
    dealt = in_ranges(responses.where("pins = 0"), *newest)
    own = F.sum("bytes").over(W.partitionBy("_part").orderBy(*newest).rowsBetween(W.unboundedPreceding, 0))
    total = dealt.join(F.broadcast(starts(dealt, F.col("bytes"))), "_part").withColumn("running", own + F.col("_start"))
    return total.where(F.col("running") > capacity).select(*responses.columns, "running")


def region_plan(tile_sets: list[dict], z_low: int, z_high: int, cover, extras: DataFrame | None = None) -> DataFrame:
    """All urls of a region: each source's tiles over its zooms within the region's, cover(z) giving tiles (z, x, y); and
    other resources (url)."""
    from ..sources.urls import expand

    parts = [] if extras is None else [extras.select("url", F.lit("resource").alias("kind"))]
    for s in tile_sets:
        for z in range(max(z_low, s["minzoom"]), min(z_high, s["maxzoom"]) + 1):
            t = cover(z)
            parts.append(t.select(expand(s["tiles"][0], z, F.col("x"), F.col("y"), s["scheme"]).alias("url"), F.lit("tile").alias("kind")))
    return reduce(DataFrame.unionByName, parts).distinct()


def estimate(tile_sets: list[dict], z_low: int, z_high: int, count) -> tuple[int, bool]:
    """(tiles, whether that is precise): count(z) tiles a zoom; a source whose tiles aren't known makes it a lower bound."""
    total, precise = 0, True
    for s in tile_sets:
        if not s.get("tiles"):
            precise = False
            continue
        total += sum(count(z) for z in range(max(z_low, s["minzoom"]), min(z_high, s["maxzoom"]) + 1))
    return total, precise


#: Seconds by which an access time must move to be written again.
ACCESS_GRANULARITY = 60


def looked_up(responses: DataFrame, urls: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(the responses of urls, all responses with the access times of those rewritten that are older than the granularity)."""
    asked = urls.select("url").distinct()
    old = F.coalesce(F.col("_asked"), F.lit(False)) & (F.lit(now) - F.col("accessed") > ACCESS_GRANULARITY)
    j = responses.join(asked.withColumn("_asked", F.lit(True)), "url", "left")
    return responses.join(asked, "url", "left_semi"), j.withColumn("accessed", F.when(old, F.lit(now)).otherwise(F.col("accessed"))).select(*responses.columns)


def deleted(responses: DataFrame, urls: DataFrame) -> DataFrame:
    return responses.join(urls.select("url"), "url", "left_anti")


def regions_created(regions: DataFrame, new: DataFrame) -> DataFrame:
    """New regions (without ids; a column ord) get the next ids; they claim nothing yet."""
    top = regions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = numbered(new, ["ord"], "_n").join(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_n")).cast("long"))
    return regions.unionByName(rows.select(*regions.columns))


def listed(regions: DataFrame) -> DataFrame:
    return regions.orderBy("id")


def stored(responses: DataFrame, claims: DataFrame, rows: DataFrame, region_id: int) -> tuple[DataFrame, DataFrame]:
    """Responses that a region has fetched: stored, claimed, and counted by their pins, all from one set of rows."""
    more = claimed(claims, rows.select(F.lit(region_id).cast(claims.schema["region_id"].dataType).alias("region_id"), "url"))
    return pinned(upserted(responses, rows.select(*[c for c in responses.columns if c != "pins"], *([F.lit(0).cast(responses.schema["pins"].dataType).alias("pins")] if "pins" in responses.columns else [])), ["url"]), more), more


def migrated(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """A table of an older form with the columns it lacks: name to (type, value)."""
    have = set(table.columns)
    return table.withColumns({n: F.lit(v).cast(t) for n, (t, v) in columns.items() if n not in have}) if set(columns) - have else table


def downloaded(plan: DataFrame, answers: DataFrame) -> DataFrame:
    """A download's state: of each planned resource whether it is complete, failed (status 404 and the like) or pending."""
    j = plan.select("url").distinct().join(answers.select("url", "status", "bytes"), "url", "left")
    return j.withColumn("state", F.when(F.col("status").isNull(), "pending").when(F.col("status").between(200, 299), "complete").otherwise("failed"))


def region_refreshed(responses: DataFrame, claims: DataFrame, region_id: int, plan: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A region asked again for its resources: answers (url, status, expires, bytes) of status 304 move the expiry, of 200 replace
    the response, others change nothing; claims of what the plan no longer has go."""
    a = answers.select("url", F.col("status").alias("_status"), F.col("expires").alias("_expires"), F.col("bytes").alias("_bytes"))
    j = responses.join(a, "url", "left")
    j = j.withColumn("expires", F.when(F.col("_status").isin(200, 304), F.col("_expires")).otherwise(F.col("expires"))).withColumn("bytes", F.when(F.col("_status") == 200, F.col("_bytes")).otherwise(F.col("bytes")))
    return j.select(*responses.columns), pruned(claims, region_id, plan)
