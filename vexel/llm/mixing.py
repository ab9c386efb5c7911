"""Mixing sources to target weights, with DataFrame operations only.

The words of a source, its documents after another in a pseudorandom order, are one stream, cut into blocks of
fixed length. An output shard has a fixed number of slots; each slot takes one block. For each shard, the counts of its
sources are a multinomial draw: every slot draws a source with the probability of the source's share of all slots.
The draws are then conditioned on the targets: where the draws of all shards together ask for more blocks of a source
than its target has, the excess, of the order of the square root of the draws, is taken back from pseudorandomly chosen
shards and drawn anew among the sources that got too few, without replacement. So the mix as a whole holds its targets
and no source is read more often than its limit allows. The j-th slot of a source reads block P(j mod n) of its n
blocks, where P is a pseudorandom permutation of its own for each pass; slots and blocks then meet in an equi-join by
(source, block index).

Nulls, ties and the like: a null text has size 0; a null source is a source, last in order; rows that are equal
in all key columns are copies, numbered and handled as documents of their own. An empty table gives an empty mix.
Other columns take no part, but mixed_documents() keeps them.

Bound: the table of sources is sorted in one task to share the targets out (a running sum over sources), so it should
stay within some millions of rows; nothing else goes by source alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, text_or_empty, written

WEIGHTS = (5.0, 2.0, 1.0)
#: A source is read this many times at most.
MOST_PASSES = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: Slots or shards that one row unfolds to.
_STEP = 1 << 14
#: Rows of a running sum that one task adds up.
_RUN = 1 << 10
#: Parts in which the range of all slots is searched.
_PARTS = 1 << 12


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def permuted(x: Column, n: Column, key: Column, rounds: int = 24) -> Column:
    """A pseudorandom permutation of 0 .. n-1 (swap-or-not): in each round, x and K - x mod n trade places if the
    bit that a hash gives their greater one is set. It needs no walk back into a domain, whatever n is."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(key, r) % n - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), x, swap)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """sizes (source, source_size) with rank (from 1, by code point, null last), weight and target.

    Targets share the total of all sizes by weight. None exceeds `most` times its source's size; the excess goes
    to the others by weight, until none is above: with sources in ascending order of limit / weight, the first
    ones are at their limit and all others at one level times their weight. One row a source, so the windows
    over all sources sort a table as small as the list of sources."""
    all_rows = W.partitionBy()
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(w, (F.col("rank") - 1) % len(weights) + 1))
    s = s.withColumn("limit", F.col("source_size") * float(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("level") >= F.col("ratio"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(all_rows)
    return s.select("source", "source_size", "rank", "weight", F.when(F.col("full"), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


@dataclass
class Mix:
    """sources: a row a source. counts: the blocks of each source in each shard (shard, rank, drawn, blocks): as the shard
    drew them, and as they are after conditioning on the targets. slots: a row a slot of the output (rank, pass, block,
    shard, place). pieces: a row for each document and block that it has words in (the key columns, copy, rank, target,
    block, word_from, word_to; block is null for a document without words)."""

    sources: DataFrame
    counts: DataFrame
    slots: DataFrame
    pieces: DataFrame


def _unfolded(rows: DataFrame, n: str, name: str, partitions: int) -> DataFrame:
    """Each row n times, with name from 0 to n - 1, in steps so that no row unfolds to many in one task."""
    keys = rows.columns
    steps = rows.where(F.col(n) > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(_STEP).cast("long"))))
    steps = steps.repartition(partitions, *keys, "_from")
    return steps.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + _STEP, F.col(n)) - 1))).drop("_from")


def _before(rows: DataFrame, value: str, order: str, by: str | None, name: str) -> DataFrame:
    """rows with the sum of value over all rows of a lesser order (a number from 0 without gaps, about) of the same group:
    sums of runs first, then rows within a run."""
    run = F.expr(f"{order} div {_RUN}")
    keys = ([by] if by else []) + ["_run"]
    rows = rows.withColumn("_run", run)
    up_to = W.partitionBy(*([by] if by else [])).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    runs = runs.select(*keys, F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_at"))
    within = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(runs.hint("merge"), keys).withColumn(name, F.col("_at") + F.col("_in")).drop("_run", "_at", "_in")


def _ranges(rows: DataFrame, first: str, size: str, total: int, columns: list[str]) -> tuple[DataFrame, int]:
    """rows as ranges of the numbers below total, unfolded to the equal parts of them that they reach into; and the
    parts' width."""
    width = max(1, -(-total // _PARTS))
    end = F.col(first) + F.col(size)
    part = F.explode(F.sequence(F.expr(f"{first} div {width}"), F.expr(f"({first} + {size} - 1) div {width}")))
    return rows.where(F.col(size) > 0).select(*columns, F.col(first).alias("_low"), end.alias("_high"), part.alias("_part")), width


def _found(points: DataFrame, x: Column, ranges: DataFrame, width: int) -> DataFrame:
    """points with the columns of the range that x falls in."""
    p = points.withColumn("_x", x).withColumn("_part", F.expr(f"_x div {width}"))
    # at most a row a range and a part, but how many ranges there are isn't known here
    return p.join(ranges.hint("merge"), "_part").where("_x >= _low and _x < _high").drop("_x", "_part", "_low", "_high")


def drawn_counts(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial draws of each shard's counts (shard, rank, drawn), and the counts conditioned on the sources' n_slots
    (blocks): rows shard, rank, drawn, blocks."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first().n
    shards = -(-total // shard_slots)
    partitions = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = spark.createDataFrame([(total,)], "n long")
    places = _unfolded(one, "n", "at", partitions).select(F.expr(f"at div {shard_slots}").alias("shard"), "at")
    ranges, width = _ranges(sources, "first_slot", "n_slots", total, ["rank"])
    x = F.pmod(F.xxhash64(F.lit(seed + 1), "at"), F.lit(max(1, total)))
    drawn = _found(places, x, ranges, width).groupBy("shard", "rank").agg(F.count("*").alias("drawn"))
    # where a source has been drawn too often, the shards that keep their draws come in a pseudorandom order
    order = permuted(F.col("shard"), F.lit(max(1, shards)).cast("long"), F.xxhash64(F.lit(seed + 2), "rank"))
    drawn = written(drawn.withColumn("order", order), "mix-drawn")
    drawn = _before(drawn, "drawn", "order", "rank", "before").join(sources.select("rank", "n_slots").hint("merge"), "rank")
    kept = F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("n_slots") - F.col("before")))
    drawn = written(drawn.select("shard", "rank", "order", "n_slots", "drawn", kept.alias("kept")), "mix-kept")
    # what has been taken back, numbered, is dealt by a permutation to what sources lack
    lack = sources.select("rank", "n_slots").join(drawn.groupBy("rank").agg(F.sum("kept").alias("kept")).hint("merge"), "rank", "left")
    lack = lack.select("rank", (F.col("n_slots") - F.coalesce("kept", F.lit(0))).alias("lack")).where("lack > 0")
    lack = written(lack.withColumn("first", F.coalesce(F.sum("lack").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "mix-lack")
    missing = lack.agg(F.coalesce(F.sum("lack"), F.lit(0)).alias("n")).first().n
    back = drawn.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("back")).where("back > 0")
    back = _unfolded(_before(back, "back", "shard", None, "first_back"), "back", "i", partitions)
    ranges, width = _ranges(lack, "first", "lack", missing, ["rank"])
    again = permuted(F.col("first_back") + F.col("i"), F.lit(max(1, missing)).cast("long"), F.xxhash64(F.lit(seed + 3)))
    redrawn = _found(back, again, ranges, width).select("shard", "rank", F.lit(0).cast("long").alias("drawn"), F.lit(1).cast("long").alias("blocks"))
    both = drawn.select("shard", "rank", "drawn", F.col("kept").alias("blocks")).unionByName(redrawn)
    return written(both.groupBy("shard", "rank").agg(F.sum("drawn").alias("drawn"), F.sum("blocks").alias("blocks")), "mix-counts")


def mix(docs: DataFrame, keys: list[str], weights=WEIGHTS, most: int = MOST_PASSES, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> Mix:
    """docs: a narrow table with columns source and size and the key columns, which tell documents apart."""
    spark = docs.sparkSession
    n = docs.count()
    # chunks of about the square root of the rows: neither a chunk nor the list of a source's chunks grows large
    chunks = max(1, round(n**0.5))
    rows = docs.groupBy("source", "size", *keys).agg(F.count("*").alias("n"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "size", *keys, "copy")).withColumn("chunk", F.pmod("order", F.lit(chunks)))

    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    sources = written(_with_slots(source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), block, most), "mix-sources")
    own = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("chunk_start", F.coalesce(F.sum("words").over(own), F.lit(0)))
    offsets = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "o.chunk", "chunk_start", "source_size", "rank", "target")
    within = W.partitionBy("source", "chunk").orderBy("order", *keys, "size", "copy").rowsBetween(W.unboundedPreceding, -1)
    d = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.chunk") == F.col("o.chunk")))
    d = d.withColumn("start", F.col("chunk_start") + F.col("before")).withColumn("end", F.col("start") + F.col("size"))
    own_blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}")))
    pieces = d.select(*[F.col(f"d.{c}") for c in keys], F.col("d.source").alias("source"), "size", "copy", "source_size", "rank", "target", "start", "end", F.explode_outer(own_blocks).alias("block"))
    begin = F.col("block") * block
    pieces = pieces.select(*keys, "source", "size", "copy", "source_size", "rank", "target", "block", (F.greatest("start", begin) - F.col("start")).alias("word_from"), (F.least("end", begin + block) - F.col("start")).alias("word_to"))

    counts = drawn_counts(sources, shard_slots, seed)
    slots = _slots(sources, counts, shard_slots, seed, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return Mix(sources, counts, slots, pieces)


def _with_slots(s: DataFrame, block: int, most: int) -> DataFrame:
    """Adds n_blocks, n_slots, and the first slot's number over all sources."""
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(F.lit(0))
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("passes", passes.cast("long"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))
    s = s.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.least(F.when(F.col("passes") < most, F.round(rest / block)).otherwise(F.lit(0.0)).cast("long"), F.col("n_blocks")))
    return s.withColumn("first_slot", F.coalesce(F.sum("n_slots").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def _slots(sources: DataFrame, counts: DataFrame, shard_slots: int, seed: int, partitions: int) -> DataFrame:
    """The slots of all counts: a source's are numbered over the shards, a shard's over its sources."""
    c = _before(counts.where("blocks > 0"), "blocks", "shard", "rank", "first")
    # a shard has as many sources as slots at most
    own = W.partitionBy("shard").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("first_place", F.coalesce(F.sum("blocks").over(own), F.lit(0))).withColumn("places", F.sum("blocks").over(W.partitionBy("shard")))
    c = c.join(sources.select("rank", "source", "n_blocks").hint("merge"), "rank")
    s = _unfolded(c.select("shard", "rank", "source", "n_blocks", "first", "first_place", "places", "blocks"), "blocks", "i", partitions)
    s = s.withColumn("slot", F.col("first") + F.col("i")).withColumn("pass", F.expr("slot div n_blocks"))
    s = s.withColumn("block", permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(seed), "source", "rank", "pass")))
    place = permuted(F.col("first_place") + F.col("i"), F.col("places"), F.xxhash64(F.lit(seed + 4), "shard"))
    return s.select("rank", "pass", "block", "shard", place.alias("place"))


def taken(m: Mix, keys: list[str]) -> DataFrame:
    """A row for each document and copy: the words that the mix takes of it, and the first shard that has any."""
    used = m.slots.groupBy("rank", "block").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    # what is unfolded from a small table is estimated as small; it must not be broadcast
    j = m.pieces.hint("merge").join(used.hint("merge"), ["rank", "block"], "left")
    words = F.coalesce(F.sum((F.col("word_to") - F.col("word_from")) * F.col("times")), F.lit(0)).cast("long")
    return j.groupBy(*keys, "source", "size", "copy").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), words.alias("taken"), F.min("shard").alias("first_shard"))


def spans(m: Mix, keys: list[str]) -> DataFrame:
    """The mix as runs of words: a row for each document, copy, pass and longest run of its neighboring blocks
    that this pass takes (word_from, word_to)."""
    j = m.pieces.hint("merge").join(m.slots.select("rank", "block", "pass").hint("merge"), ["rank", "block"])
    each = [*keys, "source", "size", "copy", "pass"]
    j = j.withColumn("run", F.col("block") - F.row_number().over(W.partitionBy(*each).orderBy("block")))
    return j.groupBy(*each, "run").agg(F.min("word_from").alias("word_from"), F.max("word_to").alias("word_to"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source, and any others) as the mix takes them, with the same columns: a row for each run of
    words taken, whole documents unchanged, n_chars, if there is one, of the text that is left. Documents without words
    have no words to take and fall out. Of rows that are equal in doc_id, text and source, one gives the other columns."""
    hash_ = next(c for c in ("_text_hash", "_text_hash_", "_text_hash__") if c not in docs.columns)
    keyed = docs.withColumn(hash_, F.xxhash64("text", F.length("text")))
    keys = ["doc_id", hash_]
    narrow = written(keyed.select(*keys, "source", n_words(text_or_empty()).alias("size")), "mix-words")
    runs = spans(mix(narrow, keys, **options), keys)
    # a document's runs are as many as its blocks at most, three times
    part = F.struct("pass", "word_from", "word_to")
    runs = runs.groupBy(*keys, "source", "size", "copy").agg(F.sort_array(F.collect_list(part)).alias("runs"))
    texts = keyed.dropDuplicates(["doc_id", hash_, "source"])
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col(f"r.{hash_}") == F.col(f"t.{hash_}")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    j = runs.alias("r").join(texts.alias("t"), same)

    def whole(run: Column) -> Column:
        return (run["word_from"] == 0) & (run["word_to"] == F.col("r.size"))

    words = F.when(F.exists("r.runs", lambda r: ~whole(r)), F.regexp_extract_all("t.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)))

    def cut(word_list: Column) -> Column:
        def one(run: Column) -> Column:
            own = F.slice(word_list, (run["word_from"] + 1).cast("int"), (run["word_to"] - run["word_from"]).cast("int"))
            return F.when(whole(run), F.col("t.text")).otherwise(F.array_join(own, ""))

        return F.transform("r.runs", one)

    # bound to a variable, the words are found once a document, not once a run
    parts = F.flatten(F.transform(F.array(words), cut))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    j = j.select(*[F.col(f"t.`{c}`") for c in rest], F.explode(parts).alias("text"))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.length("text").cast("long"))
    return j.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text_or_empty()).alias("size"))
    keys = ["doc_id"]
    m = mix(written(docs, "mix-words"), keys)
    return taken(m, keys).select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard")
