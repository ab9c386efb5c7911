"""Exact top-k search by inner product, with sequential access only.

Each component is a list of the candidates, sorted by that component. For a query, the lists are read from their ends of
greater contributions on, in lockstep, to depths that double from step to step. What has been read of a candidate adds to
its bounds: the lower one counts, for each list in which it hasn't been met, the least contribution of that list, the upper
one the contribution at which that list's reading stands. After each step, the threshold is the k-th best score known from
earlier blocks, or else the k-th best lower bound. Reading stops once no more candidates than can win have an upper bound
that reaches the threshold: outsiders cannot qualify. Their final scores are resolved then. Equal bounds can still
qualify, as ties go to the smaller id, so ties are read on. The bounds of many queries are kept together: with what has been
read of each list as a mask, a step's bounds are one product of matrices.

Queries and candidates are dealt in blocks of bounded bytes; each pair of a query block and a candidate block is a cell
that one task handles, all in one job. Within a cell, candidates go in smaller blocks with lists of their own, and a
query's k best are carried from one to the next, so later ones stop sooner. The cells' best rows meet in a last top-k.

Nulls and the like: vectors that are null, or hold null or non-finite components, take no part, nor do null ids; rows
of equal id are rows of their own, rows that are equal in id and vector are counted, as candidates and as queries; vectors
are only compared with those of equal length; a query with fewer than k candidates gets them all; other columns take no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

#: Bytes of the vectors of a query block and of a candidate block: what a task holds at once.
CELL_BYTES = 16 << 20
#: Candidates whose lists are sorted together.
BLOCK_ROWS = 4096
#: The part of a list that is read in the first step; each further step doubles the depth.
FIRST = 64
#: Queries whose bounds are kept together.
TOGETHER = 512
#: Repeated rows that one row unfolds to.
_STEP = 1 << 14
_EXACT = float(1 << 53)


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * scale)))


class Lists:
    """A block of candidates as lists sorted by each component. times: how often each candidate occurs."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray):
        by_id = np.lexsort((keys, ids))
        self.keys, self.ids, self.times, self.v = keys[by_id], ids[by_id], times[by_id], vectors[by_id]
        order = np.argsort(self.v, axis=0, kind="stable")
        #: Each candidate's place in each list, from the least on, and the lists themselves.
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(len(self.v))[:, None], 0)
        self.lists = np.take_along_axis(self.v, order, 0).astype(np.float64)
        self.exact = self.v.astype(np.float64)
        self.largest = float(np.abs(self.exact).max(initial=0))
        #: Entries read from lists, and what reading all lists to their ends would have been.
        self.reads, self.entries = 0, 0

    def best(self, asked: list[int], queries: np.ndarray, k: int, known: dict[int, list[tuple[int, int, int, int]]]) -> None:
        """Updates known, for each of the asked queries (keys and vectors) the k best (-score, id, key, times), by this block;
        a query's own row is no candidate."""
        bound = np.abs(queries.astype(np.float64)).max(1, initial=0) * self.largest * max(self.v.shape[1], 1)
        for i in np.flatnonzero(bound >= _EXACT):
            self._large(asked[i], queries[i], k, known)
        fine = np.flatnonzero(bound < _EXACT)
        for a in range(0, len(fine), TOGETHER):
            own = fine[a : a + TOGETHER]
            self._some([asked[i] for i in own], queries[own].astype(np.float64), k, known)

    def _large(self, key: int, q: np.ndarray, k: int, known: dict) -> None:
        """Numbers beyond exact doubles: all scores as they are, held within 64 bits."""
        scores = (self.v.astype(object) * q.astype(object)[None, :]).sum(1)
        most = (1 << 63) - 1
        times = np.where(self.keys == key, self.times - 1, self.times)
        found = [(-max(-most, min(most, int(s))), int(i), int(c), int(n)) for s, i, c, n in zip(scores, self.ids, self.keys, times) if n]
        known[key] = _first(sorted([*known.get(key, []), *found]), k)

    def _some(self, asked: list[int], ask: np.ndarray, k: int, known: dict) -> None:
        n, d = self.v.shape
        up, down = np.maximum(ask, 0), np.minimum(ask, 0)
        sides, used = np.concatenate([up, down], 1), (ask != 0).sum(1)
        self.entries += n * int(used.sum())
        # rows of own[i] are no candidates of query i, unless they are repeated
        where = {int(c): i for i, c in enumerate(self.keys)}
        own = [(i, where[c]) for i, c in enumerate(asked) if c in where and self.times[where[c]] == 1]
        thresholds = np.array([_kth(known.get(c, []), k) for c in asked])
        active, at = np.arange(len(asked)), 0
        least = sides @ np.concatenate([self.lists[0], self.lists[-1]])
        while len(active):
            depth = min(n, max(1, -(-n // FIRST) if not at else 2 * at))
            self.reads += int((depth - at) * used[active].sum())
            at = depth
            if at == n:
                alive = np.ones((len(active), n), bool)
                self._resolve(asked, ask, active, alive, own, thresholds, k, known)
                return
            # what has been met: the last `at` places where a query's component is positive, the first ones where negative
            met = np.concatenate([self.place >= n - at, self.place < at], 1)
            stand = np.concatenate([self.lists[n - at], self.lists[at - 1]])
            both = np.concatenate([self.exact, self.exact], 1)
            upper = sides[active] @ ((both - stand) * met).T + (sides[active] @ stand)[:, None]
            self._mask(upper, active, own)
            open_ = np.flatnonzero(~np.isfinite(thresholds[active]))
            if len(open_) and n - len(own) >= k:
                worst = np.concatenate([self.lists[0], self.lists[-1]])
                lower = sides[active[open_]] @ ((both - worst) * met).T + least[active[open_]][:, None]
                self._mask(lower, active[open_], own)
                floor = np.full(len(active), -np.inf)
                floor[open_] = np.partition(lower, n - k, 1)[:, n - k] if n >= k else -np.inf
            else:
                floor = np.full(len(active), -np.inf)
            alive = upper >= np.maximum(thresholds[active], floor)[:, None]
            done = np.flatnonzero(alive.sum(1) <= k)
            if len(done):
                self._resolve(asked, ask, active[done], alive[done], own, thresholds, k, known)
                active = np.delete(active, done)

    @staticmethod
    def _mask(bounds: np.ndarray, rows: np.ndarray, own: list[tuple[int, int]]) -> None:
        at = {int(r): i for i, r in enumerate(rows)}
        for r, c in own:
            if r in at:
                bounds[at[r], c] = -np.inf

    def _resolve(self, asked, ask, rows, alive, own, thresholds, k: int, known: dict) -> None:
        """Final scores of the candidates that can still qualify."""
        scores = np.where(alive, ask[rows] @ self.exact.T, -np.inf) if alive.all() else np.full(alive.shape, -np.inf)
        if not alive.all():
            for i, r in enumerate(rows):
                c = np.flatnonzero(alive[i])
                scores[i, c] = self.exact[c] @ ask[r]
        self._mask(scores, rows, own)
        for i, r in enumerate(rows):
            key = asked[r]
            c = np.flatnonzero((scores[i] >= thresholds[r]) & np.isfinite(scores[i]))
            if len(c) > k:
                # all of greater scores, and of the k-th score those of the least ids: the block is in ascending order of id
                own_scores = scores[i, c]
                kth = np.partition(own_scores, len(c) - k)[len(c) - k]
                c = np.concatenate([c[own_scores > kth], c[own_scores == kth][:k]])
            times = np.where(self.keys[c] == key, self.times[c] - 1, self.times[c])
            found = [(-int(s), int(j), int(g), int(t)) for s, j, g, t in zip(scores[i, c], self.ids[c], self.keys[c], times) if t]
            known[key] = _first(sorted([*known.get(key, []), *found]), k)


def _kth(known: list[tuple[int, int, int, int]], k: int) -> float:
    held = 0
    for s, _, _, n in known:
        held += n
        if held >= k:
            return float(-s)
    return -np.inf


def _first(found: list[tuple[int, int, int, int]], k: int) -> list[tuple[int, int, int, int]]:
    """The first rows that occur k times together."""
    held = 0
    for i, x in enumerate(found):
        held += x[3]
        if held >= k:
            return found[: i + 1]
    return found


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, ids, times, vectors) for each length of vector in a batch (key, id, times, vector)."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
    off = batch.column(3).offsets.to_numpy()
    flat, sizes = batch.column(3).values.to_numpy(zero_copy_only=False), np.diff(off)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield *(c[rows] for c in columns), flat[off[rows][:, None] + np.arange(d)[None, :]] if d else np.zeros((len(rows), 0), np.int64)


class _Cell:
    """A query block and the candidates that have come of its candidate block."""

    def __init__(self, k: int):
        self.k, self.asked, self.held, self.best = k, {}, {}, {}

    def ask(self, batch: pa.RecordBatch) -> None:
        for found in _vectors(batch):
            self.asked.setdefault(found[3].shape[1], []).append(found)

    def meet(self, batch: pa.RecordBatch) -> None:
        for found in _vectors(batch):
            d = found[3].shape[1]
            if d in self.asked:
                self.held.setdefault(d, []).append(found)
                if sum(len(x[0]) for x in self.held[d]) >= BLOCK_ROWS:
                    self._search(d)

    def _search(self, d: int) -> None:
        rows = [np.concatenate(x) for x in zip(*self.held.pop(d))]
        for a in range(0, len(rows[0]), BLOCK_ROWS):
            block = Lists(*(x[a : a + BLOCK_ROWS] for x in rows))
            for keys, _, _, vectors in self.asked[d]:
                block.best(keys.tolist(), vectors, self.k, self.best)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for d in list(self.held):
            self._search(d)
        found = [(key, i, -s, n) for key, own in self.best.items() for s, i, _, n in own]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query", "id", "score", "times"])


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
            for a, b in zip(cuts, cuts[1:]):
                number, side = divmod(int(where[a]), 2)
                if number != at:
                    if cell is not None:
                        yield from cell.rows()
                    at, cell = number, _Cell(k)
                own = batch.slice(a, b - a).select([2, 3, 4, 5])
                # slices of lists keep the offsets of the whole
                own = pa.RecordBatch.from_arrays([*own.columns[:3], pa.concat_arrays([own.column(3)])], names=["key", "id", "times", "vector"])
                cell.meet(own) if side else cell.ask(own)
        if cell is not None:
            yield from cell.rows()

    return run


def numbered(vectors: DataFrame) -> DataFrame:
    """vectors (id, vector) as written rows key, id, times, vector: rows that are equal in both are one row, counted."""
    rows = vectors.where("id is not null and vector is not null").groupBy("id", "vector").agg(F.count("*").alias("times"))
    return written(rows.select(F.monotonically_increasing_id().alias("key"), "id", "times", "vector"), "vectors")


def top_k(candidates: DataFrame, asked: Column, k: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """For each row of candidates (id, vector of long) for which asked holds, the k best of all other rows: query_id,
    rank from 1, id, score."""
    spark = candidates.sparkSession
    rows = numbered(candidates)
    bytes_ = F.coalesce(F.sum(F.size("vector").cast("long") * 8 + 40), F.lit(0))
    queries = rows.where(asked)
    q_blocks = max(1, -(-queries.agg(bytes_.alias("b")).first().b // cell_bytes))
    cores = spark.sparkContext.defaultParallelism
    c_blocks = max(1, -(-rows.agg(bytes_.alias("b")).first().b // cell_bytes), -(-2 * cores // q_blocks))

    def dealt(df: DataFrame, side: int, own: int, others: int, number) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(side), "key"), F.lit(own))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return df.withColumn("own", mine).withColumn("other", other).select(number(F.col("own"), F.col("other")).cast("long").alias("cell"), F.lit(side).alias("side"), "key", "id", "times", "vector")

    cells = dealt(queries, 0, q_blocks, c_blocks, lambda own, other: own * c_blocks + other).unionByName(dealt(rows, 1, c_blocks, q_blocks, lambda own, other: other * c_blocks + own))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(q_blocks * c_blocks, 20_000))
    found = cells.repartition(n, "cell").sortWithinPartitions("cell", "side").mapInArrow(_searcher(k), "query long, id long, score long, times long")
    # a row that occurs k times or more fills all ranks
    each = found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")
    # a query row that is repeated unfolds in steps, after the join
    names = queries.select(F.col("key").alias("query"), F.col("id").alias("query_id"), "times", F.explode(F.sequence(F.lit(1).cast("long"), "times", F.lit(_STEP).cast("long"))).alias("from"))
    own = F.explode(F.sequence("from", F.least("times", F.col("from") + _STEP - 1)))
    return names.hint("merge").join(best.hint("merge"), "query").select("query_id", "rank", "id", "score", own.alias("time")).drop("time")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("vector"))
    return top_k(rows, F.col("id") % 50 == 0, 5).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.row, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
