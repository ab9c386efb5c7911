"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Texts of equal words form a class, and one document stands for it. Each
class gets a signature of minwise tokens. In each of several independent trees, a node chooses some of the signature's
positions by its own randomness and sends each document to one child a position, named by the document's token there:
documents of similarity s share a child with probability s a position, others seldom. Nodes of one document end; nodes
of a bounded number are finished within a task, which branches them on down to leaves and compares each leaf's
signatures exhaustively; larger nodes are branched on as tables, level by level. Nodes that are still too large after
all levels are compared in blocks of two parts, so none is cut short. Large groups of near copies, which no branching parts,
are found by pivots: see nodes().

Recall: below the root a node chooses so many positions that a pair at the threshold shares BRANCHES children on
average, and the chance that none of its paths goes on through all levels is taken from that branching process (_through).
The roots of all trees are so many that a pair at the threshold is missed less often than 1 - RECALL allows even where
its nodes need all LEVELS. The roots' tokens have 64 bits, so that strangers do not meet there; the others have 32 bits, as
they only tell the documents of one node apart. A token is a hash of the least element, not its value, so tokens of
large sets don't crowd.

A leaf names no pairs. Documents whose signatures may reach the threshold form its clusters, and each different cluster
is confirmed once: a task takes the full sets of its members, counts all intersections as products of blocks of their
incidence matrix, and names each member's least linked one. A cluster of more than CELL_HASHES hashes is cut into parts,
and each two parts are confirmed together, so a task's memory is bounded by bytes, not by members. What is emitted grows
with the members, not with their pairs, and every pair of a cluster is compared on full sets. Links join components.
The signature's filter lies 4.5 standard deviations below the threshold.

Nulls and the like: a null or empty text has an empty set and is linked with nothing, nor is a null doc_id (its
component is null, and it is kept); a text with fewer words than a shingle is one shingle; rows that share a
doc_id count as one document, linked by the texts of any of them; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, slices, spread, table, text_or_empty, written

THRESHOLD = 80
TOKENS = 96
RECALL = 0.99999
#: Children that a pair at the threshold shares on average, below the root.
BRANCHES = 2
#: The most documents of a node that one task finishes, and of a leaf.
NODE_ROWS, LEAF_ROWS = 20_000, 4096
#: Nodes up to this size are compared once, however many trees find them.
LISTED = 64
LEVELS = 12
#: Hashes of the sets that a task confirms together, about.
CELL_HASHES = 4 << 20
#: Ids that are broadcast, eight bytes each, to find their texts.
SENT_IDS = 1 << 20

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 1 << 63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
    """(hashes of all rows' shingles, offsets of the rows in them, the words, their hashes)."""
    w = Words(col)
    h = w.hashes()
    counts = np.diff(w.first)
    n = len(h)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(off[-1], np.uint64)
    with np.errstate(over="ignore"):
        if n >= k:
            every = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                every += h[j : n - k + 1 + j] * _PLACE[j]
            long = np.flatnonzero(counts >= k)
            inner = np.repeat(w.first[long] - off[long], sizes[long])
            into = np.repeat(off[long], sizes[long]) + _ramp(sizes[long])
            out[into] = every[into + inner]
        for r in np.flatnonzero((counts > 0) & (counts < k)):
            own = h[w.first[r] : w.first[r + 1]]
            out[off[r]] = (own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), off, w, h


def _ramp(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def sketches(docs: DataFrame, k: int, roots: list[int]) -> DataFrame:
    """docs (doc_id, text) to doc_id, digest (of the words), n_shingles, signature (32-bit tokens) and roots (64-bit tokens
    of the given positions); the last two are null without shingles."""
    wide = sorted(set(roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, 1):
                sh, off, w, h = shingles(s.column(1), k)
                full = np.flatnonzero(np.diff(off) > 0)
                sig, own = np.zeros((len(full), TOKENS), "<u4"), np.zeros((len(full), len(wide)), ">u8")
                with np.errstate(over="ignore"):
                    for t in range(TOKENS if len(full) else 0):
                        token = mix(np.minimum.reduceat(sh * _A[t] + _B[t], off[full]))
                        sig[:, t] = token >> np.uint64(32)
                        if t in wide:
                            own[:, wide.index(t)] = token
                n = [len(np.unique(sh[a:b])) for a, b in zip(off, off[1:])]
                digests = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(w.first, w.first[1:])]
                signatures: list[list[bytes | None]] = [[None] * s.num_rows, [None] * s.num_rows]
                for i, r in enumerate(full):
                    signatures[0][r], signatures[1][r] = sig[i].tobytes(), own[i].tobytes()
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in signatures)], names=["doc_id", "digest", "n_shingles", "signature", "roots"])

    return spread(docs.select("doc_id", text_or_empty().alias("text"))).mapInArrow(run, "doc_id long, digest binary, n_shingles long, signature binary, roots binary")


def _through(levels: int) -> float:
    """The chance that a pair at the threshold still shares a node so many levels below one that it shares: shared
    children are about Poisson distributed, with the mean BRANCHES."""
    p = 1.0
    for _ in range(levels):
        p = 1 - float(np.exp(-BRANCHES * p))
    return p


def root_positions(threshold: float, recall: float, levels: int = LEVELS) -> list[tuple[int, int]]:
    """(tree, position) for the roots of all trees: each position of a tree with probability 1 / (threshold *
    TOKENS), one at least; trees until a pair at the threshold is missed less often than 1 - recall allows."""
    rng, found = np.random.default_rng(7), []
    needed = np.log(1 - recall) / np.log(1 - threshold * _through(levels))
    tree = 0
    while len(found) < needed:
        own = np.flatnonzero(rng.random(TOKENS) < 1 / (threshold * TOKENS))
        found += [(tree, int(i)) for i in (own if len(own) else [rng.integers(TOKENS)])]
        tree += 1
    return found


def _token(position):
    return F.substring(F.col("signature"), (position * 4 + 1).cast("int"), F.lit(4))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of batches sorted by their first column (long), as (key, other columns) a key. Signature columns become
    matrices."""

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for c in batch.columns:
            if pa.types.is_binary(c.type):
                out.append(np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(len(c), -1))
            else:
                out.append(c.to_numpy(zero_copy_only=False))
        return out

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now)]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(now[0])) + 1])
        for a, b in zip(cuts, cuts[1:]):
            yield int(now[0][a]), [x[a:b] for x in now[1:]]
        held = [x[cuts[-1] :] for x in now]
    if held is not None:
        yield int(held[0][0]), held[1:]


def _likely(threshold: float) -> int:
    """Equal tokens from which on a pair may reach the threshold."""
    return int(np.floor(TOKENS * threshold - 4.5 * np.sqrt(TOKENS * threshold * (1 - threshold))))


def _clusters(ids: np.ndarray, sig: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Ids that are connected by pairs of signatures with enough equal tokens, two or more."""
    while len(ids) > 1:
        members, open_ = [ids[:1]], [sig[0]]
        ids, sig = ids[1:], sig[1:]
        while open_ and len(ids):
            near = (sig == open_.pop()).sum(1) >= least
            if near.any():
                members.append(ids[near])
                open_ += list(sig[near])
                ids, sig = ids[~near], sig[~near]
        if len(members) > 1:
            yield np.concatenate(members)


def _branch(ids: np.ndarray, sig: np.ndarray, key: int, least: int, threshold: float, depth: int = 0) -> Iterator[np.ndarray]:
    # positions at which all tokens agree wouldn't part the node
    parts = np.flatnonzero((sig != sig[0]).any(0)) if len(ids) > LEAF_ROWS and depth < LEVELS else ()
    if not len(parts):
        yield from _clusters(ids, sig, least)
        return
    rng = np.random.default_rng([key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF, depth])
    own = parts[rng.random(len(parts)) < BRANCHES / (threshold * len(parts))]
    for p in own if len(own) else [rng.choice(parts)]:
        order = np.argsort(sig[:, p], kind="stable")
        cuts = np.flatnonzero(np.diff(sig[order, p])) + 1
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                yield from _branch(ids[rows], sig[rows], key * 31 + int(sig[rows[0], p]) + int(p), least, threshold, depth + 1)


def _cells(ids: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A cluster's ids, whole if its sets hold at most so many hashes; else each two of the parts that hold half as many,
    or a single set."""
    part = np.cumsum(sizes) - sizes
    part = np.cumsum(np.concatenate([[0], np.diff(2 * part // most) > 0])) if sizes.sum() > most else np.zeros(len(ids), np.int64)
    n = int(part[-1]) + 1
    if n <= 2:
        yield ids
        return
    own = [ids[part == i] for i in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            yield np.concatenate([own[i], own[j]])


def _finisher(threshold: float, most: int):
    """Nodes (node, id, n_shingles, signature) to cells of clusters (cluster, id), each named by its members."""
    least = _likely(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, members, held, seen = [], [], 0, set()
        for key, (ids, sizes, sig) in _groups(batches):
            rows = np.arange(len(ids))
            for found in _branch(rows, sig, key, least, threshold) if len(ids) > 2 else [rows] * int((sig[0] == sig[1]).sum() >= least):
                found = found[np.argsort(ids[found], kind="stable")]
                for own in _cells(ids[found], sizes[found], most):
                    name = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                    if name not in seen:
                        seen.add(name)
                        names.append(np.full(len(own), name, np.int64))
                        members.append(own)
                        held += len(own)
                    if held > 50_000:
                        yield _columns(("cluster", "id"), names, members)
                        names, members, held = [], [], 0
            # names already given only save work; a task forgets them rather than grow
            if len(seen) > 1_000_000:
                seen.clear()
        if held:
            yield _columns(("cluster", "id"), names, members)

    return run


def _columns(names: tuple[str, ...], *parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), pa.int64()) for p in parts], names=list(names))


#: Bytes of an incidence block, and rows of an intersection block.
_BLOCK_BYTES, _BLOCK_ROWS = 64 << 20, 1024


def _linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """For each of the sets, the number of the first one that it reaches by links; all pairs are compared."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if both and 100 * both >= threshold * (sizes.sum() - both) else 1])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what a single set holds is in no intersection
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[at]
    row = np.repeat(np.arange(n), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width, total = max(64, _BLOCK_BYTES // (4 * n)), int(column[-1]) + 1 if len(column) else 0
    links = np.zeros((n, -(-n // 8)), np.uint8)
    for a in range(0, n, _BLOCK_ROWS):
        both = np.zeros((min(_BLOCK_ROWS, n - a), n), np.float32)
        for c in range(0, total, width):
            low, high = np.searchsorted(column, [c, c + width])
            m = np.zeros((n, min(width, total - c)), np.float32)
            m[row[low:high], column[low:high] - c] = 1
            both += m[a : a + _BLOCK_ROWS] @ m.T
        shared = both.astype(np.int64)
        ok = (shared > 0) & (100 * shared >= threshold * (sizes[a : a + _BLOCK_ROWS, None] + sizes[None, :] - shared))
        links[a : a + _BLOCK_ROWS] = np.packbits(ok, axis=1)
    first, free = np.arange(n), np.ones(n, bool)
    for v in range(n):
        if free[v]:
            free[v], open_ = False, [v]
            while open_:
                near = np.flatnonzero(np.unpackbits(links[open_.pop()], count=n).astype(bool) & free)
                first[near], free[near] = v, False
                open_ += near.tolist()
    return first


def _confirmer(k: int, threshold: int):
    """Clusters (cluster, id, text), sorted, to links (a, b): a is the least id that b reaches within the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                own = np.array(ids, np.int64)
                order = np.argsort(own, kind="stable")
                first = _linked([sets[i] for i in order], threshold)
                a, b = own[order][first], own[order]
                if (a != b).any():
                    yield _columns(("a", "b"), [a[a != b]], [b[a != b]])

        for batch in batches:
            for s in slices(batch, 2):
                sh, off, _, _ = shingles(s.column(2), k)
                for i, (c, d) in enumerate(zip(s.column(0).to_pylist(), s.column(1).to_pylist())):
                    if c != key:
                        yield from links()
                        key, ids, sets = c, [], []
                    ids.append(d)
                    sets.append(np.unique(sh[off[i] : off[i + 1]]))
        yield from links()

    return run


def _starred(docs: DataFrame, pairs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Those of pairs (pivot, id) that are linked on full sets. A pivot's pairs are dealt to as many tasks as they need; each
    holds the pivot's set and one other."""
    cells = pairs.select("pivot", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).where("id != pivot").distinct()
    cells = written(cells, "stars")
    rows = cells.select("pivot", "salt", "id", F.lit(1).alias("side")).unionByName(cells.select("pivot", "salt", F.col("pivot").alias("id"), F.lit(0).alias("side")).distinct())
    texts = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text"))
    ids = written(rows.select("id").distinct(), "star-ids")
    if ids.count() <= SENT_IDS:
        # few documents are in large nodes: no other text is moved
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    full = rows.hint("merge").join(texts.hint("merge"), "id").withColumn("cell", F.xxhash64("pivot", "salt"))
    n = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            for s in slices(batch, 4):
                sh, off, _, _ = shingles(s.column(4), k)
                a, b = [], []
                for i, (cell, side, pivot, d) in enumerate(zip(*(s.column(c).to_pylist() for c in range(4)))):
                    x = np.unique(sh[off[i] : off[i + 1]])
                    if cell != at:
                        at, own = cell, []
                    if side == 0:
                        own.append(x)
                    else:
                        for y in own:
                            both = len(np.intersect1d(x, y, assume_unique=True))
                            if both and 100 * both >= threshold * (len(x) + len(y) - both):
                                a.append(pivot)
                                b.append(d)
                                break
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["pivot", "id"])

    dealt = full.select("cell", "side", "pivot", "id", "text").repartition(n, "cell").sortWithinPartitions("cell", "side")
    return written(dealt.mapInArrow(run, "pivot long, id long").distinct(), "starred")


def _near_pivot(least: int):
    """Rows (node, id, pivot, signature, pivot_signature) to (node, id, pivot) of equal enough signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (3, 4))
                keep = pa.array((x == y).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(3)], names=["node", "id", "pivot"])

    return run


def nodes(reps: DataFrame, docs: DataFrame, k: int, threshold: int, recall: float, node_rows: int = NODE_ROWS) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes (node, id) of two documents or more and of node_rows at most, a table a level; links (a, b) found on the way).

    A large node is often one large group of near copies, which no choice of positions parts. So before it is branched, its
    documents are compared with one of them, the pivot: first by signature, then on full sets. Those linked with it are of
    one class, and what is left to compare are pairs of different classes: children of one class only end."""
    s = threshold / 100
    positions = root_positions(s, recall)
    wide = sorted({p for _, p in positions})
    roots = [F.xxhash64(F.lit(t), F.lit(p), F.substring(F.col("roots"), 8 * wide.index(p) + 1, 8)) for t, p in positions]
    rows = reps.select("id", F.col("id").alias("cls"), F.explode(F.array(*roots)).alias("node"))
    found, links = [], []
    for level in range(LEVELS):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("n > 1 and low < high").drop("low", "high")
        sized = written(rows.hint("merge").join(sizes.hint("merge"), "node"), "nodes")
        small = sized.where(F.col("n") <= node_rows)
        lists = small.where(F.col("n") <= LISTED).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
        found.append(lists.select(F.xxhash64("ids").alias("node"), F.explode("ids").alias("id")))
        found.append(small.where(F.col("n") > LISTED).select("node", "id"))
        large = sized.where(F.col("n") > node_rows)
        if large.isEmpty():
            return found, links
        signed = written(large.hint("merge").join(reps.select("id", "signature").hint("merge"), "id"), "signed")
        drawn = F.min(F.struct(F.xxhash64("node", "id").alias("h"), F.col("id").alias("pivot"), F.col("cls").alias("pivot_cls"), F.col("signature").alias("pivot_signature")))
        pivots = written(signed.groupBy("node").agg(drawn.alias("p")).select("node", "p.pivot", "p.pivot_cls", "p.pivot_signature"), "pivots")
        both = signed.hint("merge").join(pivots.hint("merge"), "node")
        near = both.select("node", "id", "pivot", "signature", "pivot_signature").mapInArrow(_near_pivot(_likely(s)), "node long, id long, pivot long")
        starred = _starred(docs, written(near, "near-pivots"), k, threshold)
        links.append(starred.select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        known = both.select("node", "id", "cls", "n", "signature", "pivot", "pivot_cls").hint("merge").join(starred.withColumn("linked", F.lit(True)).hint("merge"), ["pivot", "id"], "left")
        large = written(known.select("node", "id", "n", "signature", F.when(F.coalesce("linked", F.lit(False)), F.least("cls", "pivot_cls")).otherwise(F.col("cls")).alias("cls")), "large")
        if level < LEVELS - 1:
            share = int(BRANCHES * (1 << 20) / (s * TOKENS))
            chosen = F.filter(F.array(*[F.lit(i) for i in range(TOKENS)]), lambda i: F.pmod(F.xxhash64("node", i), F.lit(1 << 20)) < share)
            chosen = F.when(F.size(chosen) > 0, chosen).otherwise(F.array(F.pmod(F.xxhash64("node"), F.lit(TOKENS)).cast("int")))
            rows = large.select("id", "cls", "node", "signature", F.explode(chosen).alias("at")).select("id", "cls", F.xxhash64("node", "at", _token(F.col("at"))).alias("node"))
    # what no level has parted: each two parts of a node meet in a block
    several = large.groupBy("node").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("node")
    parts = F.ceil(F.col("n") * 2 / node_rows).cast("int")
    own = large.join(several, "node").select("id", "node", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found.append(other.select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "id"))
    return found, links


def _sorted_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    n = max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key).sortWithinPartitions(key, columns[0]).select(key, *columns)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to id, component (the smallest id reachable), for all linked ids: stars to greater and to smaller
    neighbors in turn, until the edges, each from an id to a smaller one, stay the same."""

    def settled(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def with_least(e: DataFrame) -> DataFrame:
        """Each edge with the least neighbor of its end a. The minima are made within tasks first and written, so that Spark
        can split the join's partitions: an end of any number of edges is no task of its own."""
        least = written(e.groupBy("a").agg(F.min("b").alias("m")), "least")
        return e.hint("merge").join(least.hint("merge"), "a")

    edges, before = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # each edge leads from its greater end; that end's least neighbor takes all
        small = with_least(large).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = written(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
        now = settled(edges)
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, recall: float = RECALL, node_rows: int = NODE_ROWS, cell_hashes: int = CELL_HASHES) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable), kept
    (doc_id = component_id)."""
    s = threshold / 100
    drawn = written(sketches(docs, k, [p for _, p in root_positions(s, recall)]), "sketches")
    named = drawn.where("doc_id is not null and signature is not null")
    one = F.min(F.struct("doc_id", "n_shingles", "signature", "roots"))
    classes = written(named.groupBy("digest").agg(one.alias("d")).select("digest", F.col("d.doc_id").alias("id"), "d.n_shingles", "d.signature", "d.roots"), "classes")
    reps = classes.drop("digest")

    found, starred = nodes(reps, docs, k, threshold, recall, node_rows)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    joined = _sorted_by(rows.hint("merge").join(reps.hint("merge"), "id"), "node", "id", "n_shingles", "signature")
    clusters = written(joined.mapInArrow(_finisher(s, cell_hashes), "cluster long, id long"), "clusters").distinct()
    # a class's text is that of its document's row; equal rows agree in their words
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), text_or_empty().alias("text"))
    full = _sorted_by(clusters.hint("merge").join(texts.hint("merge"), "id"), "cluster", "id", "text")
    links = written(full.mapInArrow(_confirmer(k, threshold), "a long, b long"), "links")
    for x in starred:
        links = links.unionByName(x)
    comp = written(components(links), "components")

    member = classes.select("digest", "id").join(comp.hint("merge"), "id", "left").select("digest", F.coalesce("component", "id").alias("found"))
    each = drawn.select("doc_id", "digest", "n_shingles").join(member.hint("merge"), "digest", "left")
    # an id with several texts is one document: its component is the least that any of them reaches
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return each.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept: one of each component. Rows that are copies within one doc_id count once."""
    found = written(near_duplicates(docs, k, threshold), "near")
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(again)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.reached) AS component_id, s.doc_id = min(r.reached) AS kept
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.sh"""
