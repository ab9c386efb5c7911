"""Toxicity by a classifier chain.

The categories are predicted in a fixed order by linear models. A category's model sees the text's features and the
probabilities of the categories before it; in training these come from models that haven't seen the row (out of
fold): a fold's model has its features chosen, weighed and scaled on the other folds alone. Features are hashed words
and beginnings of words, as present or absent, and four surface measures. A category chooses the features that raise
its odds by their log-likelihood ratio over its training rows, and weighs a feature by the log of the ratio of its
odds, which the linear model then scales. Thresholds are those of the best F1 over the out-of-fold probabilities.

The label table holds two categories, so the chain has two links: low_quality, which is no kind of toxicity but tells
junk from prose, then toxic. train() takes any list of categories.

The models are fitted on the driver, on a bounded sample of the labelled rows: train_rows of them at most, the first
ones by a hash of doc_id, which also gives each row its fold and its place, so reruns agree. All documents are scored,
in whole.

Nulls and the like: a null text is empty; a label that is null is left out of its category's training; a document
labelled twice takes its greater labels; a category whose labels don't have both classes predicts their rate and
rejects nothing; documents may have any other columns, which scored() keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_LETTERS, Words, raw_bytes, slices, spread, table, text_or_empty, written

#: Categories in the order of the chain, and what makes them 1 in the label table.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
TRAIN_ROWS = 20_000
FOLDS = 5
#: Features chosen for each category at most, and the least log-likelihood ratio of one.
CHOSEN, LEAST_RATIO = 4096, 10.0
_BITS = 22
_PREFIXES = (None, 4, 5, 6)
_SURFACE = 4


def hashed(w: Words) -> np.ndarray:
    """Feature numbers of each word, a column for the word and one for each of its beginnings."""
    out = np.empty((len(w.start), len(_PREFIXES)), np.int64)
    for k, most in enumerate(_PREFIXES):
        out[:, k] = ((w.hashes(most) ^ np.uint64(k * 0x9E3779B9)) >> np.uint64(64 - _BITS)).astype(np.int64)
    return out


def surface(col: pa.Array, w: Words) -> np.ndarray:
    """For each text: log of its bytes and of its words, bytes a word, share of bytes outside words."""
    _, off = raw_bytes(col)
    n, words = np.diff(off).astype(float), np.diff(w.first).astype(float)
    inside = np.concatenate([[0], np.cumsum(w.end - w.start)])
    inside = inside[w.first[1:]] - inside[w.first[:-1]]
    return np.stack([np.log1p(n), np.log1p(words), np.minimum(20, inside / np.maximum(words, 1)), 1 - inside / np.maximum(n, 1)], 1)


def present(col: pa.Array, lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, features, surface): each feature once a row; with lookup, only features with a number there, by it."""
    w = Words(col, space=NOT_LETTERS)
    rows = np.repeat(np.arange(len(col)), np.diff(w.first))
    f = hashed(w)
    rows, f = np.repeat(rows, f.shape[1]), f.ravel()
    if lookup is not None:
        f = lookup[f]
        rows, f = rows[f >= 0], f[f >= 0]
    both = np.unique(rows.astype(np.int64) << 32 | f)
    return both >> 32, both & 0xFFFFFFFF, surface(col, w)


@dataclass
class Linear:
    """A logistic model over chosen present features, scaled surface measures and the chain's probabilities so far."""

    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    threshold: float = 2.0

    def logits(self, rows: np.ndarray, f: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.full(len(dense), self.bias) + dense @ self.dense[: dense.shape[1]]
        return z + np.bincount(rows, self.weights[f], len(dense)) if len(self.weights) else z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, f: np.ndarray, dense: np.ndarray, y: np.ndarray, odds: np.ndarray, l2: float = 1.0, steps: int = 300) -> Linear:
    """Logistic regression with an L2 penalty, by accelerated gradient steps over all rows; a feature that is present
    has the value odds[feature]."""
    n_features, value = len(odds), odds[f]
    n, rate = len(y), y.mean() if len(y) else 0.0
    if n == 0 or rate in (0.0, 1.0):
        r = float(np.clip(rate, 1e-4, 1 - 1e-4))
        return Linear(float(np.log(r / (1 - r))), np.zeros(n_features), np.zeros(dense.shape[1]))
    size = n_features + dense.shape[1]
    x, bias = np.zeros(size), float(np.log(rate / (1 - rate)))
    # a bound of the curvature by each row's squared length
    square = np.bincount(rows, value**2, n) + (dense**2).sum(1) + 1
    step = 1 / (0.25 * float(np.percentile(square, 99)) + l2 / n)
    state, before, last = np.concatenate([[bias], x]), np.concatenate([[bias], x]), 1.0
    for _ in range(steps):
        z = state[0] + np.bincount(rows, state[1 : 1 + n_features][f] * value, n) + dense @ state[1 + n_features :]
        g = (sigmoid(z) - y) / n
        grad = np.concatenate([[g.sum()], np.bincount(f, g[rows] * value, n_features), dense.T @ g])
        grad[1:] += l2 / n * state[1:]
        new = state - grad * step
        now = (1 + np.sqrt(1 + 4 * last**2)) / 2
        state, before, last = new + (last - 1) / now * (new - before), new, now
    return Linear(float(before[0]), before[1 : 1 + n_features] * odds, before[1 + n_features :])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on rows are taken, at the greatest F1 over the rows; between two predictions."""
    if not y.any() or y.all():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    k = int(np.argmax(f1))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


@dataclass
class Chain:
    names: list[str]
    features: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    models: list[Linear]

    def lookup(self) -> np.ndarray:
        t = np.full(1 << _BITS, -1, np.int16)
        t[self.features] = np.arange(len(self.features))
        return t

    def predict(self, rows, f, measures) -> np.ndarray:
        """Probabilities, a column a category."""
        dense, found = (measures - self.center) / self.spread, []
        for m in self.models:
            p = sigmoid(m.logits(rows, f, dense))
            dense = np.column_stack([dense, p])
            found.append(p)
        return np.stack(found, 1)


def _chosen(sample: DataFrame, names: list[str], folds: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(features, their log odds ratios) for each (category, fold left out; folds: none is)."""
    k, size = len(names), folds * len(names)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 1 + 2 * size), np.int64)
        for batch in batches:
            for s in slices(batch, 0):
                rows, f, _ = present(s.column(0))
                fold = s.column(2).to_numpy(zero_copy_only=False)
                y = np.stack([s.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)], 1)
                each = np.concatenate([np.nan_to_num(y), ~np.isnan(y)], 1).astype(np.int64)
                ids, where = np.unique(np.concatenate([held[:, 0], f]), return_inverse=True)
                sums = np.zeros((len(ids), 2 * size), np.int64)
                old, new = where[: len(held)], where[len(held) :]
                sums[old] = held[:, 1:]
                for i in range(2 * k):
                    np.add.at(sums, (new, fold[rows] * 2 * k + i), each[rows, i])
                held = np.column_stack([ids, sums])
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(1 + 2 * size)], names=columns)

    kinds = [*(f"pos{i}" for i in range(k)), *(f"n{i}" for i in range(k))]
    columns = ["feature", *[f"{c}_{j}" for j in range(folds) for c in kinds]]
    found = sample.mapInArrow(counts, ", ".join(f"{c} long" for c in columns)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns[1:]])
    totals = {r.fold: r for r in sample.groupBy("fold").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"pos{i}") for i, c in enumerate(names)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(names)]).collect()}
    models = []
    for i in range(k):
        for out in range(folds + 1):
            rest = [j for j in range(folds) if j != out]
            all_a, all_n = (float(sum(totals[j][f"{c}{i}"] for j in rest if j in totals)) for c in ("pos", "n"))
            if not 0 < all_a < all_n:
                continue
            a, n = (sum((F.col(f"{c}{i}_{j}") for j in rest), F.lit(0)).cast("double") for c in ("pos", "n"))

            def part(x, m, rate):
                return F.when((x > 0) & (m > 0), x * F.log(x / (m * rate))).otherwise(F.lit(0.0))

            # log-likelihood ratio of the category in rows with and without the feature
            rate = all_a / all_n
            g = part(a, n, rate) + part(n - a, n, 1 - rate) + part(all_a - a, all_n - n, rate) + part(all_n - n - all_a + a, all_n - n, 1 - rate)
            odds = F.log((a + 0.5) / (n - a + 0.5)) - float(np.log((all_a + 1) / (all_n - all_a + 1)))
            models.append(F.struct(F.lit(i).alias("category"), F.lit(out).alias("out"), g.alias("g"), odds.alias("odds")))
    if not models:
        return {}
    rows = found.select("feature", F.inline(F.array(*models))).where((F.col("g") >= LEAST_RATIO) & (F.col("odds") > 0))
    best = F.row_number().over(W.partitionBy("category", "out").orderBy(F.col("g").desc(), "feature"))
    got: dict[tuple[int, int], dict[int, float]] = {}
    # CHOSEN rows a model at most
    for r in rows.withColumn("best", best).where(F.col("best") <= CHOSEN).collect():
        got.setdefault((r.category, r.out), {})[r.feature] = r.odds
    return {m: (np.array(sorted(x), np.int64), np.array([x[f] for f in sorted(x)])) for m, x in got.items()}


def train(sample: DataFrame, names: list[str], folds: int = FOLDS) -> Chain:
    """sample: text, order (a number that tells rows apart), fold, and a double column a category (null: unknown),
    already bounded."""
    k = len(names)
    sample = sample.select("text", "order", "fold", *names)
    chosen = _chosen(sample, names, folds)
    none = (np.zeros(0, np.int64), np.zeros(0))
    features = np.unique(np.concatenate([f for f, _ in chosen.values()])) if chosen else none[0]
    lookup = np.full(1 << _BITS, -1, np.int32)
    lookup[features] = np.arange(len(features))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch, 0):
                rows, f, m = present(s.column(0), lookup)
                at = np.searchsorted(rows, np.arange(s.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array([f[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array(m.tolist(), pa.list_(pa.float64())), *s.columns[1:]], names=["f", "m", "order", "fold", *names])

    # a bounded sample of rows, of chosen features only
    got = sample.mapInArrow(vectors, "f binary, m array<double>, order long, fold int, " + ", ".join(f"{c} double" for c in names)).toPandas().sort_values("order", kind="stable")
    each = [np.frombuffer(b, "<i4") for b in got["f"]]
    f = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each]) if each else np.zeros(0, np.int64)
    m, fold = np.array(got["m"].tolist()).reshape(-1, _SURFACE), got["fold"].to_numpy(int)

    def fitted(i: int, out: int, own: np.ndarray, earlier: np.ndarray, y: np.ndarray):
        """A category's model of the rows own, and a function to its logits of any rows."""
        ids, odds = chosen.get((i, out), none)
        center, spread = (m[own].mean(0), m[own].std(0) + 1e-6) if own.any() else (np.zeros(_SURFACE), np.ones(_SURFACE))
        number = np.full(len(features) + 1, -1)
        number[np.searchsorted(features, ids)] = np.arange(len(ids))

        def of(which: np.ndarray):
            r, x = _rows(rows, number[f], which)
            return r[x >= 0], x[x >= 0], np.column_stack([(m[which] - center) / spread, earlier[which]])

        r, x, dense = of(own)
        model = fit(r, x, dense, y[own], odds)
        return model, ids, center, spread, lambda which: model.logits(*of(which))

    earlier, links = np.zeros((len(m), 0)), []
    for i, name in enumerate(names):
        y = got[name].to_numpy(float)
        known, out = ~np.isnan(y), np.zeros(len(m))
        for j in range(folds):
            if (fold == j).any():
                out[fold == j] = sigmoid(fitted(i, j, known & (fold != j), earlier, y)[-1](fold == j))
        model, ids, center, spread, _ = fitted(i, folds, known, earlier, y)
        model.threshold = best_threshold(out[known], y[known] > 0)
        links.append((model, ids, center, spread))
        earlier = np.column_stack([earlier, out])
    # one numbering of features and one scale for all links
    features = np.unique(np.concatenate([x[1] for x in links]))
    chain = Chain(list(names), features, links[0][2], links[0][3], [])
    for model, ids, center, spread in links:
        weights = np.zeros(len(features))
        weights[np.searchsorted(features, ids)] = model.weights
        own = model.dense[:_SURFACE]
        bias = model.bias + float((own * (chain.center - center) / spread).sum())
        chain.models.append(Linear(bias, weights, np.concatenate([own * chain.spread / spread, model.dense[_SURFACE:]]), model.threshold))
    return chain


def _rows(rows: np.ndarray, f: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    number = np.cumsum(keep) - 1
    own = keep[rows]
    return number[rows[own]], f[own]


def training_sample(docs: DataFrame, labels: DataFrame, chain=CHAIN, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """At most train_rows labelled documents: text, order (a hash of doc_id), fold, and a column a category."""
    y = labels.where("doc_id is not null").select("doc_id", *[F.expr(f"cast({c} as double)").alias(n) for n, c in chain])
    y = y.groupBy("doc_id").agg(*[F.max(n).alias(n) for n, _ in chain]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # the limit bounds what is broadcast; a document that is repeated counts once
    j = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(y), "doc_id")
    one = j.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(n).alias(n) for n, _ in chain])
    return written(one.select("text", F.xxhash64("doc_id").alias("order"), F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), *[n for n, _ in chain]), "labelled")


def scored(docs: DataFrame, model: Chain, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with a probability column p_<category> and a boolean column <category> for each category; own columns of
    docs with these names are replaced."""
    added = [f"{prefix}p_{n}" for n in model.names] + [f"{prefix}{n}" for n in model.names]
    docs = docs.drop(*added)
    at, tables = docs.columns.index(text), []
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables[:] = tables or [m.lookup()]
        cut = np.array([x.threshold for x in m.models])
        for batch in batches:
            for s in slices(batch, at):
                rows, f, measures = present(s.column(at), tables[0])
                p = m.predict(rows, f, measures)
                columns = [*s.columns, *[pa.array(p[:, i]) for i in range(p.shape[1])], *[pa.array(p[:, i] >= cut[i]) for i in range(p.shape[1])]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*docs.columns, *added]
    schema = T.StructType(list(docs.schema.fields))
    for i, n in enumerate(added):
        schema = schema.add(n, "double" if i < len(model.names) else "boolean")
    return spread(docs).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    model = train(training_sample(docs, table(spark, sf_dir, "labels")), [n for n, _ in CHAIN])
    return scored(docs, model).select("doc_id", "p_low_quality", "p_toxic", "toxic")
