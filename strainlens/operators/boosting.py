"""Histogram-boosted trees for all folds and classes at once.

Features are cut into at most 255 bins by the training rows of a fold, and
equal binned rows with one label collapse to a cell with a count.  Each round
grows one tree per fold and class, best split first, from softmax gradients.
All trees of a round grow side by side, level by level, from the sums of
gradients, curvatures and rows per feature and bin of every node still to be
judged.  Of two large children the smaller one is summed; the other has what is
left of their parent.

Folds share nothing, so while the cells of each fit the memory of a task, a job
grows many rounds: a task keeps the cells of a fold, knows which of them every
node has, and returns trees and scores.  No task waits for another, and a lost
one starts again from the last written scores.  Folds with more cells take a
job per level, whose tasks route their cells through the trees since the last
written scores, and the driver picks splits.

Trees and histograms depend in size on folds, classes, leaves, features and
bins alone.
"""
from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainlens.session import cut_lineage

BINS = 255
# rounds after which scores are written, so that a pass routes through few trees
KEPT_ROUNDS = 10
# partial histograms of so few tasks are summed by the driver; more are summed by Spark first
DIRECT_TASKS = 8
# jobs that grow all rounds in memory, unless that makes them shorter than KEPT_ROUNDS
KEPT_JOBS = 8
# cells in memory before folds are dealt to more tasks, and the most of a fold (about 200 bytes each while they are read)
BARRIER_CELLS, MOST_CELLS = 1_000, 2_000_000
# a child of fewer rows is always summed: that is cheap, and exact where its parent is much larger
DERIVED_ROWS = 5_000


@dataclass
class Tree:
    """Nodes in order of creation; ``feature`` is -1 at leaves, rows with bin <= ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins), np.int64)
        held = {0: np.arange(len(bins))}
        # children come behind their parents
        for node in np.flatnonzero(self.feature >= 0):
            rows = held.pop(int(node))
            left = bins[rows, self.feature[node]] <= self.cut[node]
            for child, own in ((self.left[node], rows[left]), (self.right[node], rows[~left])):
                held[int(child)] = own
                out[own] = child
        return out


@dataclass
class Settings:
    rounds: int = 200
    rate: float = 0.08
    max_leaves: int = 15
    min_rows: int = 20
    l2: float = 1.0
    min_curvature: float = 1e-3


@dataclass
class Growing:
    """A tree in growth: splits chosen so far among the nodes that are judged."""

    settings: Settings
    sums: list[tuple[float, float, float]] = field(default_factory=list)
    split: dict[int, tuple[float, int, int, tuple, tuple]] = field(default_factory=dict)
    judged: set[int] = field(default_factory=set)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    chosen: list[int] = field(default_factory=list)

    def judge(self, node: int, hist: np.ndarray) -> None:
        """Best split of a node from its sums by feature, bin and (gradient, curvature, rows)."""
        s = self.settings
        self.judged.add(node)
        total = hist[0].sum(axis=0)
        if node == 0:
            self.sums.append(tuple(total))
        left = np.cumsum(hist, axis=1)[:, :-1]
        right = total - left
        score = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.l2)
        gain = score(left) + score(right) - score(total)
        bad = (left[..., 2] < s.min_rows) | (right[..., 2] < s.min_rows) | (left[..., 1] < s.min_curvature) | (right[..., 1] < s.min_curvature)
        gain = np.where(bad, -np.inf, gain)
        at = int(gain.argmax()) if gain.size else 0
        if gain.size and gain.flat[at] > 1e-12:
            f, b = divmod(at, gain.shape[1])
            self.split[node] = (float(gain[f, b]), f, b, tuple(left[f, b]), tuple(right[f, b]))

    def choose(self) -> list[int]:
        """Picks splits, best first, and returns the nodes whose judgement could change them."""
        s = self.settings
        heap, self.chosen, unknown = [], [], []

        def offer(node: int) -> None:
            if node in self.split:
                heapq.heappush(heap, (-self.split[node][0], node))
            elif node not in self.judged and self.sums[node][2] >= 2 * s.min_rows and self.sums[node][1] >= 2 * s.min_curvature:
                unknown.append(node)

        offer(0)
        while heap and len(self.chosen) < s.max_leaves - 1:
            node = heapq.heappop(heap)[1]
            self.chosen.append(node)
            if node not in self.children:
                self.children[node] = (len(self.sums), len(self.sums) + 1)
                self.sums += self.split[node][3:]
            for child in self.children[node]:
                offer(child)
        return unknown

    def summed(self, wanted: list[int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
        """Nodes to be summed so that the wanted ones are known, and parent and sibling of those that follow from these."""
        asked, derived = [], {}
        for parent, pair in self.children.items():
            small, large = sorted(pair, key=lambda node: self.sums[node][2])
            if large in wanted and self.sums[large][2] > DERIVED_ROWS:
                asked.append(small)
                derived[large] = parent, small
            else:
                asked += [node for node in pair if node in wanted]
        return asked or wanted, derived

    def tree(self, every: bool = False) -> Tree:
        """The chosen tree; with ``every`` all splits that were ever tried, to reach the nodes to be judged."""
        n = max(1, len(self.sums))
        out = Tree(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n))
        for node in (self.children if every else self.chosen):
            _, out.feature[node], out.cut[node] = self.split[node][:3]
            out.left[node], out.right[node] = self.children[node]
        for i, (g, h, _) in enumerate(self.sums):
            out.value[i] = -self.settings.rate * g / (h + self.settings.l2)
        return out


@dataclass
class Model:
    """Per fold: medians, inner bin edges per feature, first scores; trees by round, then (fold, class)."""

    folds: list[str]
    medians: np.ndarray
    edges: list[list[np.ndarray]]
    first: np.ndarray
    rounds: list[dict[tuple[int, int], Tree]]

    def binned(self, fold: int, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.medians[fold], x)
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges[fold])], axis=1).astype(np.uint8)

    def scores(self, fold: int, bins: np.ndarray, upto: int | None = None) -> np.ndarray:
        out = np.tile(self.first[fold], (len(bins), 1))
        for trees in self.rounds[:upto]:
            for c in range(out.shape[1]):
                if (fold, c) in trees:
                    t = trees[fold, c]
                    out[:, c] += t.value[t.leaves(bins)]
        return out


def softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- binning

def _cuts(train: DataFrame, features: Sequence[str], folds: list[str]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Medians, and edges halfway between neighbouring values, or between quantiles where values are many."""
    probabilities = [i / BINS for i in range(1, BINS)]
    quantiles = [F.percentile_approx(f, F.lit([0.5, *probabilities]), F.lit(10_000)).alias(f) for f in features]
    found = {r["fold"]: r for r in train.groupBy("fold").agg(*quantiles).collect()}
    at = {f: i for i, f in enumerate(folds)}
    medians = np.array([[(found[f][x] or [0.0])[0] if f in found else 0.0 for x in features] for f in folds])
    # features of few values keep them all; their number is bounded by the bins
    values = train.select("fold", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.coalesce(F.col(x), _literals(folds, medians[:, j])).alias("v")) for j, x in enumerate(features)])).alias("one")).select("fold", "one.j", "one.v").distinct()
    values = cut_lineage(values, "bin-values")
    few = values.groupBy("fold", "j").count().where(F.col("count") <= BINS).select("fold", "j")
    exact: dict[tuple[int, int], list[float]] = {}
    for r in values.join(few, ["fold", "j"]).collect():
        exact.setdefault((at[r["fold"]], r["j"]), []).append(r["v"])
    edges = []
    for i, f in enumerate(folds):
        own = []
        for j, x in enumerate(features):
            v = np.unique(exact.get((i, j)) or ([q for q in found[f][x][1:]] if f in found and found[f][x] else [0.0]))
            own.append((v[1:] + v[:-1]) / 2)
        edges.append(own)
    return medians, edges


def _literals(folds: list[str], values: np.ndarray):
    """The value of a row's fold."""
    out = F.lit(None).cast("double")
    for f, v in zip(folds, values, strict=True):
        out = F.when(F.col("fold") == f, F.lit(float(v))).otherwise(out)
    return out


# --------------------------------------------------------------- training

def _table(n_classes: int) -> T.StructType:
    return T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("bins", T.BinaryType()), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType())] + [T.StructField(f"s{c}", T.DoubleType()) for c in range(n_classes)])


def _blocks(part: pa.RecordBatch, width: int, n_classes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """fold, rows, bins, label, count and scores of a batch, fold by fold."""
    fold = part.column("fold").to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(len(fold), width)
    label, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "n"))
    scores = np.stack([part.column(f"s{c}").to_numpy(zero_copy_only=False) for c in range(n_classes)], axis=1)
    for f in np.unique(fold):
        at = np.flatnonzero(fold == f)
        yield int(f), at, bins[at], label[at], n[at], scores[at]


def _add(scores: np.ndarray, fold: int, bins: np.ndarray, recent: list[dict]) -> np.ndarray:
    scores = scores.copy()
    for trees in recent:
        for c in range(scores.shape[1]):
            if (fold, c) in trees:
                t = trees[fold, c]
                scores[:, c] += t.value[t.leaves(bins)]
    return scores


def _slots(wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int, int], int]:
    """Place of every wanted (fold, class, node) among the histograms of a pass."""
    return {(f, c, node): i for i, (f, c, node) in enumerate((f, c, node) for (f, c), nodes in wanted.items() for node in nodes)}


def _tally(total: np.ndarray, fold: int, bins: np.ndarray, label: np.ndarray, n: np.ndarray, p: np.ndarray, grown: dict[tuple[int, int], Tree], wanted: dict[tuple[int, int], list[int]]) -> None:
    """Adds the cells of one fold to the sums of gradient, curvature and rows of the wanted nodes."""
    slots, width = _slots(wanted), bins.shape[1]
    size = width * (BINS + 1)
    place = bins + np.arange(width) * (BINS + 1)
    for c in range(p.shape[1]):
        nodes = wanted.get((fold, c))
        if not nodes:
            continue
        tree = grown[fold, c]
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = [slots[fold, c, node] for node in nodes]
        slot = slot[tree.leaves(bins)]
        here = np.flatnonzero(slot >= 0)
        at = (slot[here, None] * size + place[here]).ravel()
        g, h = n * (p[:, c] - (label == c)), n * p[:, c] * (1 - p[:, c])
        for i, w in enumerate((g, h, n)):
            total[i] += np.bincount(at, weights=np.repeat(w[here], width), minlength=total.shape[1])


def _histograms(cells: DataFrame, tasks: int, recent: list[dict], grown: dict[tuple[int, int], Tree], wanted: dict[tuple[int, int], list[int]], width: int, n_classes: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums of gradient, curvature and rows by feature and bin of every wanted node."""
    slots = _slots(wanted)
    size = width * (BINS + 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(slots) * size))
        for part in parts:
            for fold, _, bins, label, n, scores in _blocks(part, width, n_classes):
                _tally(total, fold, bins, label, n, softmax(_add(scores, fold, bins, recent)), grown, wanted)
        key = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(total[i, key]) for i in range(3)]], names=["key", "g", "h", "n"])

    sums = cells.mapInArrow(run, "key long, g double, h double, n double")
    if tasks > DIRECT_TASKS:
        sums = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in "ghn"])
    found = sums.toArrow()
    total = np.zeros((len(slots) * size, 3))
    key = found["key"].to_numpy()
    for i, c in enumerate("ghn"):
        np.add.at(total[:, i], key, found[c].to_numpy())
    total = total.reshape(len(slots), width, BINS + 1, 3)
    return {k: total[i] for k, i in slots.items()}


def _grow(live: list[tuple[int, int]], settings: Settings, histograms: Callable[[dict, dict], dict]) -> dict[tuple[int, int], Tree]:
    """One round: the trees of all folds and classes, level by level; ``histograms`` gives the sums of the wanted nodes of the grown trees."""
    growing = {k: Growing(settings) for k in live}
    wanted, known = {k: [0] for k in live}, {}
    while wanted:
        grown = {k: growing[k].tree(every=True) for k in wanted}
        summed = {k: growing[k].summed(nodes) for k, nodes in wanted.items()}
        known |= histograms(grown, {k: asked for k, (asked, _) in summed.items()})
        for k, nodes in wanted.items():
            for node, (parent, sibling) in summed[k][1].items():
                rest = known[(*k, parent)] - known[(*k, sibling)]
                # rows are whole numbers; a bin without rows has no rest of rounding
                known[(*k, node)] = np.where(rest[..., 2:] > 0, rest, 0.0)
            for node in nodes:
                growing[k].judge(node, known[(*k, node)])
        wanted = {k: more for k in wanted if (more := growing[k].choose())}
    return {k: g.tree() for k, g in growing.items()}


class Held:
    """The cells of a fold in memory, and which of them each node of the growing tree has."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, n: np.ndarray, scores: np.ndarray) -> None:
        self.bins, self.label, self.n, self.scores = np.ascontiguousarray(bins.T), label, n.astype(float), scores

    def grow(self, fold: int, classes: list[int], settings: Settings) -> dict[tuple[int, int], Tree]:
        """One round: the tree of every class, and the scores behind it."""
        p, out = softmax(self.scores), {}
        for c in classes:
            self.weights = self.n * (p[:, c] - (self.label == c)), self.n * p[:, c] * (1 - p[:, c]), self.n
            self.rows, self.parent = {0: np.arange(len(self.n))}, {}
            out |= _grow([(fold, c)], settings, self.histograms)
            self._add(c, out[fold, c])
        return out

    def histograms(self, grown: dict[tuple[int, int], Tree], wanted: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int, int], np.ndarray]:
        for tree in grown.values():
            self._split(tree)
        return {(*k, node): self._sums(node) for k, nodes in wanted.items() for node in nodes}

    def _split(self, tree: Tree) -> None:
        """Deals the cells of the tree's inner nodes to their children."""
        for node in np.flatnonzero(tree.feature >= 0).tolist():
            left, right = int(tree.left[node]), int(tree.right[node])
            if left not in self.parent:
                at = self.rows.pop(node)
                goes = self.bins[tree.feature[node]][at] <= tree.cut[node]
                self.rows[left], self.rows[right] = at[goes], at[~goes]
                self.parent[left] = self.parent[right] = node

    def _sums(self, node: int) -> np.ndarray:
        """Sums by feature, bin and (gradient, curvature, rows) of a node that is not split."""
        at = self.rows[node]
        weights = [w[at] for w in self.weights]
        out = np.empty((3, len(self.bins), BINS + 1))
        for j, column in enumerate(self.bins):
            place = column[at].astype(np.intp)
            for i, w in enumerate(weights):
                out[i, j] = np.bincount(place, weights=w, minlength=BINS + 1)
        return out.transpose(1, 2, 0)

    def _add(self, c: int, tree: Tree) -> None:
        """Adds the values of the finished tree, some of whose leaves may have been split on trial."""
        self._split(tree)
        for node, at in self.rows.items():
            path = [node]
            while path[-1]:
                path.append(self.parent[path[-1]])
            leaf = next(x for x in reversed(path) if tree.feature[x] < 0)
            self.scores[at, c] += tree.value[leaf]


def _memory_tasks(cells: DataFrame) -> int:
    """Tasks of a job that keeps the cells of a fold in a task; 0 if they are too many."""
    counts = [r["count"] for r in cells.groupBy("fold").count().collect()]
    most = min(DIRECT_TASKS, cells.sparkSession.sparkContext.defaultParallelism)
    return min(max(1, -(-sum(counts) // BARRIER_CELLS)), most) if max(counts, default=0) <= MOST_CELLS else 0


def _grow_together(cells: DataFrame, tasks: int, live: list[tuple[int, int]], rounds: int, settings: Settings, width: int, n_classes: int) -> tuple[list[dict[tuple[int, int], Tree]], DataFrame]:
    """The trees of the next rounds and the cells with the scores behind them, by one job whose tasks keep the cells of a fold."""
    table = _table(n_classes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (block for part in parts for block in _blocks(part, width, n_classes))
        for fold, own in itertools.groupby(blocks, key=lambda block: block[0]):
            bins, label, n, scores = (np.concatenate(x) for x in zip(*(block[2:] for block in own), strict=True))
            held, classes = Held(bins, label, n, scores), [c for f, c in live if f == fold]
            found = [held.grow(fold, classes, settings) for _ in range(rounds)]
            columns = [pa.array(np.full(len(n), fold, np.int32)), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(label), pa.array(n), *[pa.array(np.ascontiguousarray(held.scores[:, c])) for c in range(n_classes)]]
            trees = pa.array([pickle.dumps(found), *[None] * (len(n) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, trees], names=[*table.names, "trees"])

    dealt = cells.repartitionById(tasks, F.col("fold") % tasks).sortWithinPartitions("fold", "bins", "label")
    out = cut_lineage(dealt.mapInArrow(run, T.StructType([*table.fields, T.StructField("trees", T.BinaryType())])), "boost-cells")
    found = [pickle.loads(r["trees"]) for r in out.where("trees is not null").select("trees").collect()]
    return [{k: tree for trees in own for k, tree in trees.items()} for own in zip(*found, strict=True)], out.drop("trees")


def fit(rows: DataFrame, features: Sequence[str], folds: Sequence[str], n_classes: int, settings: Settings | None = None) -> Model:
    """Boosted trees of the folds; ``rows``: fold, split ("train" counts), label 0.., features, null or NaN where unknown.

    ``KEPT_JOBS`` jobs of ``KEPT_ROUNDS`` rounds or more, or with very many cells about 8 small jobs a round.
    """
    settings = settings or Settings()
    folds, width = list(folds), len(features)
    known = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    train = rows.where((F.col("split") == "train") & F.col("fold").isin(folds) & F.col("label").between(0, n_classes - 1)).select("fold", F.col("label").cast("int").alias("label"), *known)
    train = cut_lineage(train, "boost-rows")
    medians, edges = _cuts(train, features, folds)
    model = Model(folds, medians, edges, np.zeros((len(folds), n_classes)), [])
    counts = np.zeros((len(folds), n_classes))
    for r in train.groupBy("fold", "label").count().collect():
        counts[folds.index(r["fold"]), r["label"]] = r["count"]
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    # a class without training rows gets no probability and no trees
    model.first = np.where(counts > 0, np.log(np.maximum(share, 1e-300)), -1e9 if counts.any() else 0.0)
    table = _table(n_classes)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(folds)}
        for part in parts:
            fold = np.array([at[f] for f in part.column("fold").to_pylist()], np.int64)
            x = np.stack([part.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1)
            bins = np.zeros((len(fold), width), np.uint8)
            for f in np.unique(fold):
                bins[fold == f] = model.binned(f, x[fold == f])
            yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array([b.tobytes() for b in bins], pa.binary()), part.column("label")], names=["fold", "bins", "label"])

    cells = train.mapInArrow(cut, "fold int, bins binary, label int").groupBy("fold", "bins", "label").agg(F.count("*").alias("n"))
    scores = [F.element_at(F.array(*[F.lit(float(x)) for x in model.first[:, c]]), F.col("fold") + 1).alias(f"s{c}") for c in range(n_classes)]
    cells = cut_lineage(cells.select("*", *scores), "boost-cells")
    live = [(f, c) for f in range(len(folds)) for c in range(n_classes) if counts[f, c]]
    together = _memory_tasks(cells)
    recent: list[dict] = []
    tasks = cells.select(F.spark_partition_id().alias("p")).distinct().count()
    while live and (left := settings.rounds - len(model.rounds)) > 0:
        if together:
            more, cells = _grow_together(cells, together, live, min(max(KEPT_ROUNDS, -(-settings.rounds // KEPT_JOBS)), left), settings, width, n_classes)
            model.rounds += more
            continue
        more = _grow(live, settings, lambda grown, wanted: _histograms(cells, tasks, recent, grown, wanted, width, n_classes))  # noqa: B023
        model.rounds.append(more)
        recent.append(more)
        if len(recent) >= KEPT_ROUNDS and left > 1:
            cells, recent = _rescored(cells, recent, width, n_classes, table), []
    return model


def _rescored(cells: DataFrame, recent: list[dict], width: int, n_classes: int, table: T.StructType) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = np.zeros((len(part), n_classes))
            for fold, at, bins, _, _, old in _blocks(part, width, n_classes):
                scores[at] = _add(old, fold, bins, recent)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("fold", "bins", "label", "n")], *[pa.array(np.ascontiguousarray(scores[:, c])) for c in range(n_classes)]], names=table.names)

    return cut_lineage(cells.mapInArrow(run, table), "boost-cells")


def predict(rows: DataFrame, features: Sequence[str], model: Model, keep: Sequence[str], n_classes: int) -> DataFrame:
    """fold, ``keep``, y_true, y_pred and the class probabilities of each row, by the trees of its fold."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    inner = rows.select("fold", *keep, F.col("label").cast("int").alias("y_true"), *[F.col(f).cast("double").alias(f"x_{j}") for j, f in enumerate(features)])
    held = ["fold", *keep, "y_true"]
    out = T.StructType([inner.schema[c] for c in held] + [T.StructField("y_pred", T.IntegerType())] + [T.StructField(f"prob_{c}", T.DoubleType()) for c in range(n_classes)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = {f: i for i, f in enumerate(m.folds)}
        for part in parts:
            fold = np.array([at[f] for f in part.column("fold").to_pylist()], np.int64)
            x = np.stack([part.column(f"x_{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))], axis=1)
            p = np.zeros((len(fold), n_classes))
            for f in np.unique(fold):
                own = fold == f
                p[own] = softmax(m.scores(f, m.binned(f, x[own])))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in held], pa.array(p.argmax(axis=1).astype(np.int32)), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(n_classes)]], names=out.names)

    return inner.where(F.col("fold").isin(model.folds)).mapInArrow(run, out)
