"""Boosted trees on binned features: leaf-wise growth from gradient histograms that Spark sums (or one task, for few rows), and an early stop by rounds without gain."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.logistic import matrix
from cohortspark.sources.tables import Kept

SETTLED = 10  #: trees after which the rows' scores are kept, so that later passes walk only newer trees
FEW = 1_000_000  #: values (kept rows times features) up to which one task takes all rows and grows all trees; beyond, every pass is a Spark job


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: a row goes left where its bin is at most `bin`, or where it has no value and `missing_left`; feature -1 marks a leaf."""

    feature: tuple[int, ...]
    bin: tuple[int, ...]
    missing_left: tuple[bool, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]

    def nodes(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, to_left, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[at[rows]] >= 0]
            node = at[rows]
            b = bins[rows, feature[node]]
            at[rows] = np.where(np.where(b == missing, to_left[node], b <= cut[node]), left[node], right[node])
        return at

    def scores(self, bins: np.ndarray, missing: int) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins, missing)]


@dataclass(frozen=True)
class Boosted:
    """A fitted model: edges of the features' bins, the score of no tree, and the trees."""

    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    base: float
    trees: tuple[Tree, ...]
    held_loss: tuple[float, ...] = ()

    def binned(self, x: np.ndarray) -> np.ndarray:
        return _binned(x, self.edges)

    def risk(self) -> Column:
        """P(y = 1), computed for batches of rows; null features go the way that training chose for them."""

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns])
            bins, total = self.binned(x), np.full(len(x), self.base)
            for tree in self.trees:
                total += tree.scores(bins, _missing(self.edges))
            return pd.Series(1 / (1 + np.exp(-total)))

        return score(*[F.col(f).cast("double") for f in self.features])


def _missing(edges) -> int:
    """The bin of rows without a value, one beyond all others."""
    return max(map(len, edges), default=0) + 1


def _binned(x: np.ndarray, edges) -> np.ndarray:
    """Bin k holds values over edge k - 1 and up to edge k."""
    out = np.empty(x.shape, np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), _missing(edges), np.searchsorted(np.array(e, np.float64), x[:, j], side="left"))
    return out


_STATE = "b binary, y double, w double, held boolean, n long, raw double"  #: n: how many rows a row stands for


def _batch(batch: pa.RecordBatch, width: int, trees: list[Tree], missing: int):
    """Bins, labels, weights, held rows, numbers and scores of a kept batch, with the trees since then added."""
    data = batch.column("b")
    bins = np.frombuffer(b"".join(data.to_pylist()), np.int16).reshape(len(batch), width)
    raw = batch.column("raw").to_numpy().copy()
    for tree in trees:
        raw += tree.scores(bins, missing)
    return bins, batch.column("y").to_numpy(), batch.column("w").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), raw


def _sums(rows, growing: Tree, nodes: list[int], missing: int):
    """Sums of gradients, Hessians and rows by (open node, feature, bin), flat, and the held rows' loss and weight."""
    bins, y, w, held, n, raw = rows
    width, size = bins.shape[1], missing + 1
    total = np.zeros((3, len(nodes) * width * size))
    w = w * n
    loss, weight = float((w * (np.logaddexp(0, raw) - y * raw))[held].sum()), float(w[held].sum())
    slot = np.full(len(growing.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    s = slot[growing.nodes(bins, missing)]
    ok = ~held & (s >= 0)
    s, bins, p = s[ok], bins[ok], 1 / (1 + np.exp(-raw[ok]))
    g, h = w[ok] * (p - y[ok]), w[ok] * p * (1 - p)
    for j in range(width):
        key = (s * width + j) * size + bins[:, j]
        for i, v in enumerate((g, h, n[ok])):
            total[i] += np.bincount(key, weights=v, minlength=total.shape[1])
    return total, loss, weight


def _histograms(trees: list[Tree], growing: Tree, nodes: list[int], width: int, missing: int):
    """The sums of a task's rows; key -1 has the held rows' loss and weight."""

    def add(batches):
        total = np.zeros((3, len(nodes) * width * (missing + 1)))
        loss = weight = 0.0
        for batch in batches:
            if batch.num_rows:
                total, loss, weight = (a + b for a, b in zip((total, loss, weight), _sums(_batch(batch, width, trees, missing), growing, nodes, missing), strict=True))
        some = np.flatnonzero(total[2])
        k = np.concatenate([some, [-1]])
        g, h, c = (np.concatenate([total[i][some], [x]]) for i, x in enumerate((loss, weight, 0.0)))
        yield pa.RecordBatch.from_pydict({"k": k.astype(np.int64), "g": g, "h": h, "c": c})

    return add


@dataclass
class _Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    sums: tuple  # (gradient, Hessian) of the left and of the right side


def best_split(hist: np.ndarray, sizes: list[int], l2: float, least: int) -> _Split | None:
    """The split of greatest gain of a node's histogram [3, feature, bin]; of equal gains the first feature, then the lowest bin, then missing rows to the right."""
    best = None
    total = hist[:, 0].sum(axis=1)
    value = lambda g, h: g * g / (h + l2)
    for j, n in enumerate(sizes):
        upto = np.cumsum(hist[:, j, : n + 1], axis=1)[:, :n]  # left sums without missing rows, for every edge
        missing = hist[:, j, -1][:, None]
        for to_left in (False, True) if missing[2, 0] else (False,):
            left = upto + missing if to_left else upto
            right = total[:, None] - left
            ok = (left[2] >= least) & (right[2] >= least) & (left[1] > 1e-3) & (right[1] > 1e-3)
            if not ok.any():
                continue
            gain = np.where(ok, value(left[0], left[1] + 1e-300) + value(right[0], right[1] + 1e-300) - value(total[0], total[1] + 1e-300), -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > 1e-12 and (best is None or gain[at] > best.gain * (1 + 1e-12)):
                best = _Split(float(gain[at]), j, at, to_left, ((left[0, at], left[1, at]), (right[0, at], right[1, at])))
    return best


class _Grower:
    """One tree, grown leaf by leaf in the order of gain; histograms are asked for in rounds, for the children of all leaves that may be split next."""

    def __init__(self, histograms, sizes, leaves: int, l2: float, least: int, rate: float):
        self.histograms, self.sizes, self.leaves, self.l2, self.least, self.rate = histograms, sizes, leaves, l2, least, rate
        self.nodes: list[dict] = [{"split": None, "sums": None, "children": None}]

    def _tree(self, chosen=None) -> Tree:
        """All nodes, or those that the chosen splits leave."""
        feature, cut, missing, left, right, value = [], [], [], [], [], []
        for i, n in enumerate(self.nodes):
            split = n["split"] if n["children"] and (chosen is None or i in chosen) else None
            feature.append(split.feature if split else -1), cut.append(split.bin if split else 0), missing.append(bool(split and split.missing_left))
            left.append(n["children"][0] if split else -1), right.append(n["children"][1] if split else -1)
            g, h = n["sums"] or (0.0, 0.0)
            value.append(-self.rate * g / (h + self.l2) if h + self.l2 > 0 else 0.0)
        return Tree(*map(tuple, (feature, cut, missing, left, right, value)))

    def grow(self) -> Tree:
        open_, chosen, asked, known = {}, [], [0], set()
        while True:
            hists = self.histograms(self._tree(), asked)
            for node in asked:
                self.nodes[node]["sums"] = self.nodes[node]["sums"] or tuple(hists[node][:2, 0].sum(axis=1))
                self.nodes[node]["split"] = best_split(hists[node], self.sizes, self.l2, self.least)
            known |= set(asked)
            if asked == [0]:
                open_ = {0: self.nodes[0]["split"].gain} if self.nodes[0]["split"] else {}
            while open_ and len(chosen) + 1 < self.leaves:
                node = max(open_, key=lambda i: (open_[i], -i))
                if self.nodes[node]["children"] is None:
                    break
                if len(chosen) + 2 < self.leaves and not set(self.nodes[node]["children"]) <= known:
                    break
                del open_[node]
                chosen.append(node)
                open_ |= {c: self.nodes[c]["split"].gain for c in self.nodes[node]["children"] if c in known and self.nodes[c]["split"]}
            if not open_ or len(chosen) + 1 >= self.leaves:
                return self._tree(set(chosen))
            asked = []
            for node in sorted(open_, key=lambda i: (-open_[i], i))[: self.leaves - 1 - len(chosen)]:
                if self.nodes[node]["children"] is None:
                    split = self.nodes[node]["split"]
                    self.nodes[node]["children"] = (len(self.nodes), len(self.nodes) + 1)
                    self.nodes += [{"split": None, "sums": tuple(map(float, s)), "children": None} for s in split.sums]
                    asked += self.nodes[node]["children"]


class _Jobs:
    """Passes over kept rows as Spark jobs."""

    def __init__(self, state: Kept, first: Tree, width: int, missing: int):
        self.state, self.fresh, self.width, self.missing = state, [first], width, missing

    def sums(self, growing: Tree, nodes: list[int]):
        """Sums of gradients, Hessians and rows by (open node, feature, bin), flat, and the held rows' loss and weight."""
        got = self.state.rows.mapInArrow(_histograms(list(self.fresh), growing, nodes, self.width, self.missing), "k long, g double, h double, c double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("c").alias("c")).toArrow()
        flat = np.zeros((3, len(nodes) * self.width * (self.missing + 1)))
        k, sums = got["k"].to_numpy(), np.stack([got[c].to_numpy() for c in "ghc"])
        flat[:, k[k >= 0]] = sums[:, k >= 0]
        return flat, *sums[:2, k < 0].sum(axis=1)

    def add(self, tree: Tree) -> None:
        self.fresh.append(tree)
        if len(self.fresh) >= SETTLED:
            self.state.replace(self.state.rows.mapInArrow(_added(list(self.fresh), self.width, self.missing), _STATE))
            self.fresh.clear()


class _Local:
    """Passes over rows in this task's memory."""

    def __init__(self, batches, first: Tree, width: int, missing: int):
        *self.rows, self.raw = map(np.concatenate, zip(*(_batch(b, width, [first], missing) for b in batches if b.num_rows), strict=True))
        self.missing = missing

    def sums(self, growing: Tree, nodes: list[int]):
        return _sums((*self.rows, self.raw), growing, nodes, self.missing)

    def add(self, tree: Tree) -> None:
        self.raw += tree.scores(self.rows[0], self.missing)


def _boost(passes: _Jobs | _Local, sizes: list[int], trees: int, rate: float, leaves: int, l2: float, least: int, patience: int, tolerance: float) -> tuple[list[Tree], list[float]]:
    """The trees, and the held rows' loss before each."""
    grown, losses = [], []

    def histograms(growing: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
        flat, loss, weight = passes.sums(growing, nodes)
        if nodes == [0] and weight:
            losses.append(float(loss / weight))
        return dict(zip(nodes, np.moveaxis(flat.reshape(3, len(nodes), len(sizes), -1), 1, 0), strict=True))

    for _ in range(trees):
        tree = _Grower(histograms, sizes, leaves, l2, least, rate).grow()
        if len(losses) > patience and min(losses[-patience:]) >= losses[-patience - 1] - tolerance:
            break
        if tree.feature == (-1,):
            break  # no split gains anything
        grown.append(tree)
        passes.add(tree)
    return grown, losses


def _in_one_task(rows: DataFrame, first: Tree, width: int, missing: int, *args) -> tuple[list[Tree], list[float]]:
    """_boost() by a task that takes all rows; only trees and losses come to the driver."""

    def grow(batches):
        grown, losses = _boost(_Local(batches, first, width, missing), *args)
        yield pa.RecordBatch.from_pydict({"made": [json.dumps([[asdict(t) for t in grown], losses])]})

    grown, losses = json.loads(rows.coalesce(1).mapInArrow(grow, "made string").first()["made"])
    return [Tree(**{k: tuple(v) for k, v in t.items()}) for t in grown], losses


def fit(rows: DataFrame, features: tuple[str, ...], label: str = "label", weight: str | None = None, held: Column | None = None, trees: int = 300, rate: float = 0.04, leaves: int = 15, l2: float = 0.05, least: int = 30, bins: int = 255, patience: int = 20, tolerance: float = 1e-7) -> Boosted:
    """Trees on the logistic loss. `held` rows don't train; growth stops when their loss hasn't fallen by `tolerance` in the last `patience` trees.

    Features are cut into at most `bins` bins at approximate quantiles, in one aggregate. Each tree takes about as many passes as it is deep; a
    pass brings back one histogram per open node, so what reaches the driver depends on leaves, features and bins alone. Null features have a bin of their own; rows without a label are left out.
    Rows that agree in bins, label, weight and being held are kept as one with their number, so that passes over few features don't grow with the rows.
    Up to FEW values one task takes them all and grows the trees; both ways give the same trees, but for the order of sums.
    """
    names = list(features)
    some = rows.where(F.col(label).isNotNull())
    shares = [i / bins for i in range(1, bins)]
    one = some.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"_e{i}") for i, f in enumerate(names)], *[F.max(F.col(f).cast("double")).alias(f"_m{i}") for i, f in enumerate(names)]).first()
    edges = tuple(tuple(sorted({float(v) for v in one[f"_e{i}"] or [] if v < one[f"_m{i}"]})) for i in range(len(names)))
    width, missing, sizes = len(names), _missing(edges), [len(e) for e in edges]

    def binned(batches):
        for batch in batches:
            b = _binned(matrix(batch.column("x"), width), edges)
            yield pa.RecordBatch.from_pydict({"b": pa.array([r.tobytes() for r in b], pa.binary()), "y": batch.column("y"), "w": batch.column("w"), "held": batch.column("held")})

    plain = some.select(F.array(*[F.col(f).cast("double") for f in names]).alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), (F.lit(False) if held is None else F.coalesce(held, F.lit(False))).alias("held"))
    alike = plain.mapInArrow(binned, "b binary, y double, w double, held boolean").groupBy("b", "y", "w", "held").agg(F.count(F.lit(1)).alias("n"))
    with Kept(alike.withColumn("raw", F.lit(0.0))) as state:
        weights = F.col("n") * F.col("w")
        one = state.rows.agg((F.sum(F.when(~F.col("held"), weights * F.col("y"))) / F.sum(F.when(~F.col("held"), weights))).alias("m"), F.count(F.lit(1)).alias("n")).first()
        mean = one["m"]
        if mean is None or not 0 < mean < 1:
            return Boosted(tuple(names), edges, 0.0 if mean is None else math.copysign(30.0, mean - 0.5), ())
        base = math.log(mean / (1 - mean))
        args = sizes, trees, rate, leaves, l2, least, patience, tolerance
        if one["n"] * width <= FEW:
            grown, losses = _in_one_task(state.rows, _constant(base), width, missing, *args)
        else:
            grown, losses = _boost(_Jobs(state, _constant(base), width, missing), *args)
    return Boosted(tuple(names), edges, base, tuple(grown), tuple(losses))


def _constant(value: float) -> Tree:
    return Tree((-1,), (0,), (False,), (-1,), (-1,), (value,))


def _added(trees: list[Tree], width: int, missing: int):
    """The rows with the trees' scores added."""

    def add(batches):
        for batch in batches:
            raw = _batch(batch, width, trees, missing)[-1] if batch.num_rows else np.zeros(0)
            yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(raw, pa.float64()))

    return add
