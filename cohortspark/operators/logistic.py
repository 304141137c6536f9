"""Logistic models fitted by Newton's method: one aggregate per round gives gradient and Hessian of every candidate at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.sources.tables import Kept


@dataclass(frozen=True)
class Logistic:
    """Coefficients of a fitted model; scoring is a column expression and needs no model object in a task."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def risk(self) -> Column:
        """P(y = 1); null where a feature is null."""
        z = F.lit(self.intercept)
        for name, b in zip(self.features, self.coefficients, strict=True):
            z = z + F.col(name).cast("double") * F.lit(b)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@dataclass(frozen=True)
class Candidate:
    """A feature set and the strength c of its L2 penalty, sum of squares / (2 c), from which the intercept is free; None: no penalty."""

    features: tuple[str, ...]
    c: float | None = 1.0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of doubles; null elements are NaN."""
    flat = column.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(columns: list[list[int]], betas: list[np.ndarray], width: int):
    """(candidate, i, j, value) of one task: the Hessian's upper triangle, the gradient at j = -1 and the loss at i = j = -1."""

    def add(batches):
        n = len(columns)
        total = [(np.zeros((len(c) + 1, len(c) + 1)), np.zeros(len(c) + 1), 0.0) for c in columns]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), width)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            for k in range(n):
                z = np.column_stack([x[:, columns[k]], np.ones(len(x))])
                known = ~np.isnan(z).any(axis=1)
                z, yk, wk = z[known], y[known], w[known]
                at = z @ betas[k]
                p = 1 / (1 + np.exp(-np.clip(at, -700, 700)))
                h, g, loss = total[k]
                total[k] = h + z.T @ (z * (wk * p * (1 - p))[:, None]), g + z.T @ (wk * (p - yk)), loss + float((wk * (np.logaddexp(0, at) - yk * at)).sum())
        rows = []
        for k, (h, g, loss) in enumerate(total):
            rows += [(k, i, j, h[i, j]) for i in range(len(g)) for j in range(i, len(g))] + [(k, i, -1, g[i]) for i in range(len(g))] + [(k, -1, -1, loss)]
        yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate("kijv")}, pa.schema([("k", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    return add


def fit_all(rows: DataFrame, candidates: dict[str, Candidate], label: str = "label", weight: str | None = None, rounds: int = 60, tolerance: float = 1e-10) -> dict[str, Logistic]:
    """All candidates fitted together to the optimum of their weighted, penalised loss.

    Every round reads the kept feature columns once and brings back one small matrix per candidate. A step that raises a candidate's loss is halved. A
    candidate leaves out the rows where one of its features is null; rows without a label are left out. Without rows all coefficients are 0.
    """
    names = sorted({f for c in candidates.values() for f in c.features})
    at = [[names.index(f) for f in c.features] for c in candidates.values()]
    x = F.array(*[F.col(f).cast("double") for f in names]) if names else F.array().cast("array<double>")
    some = rows.where(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    with Kept(some) as kept:
        betas = [np.zeros(len(c) + 1) for c in at]
        steps, losses, open_ = [np.zeros(len(c) + 1) for c in at], [np.inf] * len(at), set(range(len(at)))
        for _ in range(rounds):
            todo = sorted(open_)
            sums = kept.rows.mapInArrow(_sums([at[k] for k in todo], [betas[k] for k in todo], len(names)), "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect()
            got = {(r["k"], r["i"], r["j"]): r["v"] for r in sums}
            for pos, k in enumerate(todo):
                size, c = len(at[k]) + 1, list(candidates.values())[k].c
                pull = np.append(np.full(size - 1, 1 / c if c else 0.0), 0.0)
                loss = got.get((pos, -1, -1), 0.0) + float((pull * betas[k] ** 2).sum()) / 2
                if loss > losses[k] * (1 + 1e-12) + 1e-12:
                    steps[k] = steps[k] / 2
                    betas[k] = betas[k] + steps[k]
                    continue
                losses[k] = loss
                g = np.array([got.get((pos, i, -1), 0.0) for i in range(size)]) + pull * betas[k]
                h = np.array([[got.get((pos, min(i, j), max(i, j)), 0.0) for j in range(size)] for i in range(size)]) + np.diag(pull)
                steps[k] = np.linalg.lstsq(h, g, rcond=None)[0]
                betas[k] = betas[k] - steps[k]
                if np.abs(steps[k]).max() <= tolerance * (1 + np.abs(betas[k]).max()):
                    open_.discard(k)
            if not open_:
                break
    return {name: Logistic(c.features, tuple(map(float, b[:-1])), float(b[-1])) for (name, c), b in zip(candidates.items(), betas, strict=True)}
