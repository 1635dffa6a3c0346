"""Generalised additive models: penalised smooths for all elements at once, smoothing parameters chosen on Gram sums.

Each task makes the bases of its rows from the smooths' variables, as arrays of a batch, and sums products of the design
(intercept, linear terms, bases) and the response by element; the sums, a row an element, hold all that a Gaussian fit
needs, so its rows are read once. The constraint that a smooth sums to zero over the element's rows is a change of basis of
those sums. Smoothing parameters follow the generalised Fellner-Schall update,
lambda_k <- lambda_k (tr(S^- S_k) - tr(V S_k)) phi / (b' S_k b), V = (X'WX + S)^-1, until none moves. Other families repeat
that on the sums of the working response; only coefficients pass between rounds.

Rows with a null in the response or the design are left out. An element without rows has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import bases
from quern.operators.mixed import _kinds, _totals
from quern.operators.models import _Held
from quern.session import staged

LEAST_LAMBDA, MOST_LAMBDA, RIDGE = 1e-6, 1e8, 1e-8


@dataclass
class Smooth:
    """A basis and the penalties of its coefficients. `basis` is an array column of `size` values or, where there is
    `values`, the variable: `values` makes the basis of many of its numbers within a task."""

    basis: Column
    size: int
    penalties: list[np.ndarray]
    values: Callable[[np.ndarray], np.ndarray] | None = None


def bspline_smooth(x: Column, low: float, high: float, number: int = 10, degree: int = 3, order: int = 2) -> Smooth:
    """B-splines with differences of the given order of neighbouring coefficients penalised."""
    d = np.diff(np.eye(number), order, axis=0)
    return Smooth(x.cast("double"), number, [d.T @ d], partial(bases.bspline_values, low=low, high=high, number=number, degree=degree))


def cyclic_smooth(x: Column, low: float, high: float, number: int = 10, degree: int = 3, order: int = 2) -> Smooth:
    """Periodic B-splines with periodic differences penalised."""
    d = np.eye(number)
    for _ in range(order):
        d = np.roll(d, -1, axis=0) - d
    return Smooth(x.cast("double"), number, [d.T @ d], partial(bases.cyclic_values, low=low, high=high, number=number, degree=degree))


class Design:
    """The columns that rows bring to a task, and the design (intercept, linear terms, bases) that a task makes of them."""

    def __init__(self, linear: list[Column], smooths: list[Smooth]):
        self.columns = [c.cast("double").alias(f"_l{i}") for i, c in enumerate(linear)] + [s.basis.alias(f"_s{k}") for k, s in enumerate(smooths)]
        self.names = [f"_l{i}" for i in range(len(linear))] + [f"_s{k}" for k in range(len(smooths))]
        self.whole, self.spans, self.p = F.lit(True), [], 1 + len(linear)
        for i in range(len(linear)):
            self.whole = self.whole & F.col(f"_l{i}").isNotNull()
        for k, s in enumerate(smooths):
            self.whole = self.whole & (F.forall(f"_s{k}", lambda v: v.isNotNull()) if s.values is None else F.col(f"_s{k}").isNotNull())
            self.spans.append((self.p, self.p + s.size))
            self.p += s.size
        self.reader = _Reader(len(linear), [(s.size, s.values) for s in smooths])


@dataclass
class _Reader:
    """What of a design goes to tasks."""

    linear: int
    made: list[tuple[int, Callable | None]]

    def basis(self, batch: pa.RecordBatch, k: int) -> np.ndarray:
        column, (size, values) = batch.column(f"_s{k}"), self.made[k]
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if values is None else values(column.to_numpy(zero_copy_only=False))

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        linear = [batch.column(f"_l{i}").to_numpy(zero_copy_only=False) for i in range(self.linear)]
        return np.column_stack([np.ones(batch.num_rows), *linear, *(self.basis(batch, k) for k in range(len(self.made)))])


#: Families: mean of eta, its slope, variance of the mean, eta to begin with, unit deviance, and whether dispersion is estimated.
_half = lambda y, m: np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0.0)
FAMILIES: dict[str, tuple[Callable, Callable, Callable, Callable, Callable, bool]] = {
    "gaussian": (lambda e: e, np.ones_like, np.ones_like, lambda y: y, lambda y, m: (y - m) ** 2, True),
    "poisson": (np.exp, np.exp, lambda m: m, lambda y: np.log(y + 0.5), lambda y, m: 2 * (_half(y, m) - (y - m)), False),
    "binomial": (
        lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-e) / (1 + np.exp(-e)) ** 2, lambda m: m * (1 - m), lambda y: np.log((y + 0.5) / (1.5 - y)),
        lambda y, m: 2 * (_half(y, m) + _half(1 - y, 1 - m)), False,
    ),
    "gamma": (np.exp, np.exp, lambda m: m * m, lambda y: np.log(np.maximum(y, 1e-6)), lambda y, m: 2 * ((y - m) / m - np.log(np.maximum(y, 1e-300) / m)), True),
}


def select(gram: np.ndarray, xy: np.ndarray, yy: float, n: float, penalties: list[np.ndarray], estimated: bool, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(lambda, coefficients, V, dispersion) of one element from its weighted sums."""
    p, lam, phi = len(gram), np.ones(len(penalties)), 1.0
    for k in range(rounds + 1):
        total = sum((w * s for w, s in zip(lam, penalties)), np.zeros((p, p)))
        v = np.linalg.inv(gram + total + RIDGE * np.eye(p))
        beta = v @ xy
        if estimated:
            rss = max(yy - 2 * beta @ xy + beta @ gram @ beta, 1e-300)
            phi = rss / max(n - np.einsum("ij,ji->", v, gram), 1e-8)
        if k == rounds or not len(lam):
            break
        inverse = np.linalg.pinv(total, rcond=1e-10, hermitian=True)
        rise = np.array([np.einsum("ij,ji->", inverse, s) - np.einsum("ij,ji->", v, s) for s in penalties])
        energy = np.array([beta @ s @ beta for s in penalties])
        after = np.clip(lam * np.maximum(rise, 1e-12) * phi / np.maximum(energy, 1e-300), LEAST_LAMBDA, MOST_LAMBDA)
        if np.abs(np.log(after / lam)).max() < tol:
            break
        lam = after
    return lam, beta, v, phi


class Gam:
    """A fit. `table` is a row an element: keys, n, beta (of all columns: intercept, linear terms, bases), lam, edf (of each
    smooth), edf_total, dispersion, deviance, null_deviance, cov (row-major, times the dispersion)."""

    def __init__(self, table: DataFrame, keys: list[str], design: Design, family: str):
        self.table, self.keys, self.design, self.spans, self.family = table, keys, design, design.spans, family

    def _met(self, rows: DataFrame) -> tuple[DataFrame, list | None]:
        """rows, with the design's columns, and their element's coefficients _b and covariance _c. Few elements are
        broadcast, so that rows stay where they are, as their place _g in a list of (beta, cov)."""
        held = _Held(self.table.select(*self.keys, "beta", "cov"), None, 2 * self.spans[-1][1] ** 2 if self.spans else 1)
        if held.few:
            kinds = "".join(f"`_k_{k}` {held.table.schema[k].dataType.simpleString()}, " for k in self.keys)
            named = self.table.sparkSession.createDataFrame([(*(r[k] for k in self.keys), i) for i, r in enumerate(held.rows)], f"{kinds}_g int")
        else:
            named = held.table.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys), F.col("beta").alias("_b"), F.col("cov").alias("_c"))
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        met = rows.join(F.broadcast(named) if held.few or not self.keys else named, on)
        return met.drop(*(f"_k_{k}" for k in self.keys)).select("*", *self.design.columns), held.rows if held.few else None

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with `predicted`, the mean; null where the design has a null."""
        met, fits = self._met(rows)
        reader, mean, spare = self.design.reader, FAMILIES[self.family][0], ("_b", "_c", "_g", "_w", *self.design.names)
        few = None if fits is None else np.array([r["beta"] for r in fits], float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = batch.column("_w").to_numpy(zero_copy_only=False).astype(bool)
                predicted, own = np.zeros(batch.num_rows), batch.filter(pa.array(whole))
                if own.num_rows:
                    x = reader.matrix(own)
                    b = own.column("_b").flatten().to_numpy(zero_copy_only=False).reshape(x.shape) if few is None else few[own.column("_g").to_numpy()]
                    predicted[whole] = mean((x * b).sum(axis=1))
                names = [n for n in batch.schema.names if n not in spare]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(predicted, mask=~whole)], names=[*names, "predicted"])

        met = met.withColumn("_w", F.coalesce(self.design.whole, F.lit(False)))
        return met.drop("_c").mapInArrow(run, _kinds(rows, rows.columns) + "predicted double")

    def partial_effect(self, rows: DataFrame, smooth: int) -> DataFrame:
        """rows with `effect` and `se` of one smooth at their place."""
        low, high = self.spans[smooth]
        met, fits = self._met(rows)
        own = met.filter(self.design.whole).drop(*(n for n in self.design.names if n != f"_s{smooth}"))
        reader, spare = self.design.reader, ("_b", "_c", "_g", f"_s{smooth}")
        kinds = _kinds(rows, rows.columns) + "effect double, se double"
        cut = lambda beta, cov: (np.asarray(beta, float)[low:high], np.asarray(cov, float).reshape(len(beta), -1)[low:high, low:high])
        few = None if fits is None else [cut(r["beta"], r["cov"]) for r in fits]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = reader.basis(batch, smooth)
                effect, spread = np.empty(len(x)), np.empty(len(x))
                if few is None:
                    for i, (b, c) in enumerate(map(cut, batch.column("_b").to_pylist(), batch.column("_c").to_pylist())):
                        effect[i], spread[i] = x[i] @ b, x[i] @ c @ x[i]
                else:
                    number = batch.column("_g").to_numpy()
                    for g in np.unique(number):
                        mine, (b, c) = number == g, few[g]
                        effect[mine], spread[mine] = (x[mine] * b).sum(axis=1), np.einsum("ni,ni->n", x[mine] @ c, x[mine])
                names = [n for n in batch.schema.names if n not in spare]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(effect), pa.array(np.sqrt(np.maximum(spread, 0)))], names=[*names, "effect", "se"])

        return own.mapInArrow(run, kinds)


def _null_space(sums: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what is orthogonal to a vector."""
    return np.linalg.qr(np.column_stack([sums, np.eye(len(sums))[:, : len(sums)]]))[0][:, 1:]


def gam_fit(rows: DataFrame, keys: list[str], smooths: list[Smooth], y: Column, parametric: list[Column] | None = None, family: str = "gaussian", rounds: int = 40, tol: float = 1e-7) -> Gam:
    """A smooth model of each element (keys), with an intercept."""
    design = Design(parametric or [], smooths)
    p, spans, reader, fixed = design.p, design.spans, design.reader, 1 + len(parametric or [])
    mean, slope, variance, begin, unit, estimated = FAMILIES[family]
    penalties = []
    for s, (low, high) in zip(smooths, spans):
        for own in s.penalties:
            whole = np.zeros((p, p))
            whole[low:high, low:high] = own
            penalties.append(whole)
    upper = np.triu_indices(p + 1)
    width = len(upper[0]) + 4
    ready = rows.select(*keys, *design.columns, y.cast("double").alias("_y")).filter(F.col("_y").isNotNull() & design.whole)
    base = ready if family == "gaussian" else staged(ready)
    kinds = _kinds(base, keys)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of [design, working response] by element within a batch; then n, sum and deviances."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = reader.matrix(batch)
            v = batch.column("_y").to_numpy(zero_copy_only=False)
            if "_b" in batch.schema.names:
                eta = np.clip((x * batch.column("_b").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)).sum(axis=1), -30, 30)
                mu, d = mean(eta), slope(eta)
                z, w, off = eta + (v - mu) / np.maximum(d, 1e-10), d * d / np.maximum(variance(mu), 1e-10), unit(v, mu)
            else:
                z, w, off = begin(v), np.ones(len(v)), np.zeros(len(v))
            null = unit(v, batch.column("_m").to_numpy(zero_copy_only=False)) if "_m" in batch.schema.names else np.zeros(len(v))
            t = np.column_stack([x, z])
            if keys:
                number = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            else:
                number = np.zeros(len(v), int)
            order, total = np.argsort(number, kind="stable"), np.empty((number.max() + 1, width))
            for k, mine in enumerate(np.split(order, np.flatnonzero(np.diff(number[order])) + 1)):
                gram = (t[mine] * w[mine, None]).T @ t[mine]
                total[k] = np.concatenate([gram[upper], [len(mine), v[mine].sum(), off[mine].sum(), null[mine].sum()]])
            first = np.unique(number, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(first)) for k in keys), pa.array(list(total), pa.list_(pa.float64()))], names=[*keys, "sums"])

    def sums_of(table: DataFrame) -> DataFrame:
        return table.mapInArrow(summed, f"{kinds}sums array<double>").groupBy(*keys).agg(_totals("sums", range(width)).alias("sums")).filter("sums[0] IS NOT NULL")

    def solved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            out = part[keys].copy()
            found = {c: [] for c in ("n", "mean", "beta", "lam", "edf", "edf_total", "dispersion", "deviance", "null_deviance", "cov", "c")}
            centres = part["c"] if "c" in part.columns else [None] * len(part)
            for flat, held in zip(part["sums"], centres):
                flat = np.asarray(flat, float)
                whole = np.zeros((p + 1, p + 1))
                whole[upper] = flat[: len(upper[0])]
                whole = whole + np.triu(whole, 1).T
                n, total, off, null = flat[-4:]
                centre = whole[0, :p] if held is None else np.asarray(held)  # sums of the columns over the rows
                turn, spots = [np.eye(p)[:, :fixed]], []
                for low, high in spans:
                    own = np.zeros((p, high - low - 1))
                    own[low:high] = _null_space(centre[low:high])
                    spots.append((sum(b.shape[1] for b in turn), high - low - 1))
                    turn.append(own)
                turn = np.hstack(turn)
                gram, xy, yy = turn.T @ whole[:p, :p] @ turn, turn.T @ whole[:p, p], whole[p, p]
                lam, gamma, v, phi = select(gram, xy, yy, n, [turn.T @ s @ turn for s in penalties], estimated)
                influence = np.einsum("ij,ji->i", v, gram)
                if family == "gaussian":
                    off, null = yy - 2 * gamma @ xy + gamma @ gram @ gamma, yy - total * total / n
                values = (int(n), total / n, turn @ gamma, lam, [influence[a : a + b].sum() for a, b in spots], influence.sum(), phi, off, null, (phi * turn @ v @ turn.T).ravel(), centre)
                for c, value in zip(found, values):
                    found[c].append(value)
            for c, value in found.items():
                out[c] = value
            yield out

    fields = "n long, mean double, beta array<double>, lam array<double>, edf array<double>, edf_total double, dispersion double, deviance double, null_deviance double, cov array<double>, c array<double>"
    fit = sums_of(base).mapInPandas(solved, kinds + fields)
    if family != "gaussian":
        held = _Held(fit, None, 2 * p * p)
        on = lambda prefix: [F.col(k).alias(f"{prefix}{k}") for k in keys]
        for _ in range(rounds):
            named = held.table.select(*on("_k_"), F.col("beta").alias("_b"), F.col("mean").alias("_m"))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
            met = base.join(F.broadcast(named) if held.few or not keys else named, same).select(*keys, *design.names, "_y", "_b", "_m")
            kept = held.table.select(*on("_k_"), "c")
            again = sums_of(met).join(F.broadcast(kept) if held.few or not keys else kept, same).drop(*(f"_k_{k}" for k in keys))
            after = _Held(again.mapInPandas(solved, kinds + fields), held.few)
            moved = after.largest_move(held, keys)
            held = after  # deviances are those of the coefficients before, which no longer move
            if moved <= tol:
                break
        fit = held.table
    return Gam(fit.drop("c", "mean"), keys, design, family)
