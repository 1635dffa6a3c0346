"""Linear mixed models with one grouping factor, fitted by restricted likelihood for all elements at once.

y = X beta + Z b + e, b of each group normal with covariance G, e with variance s. One aggregate turns the rows of each
(element, group) into products of X, Z and y; a group's rows are never gathered, and nothing later reads the rows again.
Each round is one pass over those products: a group adds its share of the likelihood, of its slopes and of its expected
information, by the matrix inversion lemma in matrices of Z's width. The sums, a row an element, give the next step of all
elements: a damped scoring step in logarithms (of s, of the diagonal of G's Cholesky factor), taken back and damped more
where the likelihood fell. Elements that have converged stay as they are.

Rows with a null in y, X, Z or the group are left out. An element whose fixed effects are not told apart by its rows gets
the pseudo-inverse's. A variance that the likelihood puts at zero comes out very small, not negative. Where effects whose
covariance is free come out dependent on each other, rounds can end before the last digits do: `converged` is then false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import tails
from quern.operators.models import _same
from quern.session import discard, staged

#: Where elements times the sums of each are at most so many numbers, the sums of a round go to the driver and the next
#: parameters come back by broadcast; beyond, both are exchanged and each round is written.
MOST_HELD = 1_000_000
#: Steps of a logarithm are at most so long, it stays within so far of the residual's, and is left with less slope than that.
LONGEST_STEP, FARTHEST, SETTLED = 3.0, 40.0, 1e-8


def group_products(rows: DataFrame, keys: list[str], group: str, x: list[Column], z: list[Column], y: Column) -> DataFrame:
    """keys, group, n and the products tt (of [X, y], upper triangle), zt (Z by [X, y]) and zz (Z by Z, upper triangle)."""
    t = [*x, y]
    named = [c.cast("double").alias(f"_t{i}") for i, c in enumerate(t)] + [c.cast("double").alias(f"_z{i}") for i, c in enumerate(z)]
    ready = rows.select(*keys, group, *named).dropna(subset=[group, *(f"_t{i}" for i in range(len(t))), *(f"_z{i}" for i in range(len(z)))])
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    tt = [total(f"_t{i}", f"_t{j}") for i in range(len(t)) for j in range(i, len(t))]
    zt = [total(f"_z{i}", f"_t{j}") for i in range(len(z)) for j in range(len(t))]
    zz = [total(f"_z{i}", f"_z{j}") for i in range(len(z)) for j in range(i, len(z))]
    return ready.groupBy(*keys, group).agg(F.count("*").alias("n"), F.array(*tt).alias("tt"), F.array(*zt).alias("zt"), F.array(*zz).alias("zz"))


def _square(flat: np.ndarray, n: int) -> np.ndarray:
    """Symmetric matrices of their upper triangles."""
    out = np.empty((len(flat), n, n))
    i, j = np.triu_indices(n)
    out[:, i, j] = out[:, j, i] = flat
    return out


def _stack(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_list()).astype(float) if len(column) else np.zeros((0, width))


class Layout:
    """Which parameters there are: r logarithms and, unless diagonal, the factor's other entries; last the residual's."""

    def __init__(self, p: int, r: int, diagonal: bool):
        self.p, self.r, self.t = p, r, p + 1
        self.places = [(i, i) for i in range(r)] + ([] if diagonal else [(i, j) for i in range(r) for j in range(i)])
        self.n = len(self.places) + 1
        self.pairs = [(j, k) for j in range(self.n) for k in range(j, self.n)]
        self.shapes = [("loglik", ()), ("tvt", (self.t, self.t)), ("trace", (self.n,)), ("q", (self.n, self.t, self.t)), ("info", (len(self.pairs),)), ("r", (len(self.pairs), p, p))]

    def covariance(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """G, its derivatives by each of its parameters, and s, of rows of parameters."""
        factor = np.zeros((len(theta), self.r, self.r))
        for k, (i, j) in enumerate(self.places):
            factor[:, i, j] = np.exp(theta[:, k] / 2) if i == j else theta[:, k]  # logarithms are of variances
        slopes = np.zeros((len(theta), self.n - 1, self.r, self.r))
        for k, (i, j) in enumerate(self.places):
            move = np.zeros_like(factor)
            move[:, i, j] = factor[:, i, j] / 2 if i == j else 1.0
            slopes[:, k] = move @ factor.transpose(0, 2, 1) + factor @ move.transpose(0, 2, 1)
        return factor @ factor.transpose(0, 2, 1), slopes, np.exp(theta[:, -1])

    def shares(self, theta: np.ndarray, n: np.ndarray, tt: np.ndarray, zt: np.ndarray, zz: np.ndarray) -> list[np.ndarray]:
        """What each group adds to the sums of its element, in the order of `shapes`."""
        g, d, s = self.covariance(theta)
        eye, s1 = np.eye(self.r), s[:, None, None]
        m = np.linalg.solve(s1 * eye + g @ zz, g)
        m = (m + m.transpose(0, 2, 1)) / 2
        tz, ms = zt.transpose(0, 2, 1), m @ zz
        once, twice, thrice = tz @ m @ zt, tz @ ms @ m @ zt, tz @ ms @ ms @ m @ zt
        v1, v2 = (tt - once) / s1, (tt - 2 * once + twice) / s1**2
        v3 = (tt - 3 * once + 3 * twice - thrice) / s1**3
        sm, sms = zz @ m, zz @ m @ zz
        w1 = (zt - sm @ zt) / s1
        w2 = (zt - 2 * sm @ zt + sm @ sm @ zt) / s1**2
        c1, c2 = (zz - sms) / s1, (zz - 2 * sms + sms @ m @ zz) / s1**2
        trace = lambda a: np.trace(a, axis1=1, axis2=2)
        of_ms = trace(ms)
        loglik = -0.5 * (n * np.log(s) + np.linalg.slogdet(eye + g @ zz / s1)[1])
        last, x = self.n - 1, slice(0, self.p)
        traces = [trace(c1 @ d[:, k]) for k in range(last)] + [n - of_ms]  # by log s: s times the trace of the inverse
        q = [w1.transpose(0, 2, 1) @ d[:, k] @ w1 for k in range(last)] + [s1 * v2]
        info, r = [], []
        for j, k in self.pairs:
            if k < last:
                info.append(trace(c1 @ d[:, j] @ c1 @ d[:, k]))
                r.append((w1.transpose(0, 2, 1) @ d[:, j] @ c1 @ d[:, k] @ w1)[:, x, x])
            elif j < last:
                info.append(s * trace(c2 @ d[:, j]))
                r.append((s1 * (w1.transpose(0, 2, 1) @ d[:, j] @ w2))[:, x, x])
            else:
                info.append(n - 2 * of_ms + trace(ms @ ms))
                r.append((s1**2 * v3)[:, x, x])
        return [loglik, v1, np.stack(traces, axis=1), np.stack(q, axis=1), np.stack(info, axis=1), np.stack(r, axis=1)]

    def width(self) -> int:
        return sum(int(np.prod(shape)) for _, shape in self.shapes)

    def parted(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes:
            size = int(np.prod(shape))
            out[name] = flat[:, at : at + size].reshape(len(flat), *shape)
            at += size
        return out

    def evaluated(self, flat: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Likelihood, its slopes, the expected information and the fixed effects of elements, from their sums."""
        sums, p = self.parted(flat), self.p
        a, b, c = sums["tvt"][:, :p, :p], sums["tvt"][:, :p, p], sums["tvt"][:, p, p]
        cov = np.linalg.pinv(a, hermitian=True)
        beta = np.einsum("nij,nj->ni", cov, b)
        rank = np.linalg.matrix_rank(a, hermitian=True)
        determinant = np.log(np.clip(np.linalg.eigvalsh(a), 1e-300, None)).sum(axis=1)
        loglik = sums["loglik"] - 0.5 * (determinant + c - (b * beta).sum(axis=1) + (n - rank) * np.log(2 * np.pi))
        residual = np.concatenate([-beta, np.ones((len(beta), 1))], axis=1)
        q = sums["q"]
        qx = q[:, :, :p, :p]
        score = -0.5 * (sums["trace"] - np.einsum("nij,nkji->nk", cov, qx) - np.einsum("ni,nkij,nj->nk", residual, q, residual))
        info = np.empty((len(flat), self.n, self.n))
        for e, (j, k) in enumerate(self.pairs):
            cross = np.einsum("nij,nji->n", cov, sums["r"][:, e] + sums["r"][:, e].transpose(0, 2, 1))
            both = np.einsum("nij,njk,nkl,nli->n", cov, qx[:, j], cov, qx[:, k])
            info[:, j, k] = info[:, k, j] = 0.5 * (sums["info"][:, e] - cross + both)
        return {"loglik": loglik, "score": score, "info": info, "beta": beta, "cov": cov, "moves": qx, "rank": rank}


_STATE = (
    "n long, theta array<double>, trial array<double>, loglik double, score array<double>, info array<double>, beta array<double>, cov array<double>, moves array<double>, "
    "rank int, damping double, done boolean, rounds int"
)


def _step(theta: np.ndarray, score: np.ndarray, info: np.ndarray, damping: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next parameters to try and the gain that the quadratic promises."""
    k = theta.shape[1]
    # a variance on its way to zero that has nothing more to gain stays, so that it does not hold up the others
    still = logs & (score < 0) & (score > -SETTLED) & (np.arange(k) < k - 1)
    score = np.where(still, 0.0, score)
    info = np.where(still[:, :, None] | still[:, None, :], np.eye(k), info)
    diagonal = np.einsum("nii->ni", info)
    held = info + (damping[:, None] * np.maximum(diagonal, 1e-12))[:, :, None] * np.eye(k) + 1e-12 * np.eye(k)
    move = np.linalg.solve(held, score[:, :, None])[:, :, 0]
    longest = np.abs(np.where(logs, move, 0)).max(axis=1)
    short = move * np.minimum(1.0, LONGEST_STEP / np.maximum(longest, 1e-300))[:, None]  # as a whole, or each logarithm for itself
    cut = np.where(logs, np.clip(move, -LONGEST_STEP, LONGEST_STEP), move)
    rises = lambda m: (score * m).sum(axis=1)
    move = np.where((rises(cut) > rises(short))[:, None], cut, short)
    trial = theta + move
    low, high = trial[:, -1:] - FARTHEST, trial[:, -1:] + FARTHEST
    return np.where(logs, np.clip(trial, low, high), trial), rises(move)


def _started(layout: Layout):
    """First state of each element: half its residual variance to the groups, half to the rest."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            tt = _square(_stack(part["tt"], 0), layout.t)
            n, p = part["n"].to_numpy(float), layout.p
            a, b = tt[:, :p, :p], tt[:, :p, p]
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(a, hermitian=True), b)
            spread = np.maximum((tt[:, p, p] - (b * beta).sum(axis=1)) / np.maximum(n - p, 1), 1e-300) / 2
            size = np.maximum(_stack(part["z2"], layout.r) / n[:, None], 1e-300)
            theta = np.zeros((len(part), layout.n))
            theta[:, : layout.r], theta[:, -1] = np.log(spread[:, None] / size), np.log(spread)
            out = part[[c for c in part.columns if c not in ("tt", "z2")]].copy()
            out["theta"] = out["trial"] = list(theta)
            zeros = lambda k: [np.zeros(k)] * len(part)
            out["loglik"], out["score"], out["info"] = -np.inf, zeros(layout.n), zeros(layout.n**2)
            out["beta"], out["cov"], out["moves"] = list(beta), zeros(p * p), zeros(layout.n * p * p)
            out["rank"], out["damping"], out["done"], out["rounds"] = p, 1e-6, False, 0
            yield out

    return run


def _stepped(layout: Layout, tol: float):
    """State after the sums at the trial parameters are known."""
    logs = np.array([i == j for i, j in layout.places] + [True])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            part = part.reset_index(drop=True)
            found = layout.evaluated(_stack(part["sums"], 0), part["n"].to_numpy(float))
            theta, trial = _stack(part["theta"], 0), _stack(part["trial"], 0)
            before, damping = part["loglik"].to_numpy(float), part["damping"].to_numpy(float)
            done, n = part["done"].to_numpy(bool), len(part)
            better = ~done & np.isfinite(found["loglik"]) & (found["loglik"] >= before - 1e-12 * np.abs(found["loglik"]))
            pick = lambda new, old: np.where(better.reshape(-1, *[1] * (np.ndim(new) - 1)), new, old)
            flat = lambda name: found[name].reshape(n, -1)
            theta = pick(trial, theta)
            held = {c: pick(flat(c), _stack(part[c], 0)) for c in ("score", "info", "beta", "cov", "moves")}
            damping = np.where(better, np.maximum(damping / 10, 1e-8), np.maximum(damping * 10, 1e-2))
            trial, gain = _step(theta, held["score"], held["info"].reshape(n, layout.n, layout.n), damping, logs)
            out = part[[c for c in part.columns if c != "sums"]].copy()
            for c, v in held.items():
                out[c] = list(v)
            out["theta"], out["trial"] = list(theta), list(trial)
            out["loglik"], out["rank"] = pick(found["loglik"], before), pick(found["rank"], part["rank"].to_numpy())
            out["damping"], out["rounds"] = np.where(done, part["damping"], damping), part["rounds"] + ~done
            # a step that promises nothing, or one that no damping makes good
            out["done"] = done | (better & (gain <= tol * np.maximum(np.abs(found["loglik"]) / 100, 1))) | (damping > 1e8)
            yield out

    return run


def _contributed(layout: Layout, keys: list[str], kinds: str):
    """Sums of the groups' shares by element, within each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.to_pandas()
            parts = layout.shares(_stack(part["trial"], 0), part["n"].to_numpy(float), _square(_stack(part["tt"], 0), layout.t), _stack(part["zt"], 0).reshape(-1, layout.r, layout.t), _square(_stack(part["zz"], 0), layout.r))
            flat = np.concatenate([v.reshape(len(part), -1) for v in parts], axis=1)
            if keys:
                number = part.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                sums = np.zeros((number.max() + 1, flat.shape[1]))
                np.add.at(sums, number, flat)
                first = np.unique(number, return_index=True)[1]
                columns = [batch.column(k).take(pa.array(first)) for k in keys]
            else:
                sums, columns = flat.sum(axis=0, keepdims=True), []
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sums), pa.list_(pa.float64()))], names=[*keys, "sums"])

    return run, f"{kinds}sums array<double>"


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _joined(products: DataFrame, state: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """products with the columns of their element's state."""
    named = state.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return products.join(F.broadcast(named) if few or not keys else named, _same(keys)).drop(*(f"_k_{k}" for k in keys))


class Fit:
    """A fitted model. `table` is a row an element: keys, n, beta, cov (of the fixed effects, row-major), g (row-major), s,
    loglik, rank, theta, theta_cov, moves (slopes of cov's inverse, for degrees of freedom), rounds, converged."""

    def __init__(self, products: DataFrame, table: DataFrame, keys: list[str], group: str, layout: Layout, few: bool):
        self.products, self.table, self.keys, self.group, self.layout, self.few = products, table, keys, group, layout, few

    def ranef(self) -> DataFrame:
        """keys, group, blup: the predicted random effects of each group, G Z' V^-1 (y - X beta)."""
        layout, names = self.layout, [*self.keys, self.group]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.to_pandas()
                zt, zz = _stack(part["zt"], 0).reshape(-1, layout.r, layout.t), _square(_stack(part["zz"], 0), layout.r)
                g, s = _stack(part["_g"], 0).reshape(-1, layout.r, layout.r), part["_s"].to_numpy(float)[:, None, None]
                left = zt[:, :, -1] - np.einsum("nij,nj->ni", zt[:, :, :-1], _stack(part["_beta"], 0))
                effect = np.linalg.solve(s * np.eye(layout.r) + g @ zz, np.einsum("nij,nj->ni", g, left)[:, :, None])[:, :, 0]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(list(effect), pa.list_(pa.float64()))], names=[*names, "blup"])

        own = self.table.select(*self.keys, F.col("beta").alias("_beta"), F.col("g").alias("_g"), F.col("s").alias("_s"))
        met = _joined(self.products, own, self.keys, self.few)
        return met.mapInArrow(run, _kinds(self.products, names) + "blup array<double>")

    def predict(self, rows: DataFrame, x: list[Column], z: list[Column] | None = None) -> DataFrame:
        """rows with `predicted`: X beta, and with z also the effects of the row's group (none for a group not seen)."""
        line = sum((F.col("_b")[i] * c for i, c in enumerate(x)), F.lit(0.0))
        fixed = self.table.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys), F.col("beta").alias("_b"))
        if z is not None:
            own = self.ranef().select(*(F.col(k).alias(f"_k_{k}") for k in [*self.keys, self.group]), F.col("blup").alias("_u"))
            names = [*self.keys, self.group]
            rows = rows.join(own, _same(names), "left").drop(*(f"_k_{k}" for k in names))
            line = line + sum((F.coalesce(F.col("_u")[i], F.lit(0.0)) * c for i, c in enumerate(z)), F.lit(0.0))
        met = rows.join(F.broadcast(fixed) if self.few or not self.keys else fixed, _same(self.keys))
        return met.withColumn("predicted", line).drop("_b", "_u", *(f"_k_{k}" for k in self.keys))

    def f_contrast(self, contrasts: list[list[float]]) -> DataFrame:
        """keys, f, df1, df2, p of C beta = 0, with Satterthwaite's degrees of freedom over the contrasts' principal axes."""
        layout, rows, keys = self.layout, np.array(contrasts, float), self.keys

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if not len(part):
                    continue
                part = part.reset_index(drop=True)
                p, k = layout.p, layout.n
                beta, cov = _stack(part["beta"], 0), _stack(part["cov"], 0).reshape(-1, p, p)
                moves, of_theta = _stack(part["moves"], 0).reshape(-1, k, p, p), _stack(part["theta_cov"], 0).reshape(-1, k, k)
                f, df2 = np.empty(len(part)), np.empty(len(part))
                for e in range(len(part)):
                    sizes, axes = np.linalg.eigh(rows @ cov[e] @ rows.T)
                    use = sizes > 1e-12 * sizes.max()
                    turned = axes.T[use] @ rows  # uncorrelated contrasts
                    f[e] = (((turned @ beta[e]) ** 2) / sizes[use]).sum() / use.sum()
                    w = turned @ cov[e]
                    slope = np.einsum("ai,kij,aj->ak", w, moves[e], w)
                    nu = 2 * sizes[use] ** 2 / np.maximum(np.einsum("ak,kl,al->a", slope, of_theta[e], slope), 1e-300)
                    if use.sum() == 1:
                        df2[e] = nu[0]
                    else:
                        total = (nu[nu > 2] / (nu[nu > 2] - 2)).sum()
                        df2[e] = 2 * total / (total - use.sum()) if total > use.sum() else 0.0
                out = part[keys].copy()
                out["f"], out["df1"], out["df2"] = f, float(np.linalg.matrix_rank(rows)), df2
                yield out

        table = self.table.select(*keys, "beta", "cov", "moves", "theta_cov").mapInPandas(run, _kinds(self.table, keys) + "f double, df1 double, df2 double")
        return table.withColumn("p", tails.f_pvalue(F.col("f"), F.col("df1"), F.col("df2")))

    def t_contrast(self, contrast: list[float]) -> DataFrame:
        """keys, effect, se, t, df (Satterthwaite), p of one contrast of the fixed effects."""
        p = self.layout.p
        effect = sum((F.col("beta")[i] * float(c) for i, c in enumerate(contrast)), F.lit(0.0))
        spread = sum((F.col("cov")[i * p + j] * float(contrast[i] * contrast[j]) for i in range(p) for j in range(p)), F.lit(0.0))
        own = self.table.select(*self.keys, effect.alias("effect"), F.sqrt(spread).alias("se"))
        df = self.f_contrast([contrast]).select(*(F.col(k).alias(f"_k_{k}") for k in self.keys), F.col("df2").alias("df"))
        met = own.join(df if self.keys else F.broadcast(df), _same(self.keys)).drop(*(f"_k_{k}" for k in self.keys))
        met = met.withColumn("t", F.col("effect") / F.col("se"))
        return met.withColumn("p", tails.t_pvalue(F.col("t"), F.col("df")))


def lme_fit(rows: DataFrame, keys: list[str], group: str, x: list[Column], y: Column, z: list[Column] | None = None, diagonal: bool = False, rounds: int = 60, tol: float = 1e-14) -> Fit:
    """The mixed model of each element (keys). z: columns with random effects by group, by default an intercept; diagonal:
    independent effects. Rounds end when no element's step promises more than tol of log-likelihood
    (of a hundredth of it, where that is more than 1)."""
    z = [F.lit(1.0)] if z is None else z
    layout = Layout(len(x), len(z), diagonal)
    products = staged(group_products(rows, keys, group, x, z, y))
    zz = np.array([i == j for i in range(layout.r) for j in range(i, layout.r)])
    sums = products.groupBy(*keys).agg(F.sum("n").alias("n"), _totals("tt", range(layout.t * (layout.t + 1) // 2)).alias("tt"), _totals("zz", np.flatnonzero(zz).tolist()).alias("z2"))
    sums = staged(sums if keys else sums.filter("n IS NOT NULL"))
    few = sums.count() * layout.width() <= MOST_HELD
    table = (_rounds_held if few else _rounds_exchanged)(products, sums, keys, layout, rounds, tol)
    discard(sums)
    return Fit(products, table, keys, group, layout, few)


def _totals(column: str, places) -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in places))


def _rounds_held(products: DataFrame, sums: DataFrame, keys: list[str], layout: Layout, rounds: int, tol: float) -> DataFrame:
    """Rounds whose state, a row an element, is on the driver."""
    spark, kinds = products.sparkSession, _kinds(products, keys)
    found = sums.collect()
    if not found:
        return spark.createDataFrame([], kinds + _TABLE)
    names = [tuple(r[k] for k in keys) for r in found]
    state = next(_started(layout)(iter([pd.DataFrame({"_e": range(len(found)), "n": [r["n"] for r in found], "tt": [r["tt"] for r in found], "z2": [r["z2"] for r in found]})])))
    run, schema = _contributed(layout, ["_e"], "_e int, ")
    for _ in range(rounds):
        going = state[~state["done"].to_numpy(bool)]
        asked = [(*names[e], int(e), [float(v) for v in trial]) for e, trial in zip(going["_e"], going["trial"])]
        trials = spark.createDataFrame(asked, f"{kinds}_e int, trial array<double>")
        met = _joined(products.select(*keys, "n", "tt", "zt", "zz"), trials, keys, True).select("_e", "trial", "n", "tt", "zt", "zz")
        added = {r["_e"]: r["sums"] for r in met.mapInArrow(run, schema).groupBy("_e").agg(_totals("sums", range(layout.width())).alias("sums")).collect()}
        stepped = next(_stepped(layout, tol)(iter([going.assign(sums=[added[e] for e in going["_e"]])])))
        state = pd.concat([state[state["done"].to_numpy(bool)], stepped], ignore_index=True)
        if state["done"].all():
            break
    final = next(_finished(layout)(iter([state])))
    fields = [c.split()[0] for c in _TABLE.split(", ")]
    plain = lambda v: v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v
    return spark.createDataFrame([(*names[r["_e"]], *(plain(r[c]) for c in fields)) for r in final.to_dict("records")], kinds + _TABLE)


def _rounds_exchanged(products: DataFrame, sums: DataFrame, keys: list[str], layout: Layout, rounds: int, tol: float) -> DataFrame:
    """Rounds whose state is a table, written after each."""
    kinds = _kinds(products, keys)
    state = staged(sums.mapInPandas(_started(layout), kinds + _STATE))
    run, schema = _contributed(layout, keys, kinds)
    for _ in range(rounds):
        met = _joined(products.select(*keys, "n", "tt", "zt", "zz"), state.filter("NOT done").select(*keys, "trial"), keys, False)
        added = met.mapInArrow(run, schema).groupBy(*keys).agg(_totals("sums", range(layout.width())).alias("sums"))
        going = state.filter("NOT done").join(added.withColumnsRenamed({k: f"_k_{k}" for k in keys}), _same(keys)).drop(*(f"_k_{k}" for k in keys))
        after = staged(going.mapInPandas(_stepped(layout, tol), kinds + _STATE).unionByName(state.filter("done")))
        discard(state)
        state = after
        if state.filter("NOT done").isEmpty():
            break
    return staged(state.mapInPandas(_finished(layout), kinds + _TABLE))


_TABLE = "n long, beta array<double>, cov array<double>, g array<double>, s double, loglik double, rank int, theta array<double>, theta_cov array<double>, moves array<double>, rounds int, converged boolean"


def _finished(layout: Layout):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            part = part.reset_index(drop=True)
            g, _, s = layout.covariance(_stack(part["theta"], 0))
            info = _stack(part["info"], 0).reshape(-1, layout.n, layout.n)
            out = part.drop(columns=["trial", "score", "info", "damping"]).rename(columns={"done": "converged"})
            out["g"], out["s"], out["theta_cov"] = list(g.reshape(len(part), -1)), s, list(np.linalg.pinv(info, hermitian=True).reshape(len(part), -1))
            yield out

    return run


def reml_fit(rows: DataFrame, keys: list[str], group: str, x: list[Column], y: Column, rounds: int = 60) -> Fit:
    """A random intercept by group."""
    return lme_fit(rows, keys, group, x, y, rounds=rounds)
