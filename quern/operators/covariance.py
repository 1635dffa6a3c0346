"""Covariance families by group: moments in one aggregate, small matrices as expressions of them (up to three variables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import geometry as g


def _covariances(x: list[Column], y: list[Column]) -> list[list[Column]]:
    return [[F.covar_samp(a, b) for b in y] for a in x]


def _long(table: DataFrame, keys: list[str], m: list[list[Column]], rows: list[str], columns: list[str]) -> DataFrame:
    """keys, i, j, value of a matrix of expressions."""
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), m[i][j].alias("value")) for i, a in enumerate(rows) for j, b in enumerate(columns)]
    return table.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def _held(table: DataFrame, keys: list[str], m: list[list[Column]]) -> tuple[DataFrame, list[list[Column]]]:
    named = [m[i][j].alias(f"_m{i}_{j}") for i in range(len(m)) for j in range(len(m[0]))]
    return table.groupBy(*keys).agg(*named), [[F.col(f"_m{i}_{j}") for j in range(len(m[0]))] for i in range(len(m))]


def paired_covariance(rows: DataFrame, keys: list[str], x: dict[str, Column], y: dict[str, Column]) -> DataFrame:
    """Covariance of each x with each y by group: keys, i, j, value."""
    table, m = _held(rows, keys, _covariances(list(x.values()), list(y.values())))
    return _long(table, keys, m, list(x), list(y))


def paired_correlation(rows: DataFrame, keys: list[str], x: dict[str, Column], y: dict[str, Column]) -> DataFrame:
    """The same, by both deviations; 0 where one is constant."""
    r = [[F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)) for b in y.values()] for a in x.values()]
    table, m = _held(rows, keys, r)
    return _long(table, keys, m, list(x), list(y))


def _precision(rows: DataFrame, keys: list[str], x: dict[str, Column]) -> tuple[DataFrame, list[list[Column]]]:
    table, m = _held(rows, keys, _covariances(list(x.values()), list(x.values())))
    inverse = g.inverse(m)
    table = table.select(*keys, *(v.alias(f"_p{i}_{j}") for i, row in enumerate(inverse) for j, v in enumerate(row)))
    return table, [[F.col(f"_p{i}_{j}") for j in range(len(x))] for i in range(len(x))]


def precision(rows: DataFrame, keys: list[str], x: dict[str, Column]) -> DataFrame:
    """Inverse covariance of up to three variables."""
    table, m = _precision(rows, keys, x)
    return _long(table, keys, m, list(x), list(x))


def partial_covariance(rows: DataFrame, keys: list[str], x: dict[str, Column]) -> DataFrame:
    """The precision with the sign of all but the diagonal turned."""
    table, m = _precision(rows, keys, x)
    signed = [[v if i == j else -v for j, v in enumerate(row)] for i, row in enumerate(m)]
    return _long(table, keys, signed, list(x), list(x))


def partial_correlation(rows: DataFrame, keys: list[str], x: dict[str, Column]) -> DataFrame:
    table, m = _precision(rows, keys, x)
    scaled = [[(v if i == j else -v) / F.sqrt(m[i][i] * m[j][j]) for j, v in enumerate(row)] for i, row in enumerate(m)]
    return _long(table, keys, scaled, list(x), list(x))


def _conditional(rows: DataFrame, keys: list[str], x: dict[str, Column], given: dict[str, Column]) -> tuple[DataFrame, list[list[Column]]]:
    """Covariance of what is left of x after a fit on `given` without an intercept, from moments of both."""
    xs, ys = list(x.values()), list(given.values())
    parts = {"c": _covariances(xs, xs), "b": _covariances(ys, xs), "d": _covariances(ys, ys), "g": [[F.sum(a * b) for b in ys] for a in ys], "h": [[F.sum(a * b) for b in xs] for a in ys]}
    named = [v.alias(f"_{n}{i}_{j}") for n, m in parts.items() for i, row in enumerate(m) for j, v in enumerate(row)]
    table = rows.groupBy(*keys).agg(*named)
    c, b, d, gram, cross = ([[F.col(f"_{n}{i}_{j}") for j in range(len(m[0]))] for i in range(len(m))] for n, m in parts.items())
    beta = g.product(g.inverse(gram), cross)
    table = table.select("*", *(v.alias(f"_e{i}_{j}") for i, row in enumerate(beta) for j, v in enumerate(row)))
    beta = [[F.col(f"_e{i}_{j}") for j in range(len(xs))] for i in range(len(ys))]
    fitted = g.product(g.transpose(beta), b)
    both = g.product(g.product(g.transpose(beta), d), beta)
    out = [[c[i][j] - fitted[i][j] - fitted[j][i] + both[i][j] for j in range(len(xs))] for i in range(len(xs))]
    return table, out


def conditional_covariance(rows: DataFrame, keys: list[str], x: dict[str, Column], given: dict[str, Column]) -> DataFrame:
    table, m = _conditional(rows, keys, x, given)
    return _long(table, keys, m, list(x), list(x))


def conditional_correlation(rows: DataFrame, keys: list[str], x: dict[str, Column], given: dict[str, Column]) -> DataFrame:
    table, m = _conditional(rows, keys, x, given)
    return _long(table, keys, [[v / F.sqrt(m[i][i] * m[j][j]) for j, v in enumerate(row)] for i, row in enumerate(m)], list(x), list(x))


def extended_bic(rows: DataFrame, keys: list[str], x: dict[str, Column], gamma: float = 0.5, edge: float = 1e-8) -> DataFrame:
    """Extended BIC of the full precision of up to three variables: -n (log det P - tr(S P)) + E log n + 4 E gamma log p."""
    p = len(x)
    names = list(x.values())
    held = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.covar_pop(a, b).alias(f"_m{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)))
    m = [[F.col(f"_m{i}_{j}") for j in range(p)] for i in range(p)]
    inverse = g.inverse(m)
    edges = sum(((F.abs(inverse[i][j]) > edge).cast("int") for i in range(p) for j in range(i + 1, p)), F.lit(0))
    fit = -F.log(g.det(m)) - p  # tr(S P) is p for the inverse
    return held.select(*keys, (-F.col("_n") * fit + edges * F.log("_n") + 4 * edges * gamma * F.log(F.lit(float(p)))).alias("ebic"))


def cholesky_cells(rows: DataFrame, keys: list[str], x: dict[str, Column]) -> tuple[DataFrame, list[list[Column]], list[list[Column]]]:
    """Covariances by group as columns, their matrix, and its Cholesky factor as columns of the same table."""
    table, m = _held(rows, keys, _covariances(list(x.values()), list(x.values())))
    lower = g.cholesky(m)
    table = table.select("*", *(v.alias(f"_l{i}_{j}") for i, row in enumerate(lower) for j, v in enumerate(row)))
    return table, m, [[F.col(f"_l{i}_{j}") for j in range(len(x))] for i in range(len(x))]
