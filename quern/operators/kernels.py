"""Kernels and neighbours between a stated query set and all rows.

Queries and rows meet in groups of bounded size, a part of the rows with a slice of the queries; a group's pairs are
computed as matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.arrays import doubles, lp_normalize

#: Mean rows and queries of one group, the queries of one matrix, and the most partitions that groups are dealt to.
ROWS, QUERIES, STEP, PARTITIONS = 1024, 1024, 128, 4096


def _dots(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """Dot products of all pairs, summed entry by entry from the first; r holds a vector a column."""
    total, term = np.zeros((len(q), r.shape[1])), np.empty((len(q), r.shape[1]))
    for j in range(q.shape[1]):
        total += np.multiply(q[:, j : j + 1], r[j], out=term)
    return [total]


def _distances(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    total, term = np.zeros((len(q), r.shape[1])), np.empty((len(q), r.shape[1]))
    for j in range(q.shape[1]):
        np.subtract(q[:, j : j + 1], r[j], out=term)
        total += np.multiply(term, term, out=term)
    return [total]


def _angles(q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    """Angles between points: of the length of the cross product and the dot product."""
    x, y, z = (q[:, j : j + 1] for j in range(3))
    u, v, w = r[0], r[1], r[2]
    a, b, c = y * w - z * v, z * u - x * w, x * v - y * u
    return [np.arctan2(np.sqrt(a * a + b * b + c * c), x * u + y * v + z * w)]


#: What tasks compute of a pair, and what becomes of that and the vectors' width.
KERNELS: dict[str, tuple[Callable, Callable[..., Column]]] = {
    "linear": (_dots, lambda v, p: v[0]),
    "distance": (_distances, lambda v, p: v[0]),
    "rbf": (_distances, lambda v, p: F.exp(-v[0] / p)),
    "polynomial": (_dots, lambda v, p: F.pow(v[0] / p + 0.0, F.lit(3.0))),
    "sigmoid": (_dots, lambda v, p: F.tanh(v[0] / p)),
    "cosine": (_dots, lambda v, p: v[0]),
    "geodesic": (_angles, lambda v, p: v[0]),
}


#: Kernels that take the vectors' width.
WIDE = ("rbf", "polynomial", "sigmoid")


def _dealt(queries: DataFrame, rows: DataFrame, size: int = ROWS, together: bool = False):
    """Both tables grouped by part of the rows and slice of the queries, for a cogroup. together: rows of one vector go to
    one part, or to as many as they fill, by ranges of (_near, a hash of the vector, and id)."""
    parts, slices = max(1, -(-rows.count() // size)), max(1, -(-queries.count() // QUERIES))
    place = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", place("q_id", slices).alias("_slice")).withColumn("_part", every(parts))
    if together:
        near = rows.select("*", F.xxhash64("vec").alias("_near")).repartitionByRange(parts, "_near", "id")
        right = near.withColumn("_part", F.spark_partition_id()).withColumn("_slice", every(slices))
    else:
        right = rows.select("*", place("id", parts).alias("_part")).withColumn("_slice", every(slices))
    number = min(parts * slices, PARTITIONS)
    return (t.repartition(number, "_part", "_slice").groupBy("_part", "_slice") for t in (left, right))


def _matrices(table: pa.Table, id: str, vec: str) -> dict[int, tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """By width of the vectors: ids, matrix, which of them miss an entry, and their places in the table."""
    at, vectors = table.column(id).combine_chunks(), table.column(vec).combine_chunks()
    widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    out = {}
    for width in sorted(set(widths[widths >= 0].tolist())):
        place = np.flatnonzero(widths == width)
        flat = vectors.take(pa.array(place)).flatten()
        missing = pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(place), width).any(axis=1)
        out[width] = at.take(pa.array(place)), flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(place), width), missing, place
    return out


def _steps(mine: pa.Table, others: pa.Table, pairwise: Callable) -> Iterator[tuple]:
    """(width, ids of some queries, row ids, pair values, pairs that miss an entry, places of the rows)."""
    found = _matrices(others, "id", "vec")
    for width, (asked, q, gap, _) in _matrices(mine, "q_id", "q_vec").items():
        if width in found:
            ids, r, lack, place = found[width]
            first = np.ones(len(r), bool)  # of equal vectors that follow each other, the first is computed
            first[1:] = (r[1:].view("int64") != r[:-1].view("int64")).any(axis=1)
            columns, times = np.ascontiguousarray(r[first].T), np.diff(np.append(np.flatnonzero(first), len(r)))
            for k in range(0, len(q), STEP):
                with np.errstate(invalid="ignore", over="ignore"):
                    values = pairwise(q[k : k + STEP], columns)
                if not first.all():
                    values = [np.repeat(v, times, axis=1) for v in values]
                yield width, asked.slice(k, STEP), ids, values, gap[k : k + STEP, None] | lack[None, :], place


def _joined(tables: list[pa.Table], schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    return pa.concat_tables([t.cast(wanted) for t in tables]) if tables else wanted.empty_table()


def _prepared(queries: DataFrame, rows: DataFrame, change: Callable[[Column], Column] = lambda v: v) -> tuple[DataFrame, DataFrame]:
    left = queries.select("q_id", change(doubles(F.col("q_vec"))).alias("q_vec"))
    return left, rows.withColumn("vec", change(doubles(F.col("vec"))))


def kernel(queries: DataFrame, rows: DataFrame, kind: str, digits: int | None = None) -> DataFrame:
    """(q_id, id, value) of each query with each row of the same width. queries: q_id, q_vec; rows: id, vec. The value of
    vectors that miss an entry is null. digits: tasks round the value (kinds that need no width only).

    Rows of one vector stand together, so a query's equal values are computed once and follow each other, which files
    store in little space.
    """
    pairwise, finish = KERNELS[kind]
    if digits is not None:
        assert kind not in WIDE
        exact, scale = pairwise, 10.0**digits
        pairwise = lambda q, r: [np.copysign(np.floor(np.abs(v) * scale + 0.5), v) / scale + 0.0 for v in exact(q, r)]
    left, right = _dealt(*_prepared(queries, rows.select("id", "vec"), lp_normalize if kind == "cosine" else lambda v: v), together=True)
    width = [T.StructField("_width", T.IntegerType())] if kind in WIDE else []
    schema = T.StructType([T.StructField("q_id", queries.schema["q_id"].dataType), T.StructField("id", rows.schema["id"].dataType), *width, T.StructField("_v0", T.DoubleType())])

    def pairs(mine: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        others = others.sort_by([("_near", "ascending"), ("id", "ascending")])
        for p, asked, ids, (values,), missing, _ in _steps(mine, others, pairwise):
            n, m = missing.shape
            cells = [asked.take(pa.array(np.repeat(np.arange(n), m))), ids.take(pa.array(np.tile(np.arange(m), n)))]
            cells += [pa.array(np.full(n * m, p, "int32"))] if width else []
            out.append(pa.Table.from_arrays([*cells, pa.array(values.ravel(), mask=missing.ravel() if missing.any() else None)], schema.names))
        return _joined(out, schema)

    out = left.cogroup(right).applyInArrow(pairs, schema)
    return out.select("q_id", "id", finish([F.col("_v0")], F.col("_width") if width else None).alias("value"))


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query by squared distance, itself included: q_id, id, rank, value. Vectors that miss an
    entry are near to none.

    Each group of pairs keeps its own k best for a query before the exchange.
    """
    left, right = _dealt(*_prepared(queries, rows.select("id", "vec")))
    schema = T.StructType([T.StructField("q_id", queries.schema["q_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("value", T.DoubleType())])

    def best(mine: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        for _, asked, ids, (values,), missing, _ in _steps(mine, others, _distances):
            last = min(k, values.shape[1]) - 1
            if last < 0:
                continue
            order = np.empty(len(ids), "int64")
            order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
            bound = np.partition(np.where(missing, np.inf, values), last, axis=1)[:, last]
            query, row = np.nonzero(~(values > bound[:, None]) & ~missing)  # not a number comes last
            sort = np.lexsort((order[row], values[query, row], query))
            query, row = query[sort], row[sort]
            first = np.searchsorted(query, query)  # where the query's rows begin
            keep = np.arange(len(query)) - first < k
            query, row = query[keep], row[keep]
            out.append(pa.Table.from_arrays([asked.take(pa.array(query)), ids.take(pa.array(row)), pa.array(values[query, row])], schema.names))
        return _joined(out, schema)

    found = left.cogroup(right).applyInArrow(best, schema)
    final = Window.partitionBy("q_id").orderBy("value", "id")
    return found.withColumn("rank", F.row_number().over(final) - 1).filter(F.col("rank") < k).select("q_id", "id", "value", "rank")


def weighted_sums(queries: DataFrame, rows: DataFrame, width: int, scale: float) -> DataFrame:
    """(q_id, top, sums) of each query and group of rows: the largest scaled product with a key, and the sums of
    exp(product - top) times the values (width numbers each) and times 1. rows: id, vec, val."""
    left, right = _dealt(*_prepared(queries, rows.select("id", "vec", doubles(F.col("val")).alias("val")).filter("val IS NOT NULL")), 4 * ROWS)
    schema = T.StructType([T.StructField("q_id", queries.schema["q_id"].dataType), T.StructField("top", T.DoubleType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def sums(mine: pa.Table, others: pa.Table) -> pa.Table:
        out, values = [], None
        for _, asked, _, (dots,), missing, place in _steps(mine, others, _dots):
            if values is None:
                flat = pc.fill_null(others.column("val").combine_chunks().flatten(), 0.0).to_numpy(zero_copy_only=False)
                values = np.hstack([flat.reshape(others.num_rows, width), np.ones((others.num_rows, 1))])
            logits = np.where(missing, -np.inf, dots * scale)
            top = logits.max(axis=1)
            some = ~np.isneginf(top)
            with np.errstate(invalid="ignore"):
                total = np.exp(logits[some] - top[some, None]) @ values[place]
            lists = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype="int32") * (width + 1), pa.array(total.ravel()))
            out.append(pa.Table.from_arrays([asked.filter(pa.array(some)), pa.array(top[some]), lists], schema.names))
        return _joined(out, schema)

    return left.cogroup(right).applyInArrow(sums, schema)
