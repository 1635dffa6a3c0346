"""Linear recurrences h_t = a_t h_(t-1) + b_t over series of any length, as a scan of affine maps over sorted ranges.

Rows are dealt by range of (series, time) and sorted, so a long series runs over many tasks, and are written as blocks of
at most BLOCK rows. Going through its range from a zero state, a task notes for each block the state it begins with and
the product of the maps before it, as far as they belong to the series that the range began with. One row a range holds
what the range does to a state: those rows are chained in one task (as many rows as ranges, no data), and the states that
ranges hand on go back to their blocks by a join. Then every block runs on its own, from its right state, in any task.
Within a block the recurrence is a scan by doubling over all rows at once; the first row of a series takes nothing over.

Defined results: a null input counts as 0. Rows of one series with equal time come in any order among themselves. Null is
a series like another. Without rows there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import staged

BLOCK = 4096


def _same_series(begins: np.ndarray) -> np.ndarray:
    """Where the series of each row begins."""
    return np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))


class Constant:
    """State space with fixed matrices: s' = A s + B x, y = C s + D x, of one input."""

    inputs = outputs = 1

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        self.a, self.b, self.c, self.d, self.size = a, b, c, d, len(a)

    def states(self, x: np.ndarray, begins: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The state after each row; begins: rows that start a series, start: the state before the first row if it does not."""
        h = x[:, :1] * self.b
        if not begins[0]:
            h[0] += self.a @ start
        since, step, power = np.arange(len(x)) - _same_series(begins), 1, self.a
        while step < len(x):
            on = np.flatnonzero(since >= step)
            if not len(on):
                break
            h[on] = h[on] + h[on - step] @ power.T
            step, power = step * 2, power @ power
        return h

    def run(self, x: np.ndarray, begins: np.ndarray, start: np.ndarray) -> np.ndarray:
        before = np.vstack([start, self.states(x, begins, start)[:-1]])
        before[begins] = 0.0
        return (before @ self.c + self.d * x[:, 0])[:, None]

    def product(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(self.a, len(x))

    def joined(self, first: np.ndarray | None, then: np.ndarray) -> np.ndarray:
        return then if first is None else then @ first

    def applied(self, product: np.ndarray, state: np.ndarray) -> np.ndarray:
        return product.reshape(self.size, self.size) @ state


class Selective:
    """h = exp(delta A) h + delta B x, y = C h + D x for d channels of n states; inputs of a row: x (d), delta (d), B (n), C (n)."""

    def __init__(self, a: np.ndarray, skip: np.ndarray | None = None):
        self.a, (self.d, self.n), self.skip = a, a.shape, skip
        self.inputs, self.outputs, self.size = 2 * self.d + 2 * self.n, self.d, a.size

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        d, n = self.d, self.n
        return x[:, :d], x[:, d : 2 * d], x[:, 2 * d : 2 * d + n], x[:, 2 * d + n :]

    def states(self, x: np.ndarray, begins: np.ndarray, start: np.ndarray) -> np.ndarray:
        u, delta, b, _ = self._split(x)
        a = np.exp(delta[:, :, None] * self.a).reshape(len(x), -1)
        h = (delta[:, :, None] * b[:, None, :] * u[:, :, None]).reshape(len(x), -1)
        a[begins] = 0.0
        h[0] += a[0] * start
        step = 1
        while step < len(x):
            h[step:] = h[step:] + a[step:] * h[:-step]
            a[step:] = a[step:] * a[:-step]
            step *= 2
        return h

    def run(self, x: np.ndarray, begins: np.ndarray, start: np.ndarray) -> np.ndarray:
        u, _, _, c = self._split(x)
        y = (self.states(x, begins, start).reshape(len(x), self.d, self.n) * c[:, None, :]).sum(axis=2)
        return y if self.skip is None else y + self.skip * u

    def product(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self._split(x)[1].sum(axis=0)[:, None] * self.a).ravel()

    def joined(self, first: np.ndarray | None, then: np.ndarray) -> np.ndarray:
        return then if first is None else then * first

    def applied(self, product: np.ndarray, state: np.ndarray) -> np.ndarray:
        return product * state


Recurrence = Constant | Selective


def _blocks(kind: Recurrence):
    """Each range as blocks: start is the state before the block, reach the product of the maps before it if its first row
    belongs to the series that the range began with. The range's last block says what the whole range does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        state, reach, first, last = np.zeros(kind.size), None, None, None
        whole = True  # still in the series that the range began with
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                names = piece.column("series").to_pylist()
                x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, kind.inputs)
                begins = np.array([last is None or names[0] != last[0], *(p != q for p, q in zip(names, names[1:]))])
                if first is None:
                    first, begins[0] = (names[0],), False  # a state may be handed on to it
                elif begins[0]:
                    state, whole = np.zeros(kind.size), False
                if held is not None:
                    yield held(None)
                own = (part, number, begins.tolist(), state.tolist(), None if not whole else [] if reach is None else reach.ravel().tolist(), piece)
                held = lambda end, own=own: _row(*own, end)
                stays = np.flatnonzero(begins)
                head = x[: stays[0]] if len(stays) else x
                if whole:
                    reach = kind.joined(reach, kind.product(head))
                whole = whole and not len(stays)
                state = kind.states(x, begins, state)[-1]
                last, number = (names[-1],), number + 1
        if held is not None:
            yield held({"first": str(first[0]) if first[0] is not None else None, "last": str(last[0]) if last[0] is not None else None, "state": state.tolist(), "reach": reach.ravel().tolist() if whole else None})

    return run


_END = pa.struct([("first", pa.string()), ("last", pa.string()), ("state", pa.list_(pa.float64())), ("reach", pa.list_(pa.float64()))])
_META = "part int, block int, begins array<boolean>, start array<double>, reach array<double>, end struct<first: string, last: string, state: array<double>, reach: array<double>>"


def _row(part: int, block: int, begins: list, start: list, reach: list | None, piece: pa.RecordBatch, end: dict | None) -> pa.RecordBatch:
    doubles, whole = pa.list_(pa.float64()), lambda name: pa.ListArray.from_arrays(pa.array([0, len(piece.column(name))], pa.int32()), piece.column(name))
    x = piece.column("x").flatten()
    columns = [
        pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([begins], pa.list_(pa.bool_())), pa.array([start], doubles), pa.array([reach], doubles), pa.array([end], _END),
        whole("series"), whole("t"), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "begins", "start", "reach", "end", "series", "t", "x"])


def _chained(kind: Recurrence):
    """The state that each range is handed, from the ranges' ends in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, name = np.zeros(kind.size), None
        for batch in batches:
            parts, handed = [], []
            for r in batch.to_pylist():
                end = r["end"]
                taken = state if name is not None and name[0] == end["first"] else np.zeros(kind.size)
                parts.append(r["part"])
                handed.append(taken.tolist())
                state = np.array(end["state"])
                if end["reach"] is not None:
                    state = state + kind.applied(np.array(end["reach"]), taken)
                name = (end["last"],)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(handed, pa.list_(pa.float64()))], names=["part", "handed"])

    return run


def _finished(kind: Recurrence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = lambda name: batch.column(name)[k]
                start, reach, handed = np.array(cell("start").as_py()), cell("reach").as_py(), np.array(cell("handed").as_py())
                if reach is not None:
                    start = start + (kind.applied(np.array(reach), handed) if reach else handed)
                x = cell("x").values.to_numpy(zero_copy_only=False).reshape(-1, kind.inputs)
                y = kind.run(x, np.array(cell("begins").as_py()), start)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), kind.outputs).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([cell("series").values, cell("t").values, lists], names=["series", "t", "y"])

    return run


def scan(rows: DataFrame, series: str, t: str, inputs: list[Column], kind: Recurrence) -> DataFrame:
    """series, t, y (array): the recurrence over each series in the order of t, from rest."""
    x = F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in inputs))
    ready = rows.select(F.col(series).alias("series"), F.col(t).alias("t"), x.alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
    number = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ready.repartitionByRange(number, "series", "t").sortWithinPartitions("series", "t")
    blocks = staged(ordered.mapInArrow(_blocks(kind), f"{_META}, series array<{kinds['series']}>, t array<{kinds['t']}>, x array<double>"))
    ends = blocks.filter("end IS NOT NULL").select("part", "end").repartition(1).sortWithinPartitions("part")  # a row a range
    handed = ends.mapInArrow(_chained(kind), "part int, handed array<double>")
    met = blocks.drop("end").join(F.broadcast(handed), "part")
    return met.mapInArrow(_finished(kind), f"series {kinds['series']}, t {kinds['t']}, y array<double>")


def selective_scan(rows: DataFrame, series: str, t: str, x: list[Column], delta: list[Column], a: np.ndarray, b: list[Column], c: list[Column], skip: np.ndarray | None = None) -> DataFrame:
    """series, t, y: the selective state-space recurrence; a is d x n (fixed), x and delta have d columns, b and c have n."""
    return scan(rows, series, t, [*x, *delta, *b, *c], Selective(np.asarray(a, float), skip))
