"""Faces of a mesh that run through each other: boxes meet in buckets of space, and triangles are tested exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.mesh import corners
from quern.session import discard, staged

_EPS = 1e-9

#: Mean widths of a face to a bucket, faces of a bucket that one task compares, pairs of boxes compared at once, faces of a partition.
SPAN, MOST, PAIRS, PARTITION = 8, 20_000, 1_000_000, 200_000


def _volume(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Six times the signed volumes of tetrahedra; points are (3, n)."""
    u, v, w = b - a, c - a, d - a
    return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])


def _pierced(p: np.ndarray, q: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether segments p q meet triangles f (3, 3, n), edges and ends included; not where one is parallel to its plane."""
    a, b, c = f
    below, above = _volume(a, b, c, p), _volume(a, b, c, q)
    through = np.abs(below - above)
    met = (through >= _EPS) & (np.minimum(below, above) <= _EPS * through) & (np.maximum(below, above) >= -_EPS * through)
    at = np.flatnonzero(met)
    a, b, c, p, q, through = a[:, at], b[:, at], c[:, at], p[:, at], q[:, at], through[at]
    around = np.stack([_volume(p, q, s, t) for s, t in ((a, b), (b, c), (c, a))])
    met[at] = (around.min(axis=0) >= -_EPS * through) | (around.max(axis=0) <= _EPS * through)
    return met


def _meet(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether triangles f and g, (3 corners, 3, n), meet by a side of one of them."""
    met, left = np.zeros(f.shape[2], bool), np.arange(f.shape[2])
    for one, other in ((f, g), (g, f)):
        for s, t in ((0, 1), (1, 2), (2, 0)):
            hit = _pierced(one[s][:, left], one[t][:, left], other[:, :, left])
            met[left[hit]] = True
            left = left[~hit]
    return met


_POINTS = [f"{c}{k}" for c in "abc" for k in "xyz"]
_GROUP = ["at", "ix", "iy", "iz", "one", "two"]


def _found(block: pa.Table, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the faces that meet among those of whole groups, which follow each other."""
    column = lambda name: block.column(name).to_numpy()
    n = block.num_rows
    new = np.zeros(n, bool)
    for k in _GROUP:
        new[1:] |= column(k)[1:] != column(k)[:-1]
    group = np.cumsum(new)
    points = np.stack([column(c) for c in _POINTS]).reshape(3, 3, n)
    low, high = points.min(axis=0), points.max(axis=0)
    order = np.lexsort((low[0], group))
    group, low, high = group[order], low[:, order], high[:, order]
    # A box may meet those behind it, in the order of lower ends, that begin before it ends.
    ends = np.lexsort((np.repeat([0, 1], n), np.concatenate([low[0], high[0]]), np.tile(group, 2)))
    upto = np.empty(2 * n, "int64")
    upto[ends] = np.cumsum(ends < n)
    times = upto[n:] - np.arange(1, n + 1)
    total = np.concatenate([[0], np.cumsum(times)])
    step = size * 2.0 ** column("at")[order]
    cell = np.stack([column(f"i{k}")[order] for k in "xyz"])
    home, slice_, split = column("home")[order], column("slice")[order], (column("one") != column("two"))[order]
    corner = [column(c)[order] for c in "abc"]
    out, begin = [], 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(begin, end), times[begin:end])
        j = np.arange(len(i)) + total[begin] - total[i] + i + 1
        for k in (1, 2):
            near = (low[k][i] <= high[k][j]) & (low[k][j] <= high[k][i])
            i, j = i[near], j[near]
        near = (home[i] | home[j]) & (~split[i] | (slice_[i] != slice_[j]))
        for k in range(3):
            near &= np.floor(np.maximum(low[k][i], low[k][j]) / step[i]) == cell[k][i]
        for one in corner:
            for other in corner:
                near &= one[i] != other[j]
        i, j = order[i[near]], order[j[near]]
        met = _meet(points[:, :, i], points[:, :, j])
        out.append((i[met], j[met]))
        begin = end
    return tuple(np.concatenate(side) for side in zip(*out))


def self_intersections(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(fid, other), fid < other: faces without a common vertex that meet. Faces in one plane don't count as meeting.

    A face lies in buckets at least as wide as it is (8 at most, mostly one): widths are SPAN mean ones times powers of
    two. It also visits the buckets of greater widths, so that large faces don't fill small buckets, and a pair is tested
    in one bucket only, the one that holds the greater of both boxes' least corners. Tasks sort a bucket's boxes by their
    lower ends; buckets of more than MOST faces are cut in slices, each pair of which is a group. Faces whose corners are
    unknown or not finite meet nothing; fids are distinct.
    """
    flat = [F.col(f"p{c}.{k}").alias(f"{c}{k}") for c in "abc" for k in "xyz"]
    ends = {f"{end}{k}": f(*(f"{c}{k}" for c in "abc")) for end, f in (("lo", F.least), ("hi", F.greatest)) for k in "xyz"}
    finite = F.lit(True)
    for c in _POINTS:
        finite = finite & (F.abs(c) < float("inf"))
    width = F.greatest(*(ends[f"hi{k}"] - ends[f"lo{k}"] for k in "xyz"))
    boxes = staged(corners(vertices, faces).select("fid", "a", "b", "c", *flat).filter(finite).withColumn("width", width))
    mean, number = boxes.agg(F.avg("width"), F.count("*")).first()
    size = (mean or 1.0) * SPAN
    level = F.when(F.col("width") > size, F.ceil(F.log2(F.col("width") / size))).otherwise(0).cast("int")
    levels = sorted(r["level"] for r in boxes.select(level.alias("level")).distinct().collect())  # a few: they grow with the logarithm of widths
    wider = F.filter(F.array(*(F.lit(n) for n in levels)), lambda n: n >= level) if levels else F.array().cast("array<int>")
    placed = boxes.withColumn("home", level).withColumn("at", F.explode(wider)).withColumn("home", F.col("home") == F.col("at"))
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("at"))
    for k in "xyz":
        first, last = (F.floor(ends[f"{end}{k}"] / step).cast("long") for end in ("lo", "hi"))
        placed = placed.withColumn(f"i{k}", F.explode(F.sequence(first, last)))
    cell = ["at", "ix", "iy", "iz"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > MOST)
    heavy = staged(counts.select(*cell, F.ceil(F.col("n") / MOST).cast("int").alias("slices")), release=False)
    if heavy.isEmpty():
        placed = placed.select("*", *(F.lit(0).alias(c) for c in ("slice", "one", "two")))
    else:  # at most one for MOST faces
        placed = placed.join(F.broadcast(heavy), cell, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        placed = placed.withColumn("slice", F.pmod(F.xxhash64("fid"), F.col("slices")).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        placed = placed.withColumn("one", F.least("slice", "met")).withColumn("two", F.greatest("slice", "met"))
    kind = boxes.schema["fid"].dataType
    schema = T.StructType([T.StructField("fid", kind), T.StructField("other", kind)])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(block: pa.Table) -> pa.RecordBatch:
            i, j = _found(block, size)
            fid = block.column("fid").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(f(fid[i], fid[j])) for f in (np.minimum, np.maximum)], ["fid", "other"])

        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows < 2 * MOST:
                continue
            block = pa.Table.from_batches(held)
            other = np.zeros(rows, bool)
            for k in _GROUP:
                values = block.column(k).to_numpy()
                other[1:] |= values[1:] != values[:-1]
            cut = int(np.flatnonzero(other)[-1]) if other.any() else 0  # the last group may go on
            if cut:
                yield pairs(block.slice(0, cut))
                held, rows = block.slice(cut).to_batches(), rows - cut
        if rows:
            yield pairs(pa.Table.from_batches(held))

    sent = placed.select(*_GROUP, "slice", "home", "fid", "a", "b", "c", *_POINTS)
    partitions = max(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), number // PARTITION)
    met = staged(sent.repartition(partitions, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(meeting, schema))
    discard(boxes, heavy)
    return met
