"""Exact quantiles by group without gathering a group: counts by range of the value, then order within the ranges that hold the quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import staged

RANGES = 1024

#: A range of more rows is cut in ranges again before its values are ordered; groups that scans take.
MOST_ORDERED, MOST_SCANNED = 1_000_000, 64
#: Distinct values near guesses that a scan may hand to the driver.
MOST_NEAR = 400_000


def _on(keys: Sequence[str], prefix: str):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def group_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], name: str = "q") -> DataFrame:
    """keys and name: an array with the quantile of each probability, interpolated linearly between order statistics.

    Equal values combine before any exchange, and their counts are written, as three steps read them. A group's values are counted in RANGES equal ranges; only the ranges that
    hold a wanted order statistic are ordered. Nulls don't count, and a group of nulls only has no row.
    """
    own = [F.col(k).alias(f"_k{k}") for k in keys]
    kept = [f"_k{k}" for k in keys]
    counts = staged(rows.filter(F.col(value).isNotNull()).groupBy(*own, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), release=False)
    ends = counts.groupBy(*kept).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.sum("_n").alias("_all"))
    ends = ends.withColumnsRenamed({k: f"_e{k}" for k in kept})
    width = F.col("_b") - F.col("_a")
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_a")) / width * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0))
    placed = counts.join(ends, _on(kept, "_e")).select(*kept, "_v", "_n", "_all", bin_.alias("_bin"))
    sizes = placed.groupBy(*kept, "_bin").agg(F.sum("_n").alias("_size"), F.first("_all").alias("_all"))
    before = Window.partitionBy(*kept).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a group
    based = sizes.withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    at = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil(at(p)) if up else F.floor(at(p))).cast("long").alias("rank")) for i, p in enumerate(probabilities) for up in (0, 1)))
    wanted = based.withColumn("_w", F.explode(places)).filter((F.col("_w.rank") >= F.col("_base")) & (F.col("_w.rank") < F.col("_base") + F.col("_size")))
    wanted = wanted.groupBy(*kept, "_bin", "_base", "_all").agg(F.collect_list("_w").alias("_w"))  # two a probability
    wanted = wanted.withColumnsRenamed({k: f"_w{k}" for k in kept}).withColumnRenamed("_bin", "_wbin").drop("_all")
    inside = placed.join(wanted, _on(kept, "_w") & (F.col("_bin") == F.col("_wbin")))
    upto = Window.partitionBy(*kept, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_base") + F.sum("_n").over(upto))
    met = F.filter("_w", lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col("_n")))
    found = inside.select(*kept, "_all", "_v", F.explode(met).alias("_w"))
    share = lambda p: at(p) - F.floor(at(p))
    value_at = lambda i, up: F.max(F.when((F.col("_w.i") == i) & (F.col("_w.up") == up), F.col("_v")))
    sums = found.groupBy(*kept, "_all").agg(*(value_at(i, up).alias(f"_q{i}_{up}") for i in range(len(probabilities)) for up in (0, 1)))
    out = [F.col(f"_q{i}_0") + (F.col(f"_q{i}_1") - F.col(f"_q{i}_0")) * share(p) for i, p in enumerate(probabilities)]
    return sums.select(*(F.col(f"_k{k}").alias(k) for k in keys), F.array(*out).alias(name))


def scanned_quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], name: str = "q") -> DataFrame:
    """group_quantiles of few groups, whose number the caller knows, of rows that are cheap to read again.

    Rows are not exchanged: each pass counts a group's values in RANGES ranges before any exchange, or orders those of the
    ranges that hold a wanted order statistic. Such a range of more than MOST_ORDERED rows is cut in ranges again, until
    its values are equal or few. Bounds of a range a group and order statistic go from pass to pass.
    """
    spark = rows.sparkSession
    kept = [f"_k{k}" for k in keys]
    values = rows.filter(F.col(value).isNotNull()).select(*(F.col(k).alias(f"_k{k}") for k in keys), F.col(value).cast("double").alias("_v"))
    ends = values.groupBy(*kept).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("_v").alias("_all")).collect()
    kinds = "".join(f"`{k}` {values.schema[k].dataType.simpleString()}, " for k in kept)
    schema = T.StructType.fromDDL(f"{kinds}_i int, _up int, _rank long, _a double, _b double, _size long")
    groups = [tuple(r[k] for k in kept) for r in ends]
    at = lambda r, p: (r["_all"] - 1) * p
    # Of each group and order statistic: its rank within a range, the range's least and greatest value, and its rows.
    open_ = {(g, i, up): ((math.ceil if up else math.floor)(at(r, p)), r["_a"], r["_b"], r["_all"]) for g, r in zip(groups, ends) if r["_all"] for i, p in enumerate(probabilities) for up in (0, 1)}
    found = {}
    while True:
        found.update({k: a for k, (_, a, b, _) in open_.items() if a == b or math.isnan(a)})
        open_ = {k: r for k, r in open_.items() if k not in found}
        spans = {(k[0], a, b): size for k, (_, a, b, size) in open_.items()}
        wide = {span for span, size in spans.items() if size > MOST_ORDERED and math.isfinite(span[2] - span[1])}
        if not wide:
            break
        table = spark.createDataFrame([(*g, a, b) for g, a, b in wide], T.StructType.fromDDL(f"{kinds}_a double, _b double"))
        table = table.withColumnsRenamed({k: f"_e{k}" for k in kept})
        inside = values.join(F.broadcast(table), _on(kept, "_e") & (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
        bin_ = F.least(F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * RANGES), F.lit(RANGES - 1))
        counted = inside.groupBy(*kept, "_a", "_b", bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        bins: dict = {}
        for r in sorted(counted.collect(), key=lambda r: r["_bin"]):
            bins.setdefault((tuple(r[k] for k in kept), r["_a"], r["_b"]), []).append(r)
        for key, (rank, a, b, _) in open_.items():
            if (key[0], a, b) not in wide:
                continue
            for r in bins[key[0], a, b]:
                if rank < r["_n"]:
                    open_[key] = (rank, r["_low"], r["_high"], r["_n"])
                    break
                rank -= r["_n"]
    if open_:
        table = spark.createDataFrame([(*g, i, up, *r) for (g, i, up), r in open_.items()], schema).withColumnsRenamed({k: f"_e{k}" for k in kept})
        inside = values.join(F.broadcast(table.select(*(f"_e{k}" for k in kept), "_a", "_b").distinct()), _on(kept, "_e") & (F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
        counts = inside.groupBy(*kept, "_a", "_b", "_v").agg(F.count("*").alias("_n"))
        upto = Window.partitionBy(*kept, "_a", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        ended = counts.withColumn("_end", F.sum("_n").over(upto)).withColumnsRenamed({"_a": "_c", "_b": "_d"})
        mine = _on(kept, "_e") & (F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d")) & (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n"))
        for r in ended.join(F.broadcast(table), mine).select(*kept, "_i", "_up", "_v").collect():
            found[tuple(r[k] for k in kept), r["_i"], r["_up"]] = r["_v"]
    out = []
    for g, r in zip(groups, ends):
        if r["_all"]:
            out.append((*g, [found[g, i, 0] + (found[g, i, 1] - found[g, i, 0]) * (at(r, p) - math.floor(at(r, p))) for i, p in enumerate(probabilities)]))
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return spark.createDataFrame(out, T.StructType.fromDDL(f"{kinds}`{name}` array<double>"))


def _statistics(values: np.ndarray, numbers: np.ndarray, below: int, total: int) -> tuple[float, float] | None:
    """The two middle order statistics of total values, of which below are less than these; None where others hold them."""
    order = np.argsort(values, kind="stable")
    upto = below + np.cumsum(numbers[order])
    ranks = (total - 1) // 2, total // 2
    if not len(upto) or ranks[0] < below or ranks[1] >= upto[-1]:
        return None
    low, high = (float(values[order[np.searchsorted(upto, r, side="right")]]) for r in ranks)
    return low, high


def spread_near(rows: DataFrame, keys: Sequence[str], value: str, guesses: dict[tuple, tuple[float, float, float]]) -> dict[tuple, tuple[float, float, int]] | None:
    """Median, median absolute deviation and values near the guesses, by group, from one scan of rows that are cheap to read.

    guesses: median, deviation and reach of each group, few in all. Values within reach of the median or of the median
    less or plus the deviation are handed over, others are counted between these, so what is found is exact. Empty where
    a guess was too far off, None where more than MOST_NEAR values are near.
    """
    ends = [(*k, g, m - d - w, m - d + w, m - w, m + w, m + d - w, m + d + w) for g, (k, (m, d, w)) in enumerate(guesses.items())]
    if not all(e[-6] < e[-5] < e[-4] < e[-3] < e[-2] < e[-1] and math.isfinite(e[-1] - e[-6]) for e in ends):
        return {}
    kinds = "".join(f"`_e{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    table = rows.sparkSession.createDataFrame(ends, T.StructType.fromDDL(kinds + "_g int, " + ", ".join(f"_t{i} double" for i in range(6))))
    v = F.col(value).cast("double")
    part = F.when(v < F.col("_t0"), 0)
    for i in range(1, 6):
        part = part.when(v <= F.col(f"_t{i}") if i % 2 else v < F.col(f"_t{i}"), i)
    placed = rows.filter(v.isNotNull()).join(F.broadcast(table), _on(keys, "_e")).select("_g", part.otherwise(6).alias("_c"), v.alias("_v"))
    counts = placed.groupBy("_g", "_c", F.when(F.col("_c") % 2 == 1, F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    held = counts.limit(MOST_NEAR + 1).toArrow()
    if held.num_rows > MOST_NEAR:
        return None
    group, part_, values, numbers = (held.column(c).to_numpy() for c in ("_g", "_c", "_v", "_n"))
    out = {}
    for g, key in enumerate(guesses):
        own = group == g
        by = np.bincount(part_[own], numbers[own], minlength=7).astype(int)
        total, at, outer = int(by.sum()), own & (part_ == 3), own & ((part_ == 1) | (part_ == 5))
        middle = _statistics(values[at], numbers[at], int(by[:3].sum()), total)
        if middle is None:
            return {}
        m = middle[0] + (middle[1] - middle[0]) * ((total - 1) % 2 / 2)
        t = ends[g][-6:]
        # all values within the first distance are counted, and all up to the second are at hand
        inner, known = max(m - t[1], t[4] - m), min(m - t[0], t[5] - m)
        off, n = np.abs(values[outer] - m), numbers[outer]
        far = off >= inner
        spread = _statistics(off[far], n[far], int(by[2:5].sum() + n[~far].sum()), total)
        if spread is None or spread[1] > known:
            return {}
        out[key] = m, spread[0] + (spread[1] - spread[0]) * ((total - 1) % 2 / 2), int(by[1] + by[3] + by[5])
    return out


def with_group_quantiles(rows: DataFrame, keys: Sequence[str], value: str, **probabilities: float) -> DataFrame:
    """rows with one column for each named quantile of its group."""
    table = group_quantiles(rows, keys, value, list(probabilities.values()), "_q")
    if not keys:
        first = table.first()
        return rows.select("*", *(F.lit(first["_q"][i] if first else None).cast("double").alias(n) for i, n in enumerate(probabilities)))
    table = table.withColumnsRenamed({k: f"_r{k}" for k in keys})
    joined = rows.join(table, _on(keys, "_r"), "left")
    return joined.select(*rows.columns, *(F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(probabilities)))
