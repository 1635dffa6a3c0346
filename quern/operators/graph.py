"""Graph operators on edge tables (src, dst, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import staged


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("value").alias("d"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("d"))


def symmetric_degree(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("id"), "value").union(edges.select("dst", "value"))
    return both.groupBy("id").agg((F.sum("value") / 2).alias("d"))


def _with_degrees(edges: DataFrame, eps: float) -> DataFrame:
    d = degree(edges).withColumn("d", F.greatest("d", F.lit(eps)))
    left, right = d.withColumnsRenamed({"id": "src", "d": "_ds"}), d.withColumnsRenamed({"id": "dst", "d": "_dd"})
    return edges.join(left, "src", "left").join(right, "dst", "left")


def laplacian(edges: DataFrame, kind: str = "combinatorial", eps: float = 1e-12) -> DataFrame:
    """Cells of D - A, I - D^-1/2 A D^-1/2 ("symmetric") or I - D^-1 A ("random_walk"); degrees are floored at eps in the last two."""
    if kind == "combinatorial":
        off = edges.select("src", "dst", (-F.col("value")).alias("value"))
        diagonal = degree(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("d").alias("value"))
    else:
        scaled = _with_degrees(edges, eps)
        by = F.sqrt(F.col("_ds") * F.coalesce("_dd", F.lit(eps))) if kind == "symmetric" else F.col("_ds")
        off = scaled.select("src", "dst", (-F.col("value") / by).alias("value"))
        diagonal = degree(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("value"))
    return off.union(diagonal).groupBy("src", "dst").agg(F.sum("value").alias("value"))


def laplacian_matvec(edges: DataFrame, x: DataFrame, kind: str = "combinatorial", eps: float = 1e-12) -> DataFrame:
    """L x without forming L; x: id, v."""
    right = x.select(F.col("id").alias("dst"), F.col("v").alias("_x"))
    if kind == "combinatorial":
        terms, own = edges.join(right, "dst").select(F.col("src").alias("id"), (F.col("value") * F.col("_x")).alias("_t")), degree(edges)
    else:
        scaled = _with_degrees(edges, eps).join(right, "dst")
        by = F.sqrt(F.col("_ds") * F.coalesce("_dd", F.lit(eps))) if kind == "symmetric" else F.col("_ds")
        terms, own = scaled.select(F.col("src").alias("id"), (F.col("value") / by * F.col("_x")).alias("_t")), degree(edges).withColumn("d", F.lit(1.0))
    sums = terms.groupBy("id").agg(F.sum("_t").alias("_ax"))
    return x.join(own, "id", "left").join(sums, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * F.col("v") - F.coalesce("_ax", F.lit(0.0))).alias("value"))


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0, sign: str = "+") -> DataFrame:
    """One row: modularity of hard communities (id, c), from sums over edges and over communities only."""
    w = F.greatest(F.col("value"), F.lit(0.0)) if sign == "+" else F.greatest(-F.col("value"), F.lit(0.0))
    signed = edges.select("src", "dst", w.alias("value")).filter("value > 0")
    ends = signed.join(communities.select(F.col("id").alias("src"), F.col("c").alias("_cs")), "src").join(communities.select(F.col("id").alias("dst"), F.col("c").alias("_cd")), "dst")
    inside = ends.agg(F.sum(F.when(F.col("_cs") == F.col("_cd"), F.col("value")).otherwise(0.0)).alias("inside"), F.sum("value").alias("total"))
    out = ends.groupBy(F.col("_cs").alias("c")).agg(F.sum("value").alias("k_out"))
    into = ends.groupBy(F.col("_cd").alias("c")).agg(F.sum("value").alias("k_in"))
    null = out.join(into, "c").agg(F.sum(F.col("k_out") * F.col("k_in")).alias("null"))
    a, b = inside.first(), null.first()
    q = (a["inside"] - gamma * b["null"] / a["total"]) / a["total"] if a["total"] else 0.0
    return edges.sparkSession.createDataFrame([(float(q),)], "q double")


def modularity_matrix(edges: DataFrame, gamma: float = 1.0, normalise: bool = True) -> DataFrame:
    """Entries of A+ - gamma k_out k_in / m at the edges of A; elsewhere only the null term stands."""
    signed = edges.withColumn("value", F.greatest("value", F.lit(0.0)))
    out, into = degree(signed).withColumnsRenamed({"id": "src", "d": "_o"}), in_degree(signed).withColumnsRenamed({"id": "dst", "d": "_i"})
    total = signed.agg(F.sum("value")).first()[0]
    value = F.col("value") - gamma * F.col("_o") * F.col("_i") / total
    return signed.join(out, "src").join(into, "dst").select("src", "dst", (value / total if normalise else value).alias("value"))


def modularity_matrix_full(edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """All cells of (A+ - gamma k_out k_in / m) / m between vertices with edges out and such with edges in: as dense as
    the matrix is, so for small graphs; products of a large one need only the edges and the two degree vectors."""
    signed = edges.withColumn("value", F.greatest("value", F.lit(0.0)))
    out, into = degree(signed).withColumnsRenamed({"id": "src", "d": "_o"}), in_degree(signed).withColumnsRenamed({"id": "dst", "d": "_i"})
    total = signed.agg(F.sum("value")).first()[0]
    columns = into.agg(F.collect_list(F.struct("dst", "_i")).alias("_c"))  # one side of the dense matrix
    cells = out.join(F.broadcast(columns)).select("src", "_o", F.explode("_c").alias("_c")).select("src", "_o", "_c.*")
    joined = cells.join(signed.select("src", "dst", "value"), ["src", "dst"], "left")
    return joined.select("src", "dst", ((F.coalesce("value", F.lit(0.0)) - gamma * F.col("_o") * F.col("_i") / total) / total).alias("value"))


def coaffiliation(members: DataFrame, normalise: bool = False) -> DataFrame:
    """Sum over communities of c(i) c(j) for i <> j; members: id, c, w. Pairs exist only where a community is shared."""
    left, right = members.select("c", F.col("id").alias("i"), F.col("w").alias("_a")), members.select("c", F.col("id").alias("j"), F.col("w").alias("_b"))
    pairs = left.join(right, "c").filter("i <> j").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))
    if not normalise:
        return pairs
    total = pairs.agg(F.sum("value")).first()[0]
    return pairs.withColumn("value", F.col("value") / F.lit(total))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, label): the smallest id reachable, by neighbour minima and pointer jumping; each round ends in a written table."""
    both = staged(edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).union(edges.select("dst", "src")).distinct())
    labels = both.groupBy("v").agg(F.least(F.min("w"), F.min("v")).alias("label"))
    if nodes is not None:
        labels = labels.union(nodes.select(F.col("id").alias("v"), F.col("id")).join(labels, "v", "left_anti"))
    labels = staged(labels)
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "w"}), "w").groupBy("v").agg(F.min("label").alias("_near"))
        low = labels.join(near, "v", "left").select("v", "label", F.least("label", F.coalesce("_near", "label")).alias("_low"))
        of = labels.select(F.col("v").alias("_v"), F.col("label").alias("_of"))
        new = F.least("_low", F.coalesce("_of", "_low"))
        moved = staged(low.join(of, F.col("_low") == F.col("_v"), "left").select("v", new.alias("label"), (new != F.col("label")).alias("_moved")))
        labels = moved.select("v", "label")
        if moved.filter("_moved").isEmpty():
            return labels.withColumnRenamed("v", "id")


def chebyshev_filter(edges: DataFrame, x: DataFrame, coefficients: list[float], lmax: float, kind: str = "symmetric") -> DataFrame:
    """Chebyshev series of the scaled Laplacian applied to a graph signal (id, v): one matvec a term, each written out."""
    def scaled(signal: DataFrame) -> DataFrame:
        applied = laplacian_matvec(edges, signal, kind)
        return applied.join(signal, "id").select("id", (2 / lmax * F.col("value") - F.col("v")).alias("v"))

    before, now = x.select("id", "v"), staged(scaled(x))
    total = before.join(now.withColumnRenamed("v", "_n"), "id").select("id", (coefficients[0] * F.col("v") + (coefficients[1] if len(coefficients) > 1 else 0.0) * F.col("_n")).alias("total"))
    for c in coefficients[2:]:
        after = staged(scaled(now).join(before.withColumnRenamed("v", "_b"), "id").select("id", (2 * F.col("v") - F.col("_b")).alias("v")))
        total = staged(total.join(after, "id").select("id", (F.col("total") + c * F.col("v")).alias("total")))
        before, now = now, after
    return total.select("id", F.col("total").alias("value"))


def top_eigenvector(edges: DataFrame, x: DataFrame, rounds: int = 50, tol: float = 1e-12) -> tuple[DataFrame, float]:
    """Power iteration of A on (id, v) until the Rayleigh quotient stands: the vector of unit length and its quotient."""
    from quern.operators.semiring import edge_rmatvec

    value = 0.0
    for _ in range(rounds):
        image = staged(edge_rmatvec(edges, x).select(F.col("dst").alias("id"), F.col("value").alias("v")))
        sums = image.join(x.withColumnRenamed("v", "_x"), "id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.sum(F.col("v") * F.col("_x"))).first()
        before, value, norm = value, sums[1], sums[0]
        x = image.select("id", (F.col("v") / norm).alias("v"))
        if abs(value - before) <= tol * abs(value):
            break
    return x, value


def boundary_map(profiles: DataFrame, edges: DataFrame, similarity: Column) -> DataFrame:
    """Mean over neighbours of 1 - similarity of profiles (id, v); the similarity is a column of _a and _b."""
    ends = edges.join(profiles.select(F.col("id").alias("src"), F.col("v").alias("_a")), "src").join(profiles.select(F.col("id").alias("dst"), F.col("v").alias("_b")), "dst")
    return ends.groupBy(F.col("src").alias("id")).agg(F.avg(1 - similarity).alias("value"))
