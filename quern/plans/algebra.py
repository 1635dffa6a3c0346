"""Semiring and graph queries over the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph, semiring, spectra
from quern.sources.tables import read


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by line number: mean quantity."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("k"))
    return rows.agg(F.avg("l_quantity").alias("v"))


def _b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number by return flag: mean discount times 100."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("j"))
    return rows.agg((F.avg("l_discount") * 100).alias("v"))


def _matmul(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = semiring.matmul(_a(spark, sf_dir), _b(spark, sf_dir), semiring.ALGEBRAS[name])
        value = F.col("value").cast("int") if name == "boolean" else F.round("value", 6)
        return out.select("i", "j", value.alias("value"))

    return query


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier: revenue in thousands of their lines."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg((F.sum("l_extendedprice") / 1000).alias("value"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("v"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("v"))


def ell_matmul(spark, sf_dir):
    b = _suppliers(spark, sf_dir).select(F.col("id").alias("k"), F.lit(0).alias("j"), "v")
    out = semiring.edge_matmul(_edges(spark, sf_dir), b, semiring.MIN_PLUS)
    return out.select("i", F.round("value", 6).alias("value"))


def ell_rmatvec(spark, sf_dir):
    out = semiring.edge_rmatvec(_edges(spark, sf_dir), _customers(spark, sf_dir))
    return out.select("dst", F.round("value", 4).alias("value"))


def edge_aggregate(spark, sf_dir):
    """Largest weighted difference of balances over a customer's suppliers."""
    left = _customers(spark, sf_dir).select("id", "v")
    right = _suppliers(spark, sf_dir).select((-1 - F.col("id")).alias("id"), "v")
    edges = _edges(spark, sf_dir).withColumn("dst", -1 - F.col("dst"))
    out = semiring.edge_aggregate(edges, left.unionByName(right), lambda s, d, w: w * F.abs(s - d), semiring.MAX_PLUS)
    return out.select("src", F.round("value", 6).alias("value"))


def row_softmax(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("value", F.col("value") / 100)
    return semiring.row_softmax(edges).select("src", "dst", F.round("value", 8).alias("value"))


def sparse_top_k(spark, sf_dir):
    return semiring.edges_from_dense(_edges(spark, sf_dir), 20.0, 5).select("src", "dst", F.round("value", 6).alias("value"))


def sparse_symmetric(spark, sf_dir):
    return semiring.edges_from_dense(_trade(spark, sf_dir), 0.0, None, True).select("src", "dst", F.round("value", 6).alias("value"))


def masked_edges(spark, sf_dir):
    valid = _suppliers(spark, sf_dir).filter("v > 5")
    return semiring.masked_edges(_edges(spark, sf_dir), valid).groupBy("src").agg(F.round(F.sum("value"), 6).alias("value"))


def self_loops(spark, sf_dir):
    return semiring.add_self_loops(_trade(spark, sf_dir), "mean").select("src", "dst", F.round("value", 6).alias("value"))


def dense_cells(spark, sf_dir):
    return semiring.to_dense(_trade(spark, sf_dir), 25, 25).select("src", "dst", F.round("value", 6).alias("value"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation of the customer to nation of the supplier: revenue in thousands."""
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    edges = _edges(spark, sf_dir)
    joined = edges.join(c, F.col("src") == F.col("c_custkey")).join(s, F.col("dst") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("value").alias("value"))


def _degrees(op):
    return lambda spark, sf_dir: op(_trade(spark, sf_dir)).select("id", F.round("d", 6).alias("d"))


def _laplacian(kind: str):
    return lambda spark, sf_dir: graph.laplacian(_trade(spark, sf_dir), kind).select("src", "dst", F.round("value", 6).alias("value"))


def _matvec(kind: str):
    def query(spark, sf_dir):
        x = spark.range(25).select("id", (F.col("id") / 10).alias("v"))
        return graph.laplacian_matvec(_trade(spark, sf_dir), x, kind).select("id", F.round("value", 4).alias("value"))

    return query


def modularity(spark, sf_dir):
    regions = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("c"))
    return graph.modularity(_trade(spark, sf_dir), regions).select(F.round("q", 8).alias("q"))


def modularity_matrix(spark, sf_dir):
    return graph.modularity_matrix(_trade(spark, sf_dir)).select("src", "dst", F.round("value", 9).alias("value"))


def coaffiliation(spark, sf_dir):
    members = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("c"), (F.col("n_nationkey") + 1.0).alias("w"))
    return graph.coaffiliation(members)


def laplacian_eigenmap(spark, sf_dir):
    """Two coordinates of each node of the trade graph, and their eigenvalues. No SQL: tests compare NumPy's."""
    found, values = spectra.laplacian_eigenmap(_trade(spark, sf_dir), 2)
    parts = [F.round(F.col("vector")[i], 5).alias(f"x{i}") for i in range(len(values))]
    return found.select("id", *parts, *(F.lit(round(float(v), 6)).alias(f"value{i}") for i, v in enumerate(values)))


def diffusion_embedding(spark, sf_dir):
    found, values = spectra.diffusion_embedding(_trade(spark, sf_dir), 2, alpha=0.5, t=1.0)
    return found.select("id", *(F.round(F.col("vector")[i], 6).alias(f"x{i}") for i in range(len(values))))


def components(spark, sf_dir):
    edges = _line_pairs(spark, sf_dir)
    nodes = _suppliers(spark, sf_dir).select("id")
    return graph.connected_components(edges, nodes).orderBy("id")


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on consecutive lines of an order."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    return rows.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("src"), "dst").distinct()


QUERIES = {
    **{f"semiring_{name}": _matmul(name) for name in semiring.ALGEBRAS},
    "ell_matmul": ell_matmul, "ell_rmatvec": ell_rmatvec, "edge_aggregate": edge_aggregate, "row_softmax": row_softmax, "sparse_top_k": sparse_top_k,
    "sparse_symmetric": sparse_symmetric, "masked_edges": masked_edges, "self_loops": self_loops, "dense_cells": dense_cells,
    "degree": _degrees(graph.degree), "in_degree": _degrees(graph.in_degree), "symmetric_degree": _degrees(graph.symmetric_degree),
    **{f"laplacian_{kind}": _laplacian(kind) for kind in ("combinatorial", "symmetric", "random_walk")},
    **{f"laplacian_matvec_{kind}": _matvec(kind) for kind in ("combinatorial", "symmetric", "random_walk")},
    "modularity": modularity, "modularity_matrix": modularity_matrix, "coaffiliation": coaffiliation, "connected_components": components,
    "laplacian_eigenmap": laplacian_eigenmap, "diffusion_embedding": diffusion_embedding,
}

_AB = "WITH a AS (SELECT l_suppkey AS i, l_linenumber AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_linenumber AS k, l_returnflag AS j, avg(l_discount) * 100 AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT i, j, a.v AS x, b.v AS y FROM a JOIN b USING (k)) SELECT i, j, {} AS value FROM t GROUP BY 1, 2"
_E = "e AS (SELECT o_custkey AS src, l_suppkey AS dst, sum(l_extendedprice) / 1000 AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_T = f"{_E}, t AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(value) AS value FROM e JOIN customer ON src = c_custkey JOIN supplier ON dst = s_suppkey GROUP BY 1, 2), d AS (SELECT src AS id, sum(value) AS d FROM t GROUP BY 1)"
_BY = {"combinatorial": ("1", "d.d"), "symmetric": ("sqrt(greatest(p.d, 1e-12) * greatest(q.d, 1e-12))", "1"), "random_walk": ("greatest(p.d, 1e-12)", "1")}

ORACLE_SQL = {
    "semiring_real": _AB.format("round(sum(x * y), 6)"), "semiring_log": _AB.format("round(max(x + y) + ln(sum(exp(x + y - 40))) + 40 - max(x + y), 6)"),
    "semiring_max_plus": _AB.format("round(max(x + y), 6)"), "semiring_min_plus": _AB.format("round(min(x + y), 6)"),
    "semiring_boolean": _AB.format("bool_or(x <> 0 AND y <> 0)::INT"), "semiring_euclidean": _AB.format("round(sqrt(sum((x - y) * (x - y))), 6)"),
    "ell_matmul": f"WITH {_E} SELECT src AS i, round(min(value + s_acctbal / 1000), 6) AS value FROM e JOIN supplier ON s_suppkey = dst GROUP BY 1",
    "ell_rmatvec": f"WITH {_E} SELECT dst, round(sum(value * c_acctbal / 1000), 4) AS value FROM e JOIN customer ON c_custkey = src GROUP BY 1",
    "edge_aggregate": f"WITH {_E} SELECT src, round(max(value * abs(c_acctbal / 1000 - s_acctbal / 1000)), 6) AS value FROM e JOIN customer ON c_custkey = src JOIN supplier ON s_suppkey = dst GROUP BY 1",
    "row_softmax": f"WITH {_E} SELECT src, dst, round(exp(value / 100 - m) / sum(exp(value / 100 - m)) OVER (PARTITION BY src), 8) AS value FROM (SELECT *, max(value / 100) OVER (PARTITION BY src) AS m FROM e)",
    "sparse_top_k": f"WITH {_E} SELECT src, dst, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(value) DESC, dst) AS n FROM e WHERE abs(value) > 20) WHERE n <= 5",
    "sparse_symmetric": f"WITH {_T} SELECT src, dst, round(sum(value) / 2, 6) AS value FROM (SELECT src, dst, value FROM t WHERE abs(value) > 0 UNION ALL SELECT dst, src, value FROM t WHERE abs(value) > 0) GROUP BY 1, 2",
    "masked_edges": f"WITH {_E} SELECT src, round(sum(value), 6) AS value FROM e JOIN supplier ON s_suppkey = dst WHERE s_acctbal / 1000 > 5 GROUP BY 1",
    "self_loops": f"WITH {_T} SELECT src, dst, round(value, 6) AS value FROM t UNION ALL SELECT src, src, round(avg(value), 6) FROM t GROUP BY src",
    "dense_cells": f"WITH {_T} SELECT a.i::BIGINT AS src, b.i::BIGINT AS dst, round(coalesce(value, 0), 6) AS value FROM range(25) a(i) CROSS JOIN range(25) b(i) LEFT JOIN t ON src = a.i AND dst = b.i",
    "degree": f"WITH {_T} SELECT id, round(d, 6) AS d FROM d", "in_degree": f"WITH {_T} SELECT dst AS id, round(sum(value), 6) AS d FROM t GROUP BY 1",
    "symmetric_degree": f"WITH {_T} SELECT id, round(sum(value) / 2, 6) AS d FROM (SELECT src AS id, value FROM t UNION ALL SELECT dst, value FROM t) GROUP BY 1",
    **{f"laplacian_{k}": f"WITH {_T} SELECT src, dst, round(sum(value), 6) AS value FROM (SELECT src, dst, -value / {by} AS value FROM t JOIN d p ON p.id = src JOIN d q ON q.id = dst UNION ALL SELECT id, id, {own} FROM d) GROUP BY 1, 2" for k, (by, own) in _BY.items()},
    **{f"laplacian_matvec_{k}": f"WITH {_T}, y AS (SELECT src, sum(value / {by} * dst / 10) AS y FROM t JOIN d p ON p.id = src JOIN d q ON q.id = dst GROUP BY 1) SELECT r.i::BIGINT AS id, round(coalesce({own if own == '1' else 'd.d'}, 0) * r.i / 10 - coalesce(y, 0), 4) AS value FROM range(25) r(i) LEFT JOIN d ON d.id = r.i LEFT JOIN y ON y.src = r.i" for k, (by, own) in _BY.items()},
    "modularity": f"WITH {_T}, c AS (SELECT n_nationkey AS id, n_regionkey AS c FROM nation), x AS (SELECT value, p.c AS a, q.c AS b FROM t JOIN c p ON p.id = src JOIN c q ON q.id = dst), m AS (SELECT sum(value) AS m, sum(CASE WHEN a = b THEN value ELSE 0 END) AS inside FROM x), o AS (SELECT a AS c, sum(value) AS k FROM x GROUP BY 1), i AS (SELECT b AS c, sum(value) AS k FROM x GROUP BY 1), n AS (SELECT sum(o.k * i.k) AS n FROM o JOIN i USING (c)) SELECT round((inside - n / m) / m, 8) AS q FROM m, n",
    "modularity_matrix": f"WITH {_T}, i AS (SELECT dst AS id, sum(value) AS k FROM t GROUP BY 1), m AS (SELECT sum(value) AS m FROM t) SELECT src, dst, round((value - d.d * i.k / m) / m, 9) AS value FROM t JOIN d ON d.id = src JOIN i ON i.id = dst, m",
    "coaffiliation": "SELECT a.n_nationkey AS i, b.n_nationkey AS j, sum((a.n_nationkey + 1.0::DOUBLE) * (b.n_nationkey + 1.0::DOUBLE)) AS value FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1, 2",
    "connected_components": "WITH RECURSIVE p AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1), e AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p), r AS (SELECT s_suppkey AS id, s_suppkey AS label FROM supplier UNION SELECT e.dst, r.label FROM r JOIN e ON e.src = r.id) SELECT id, min(label) AS label FROM r GROUP BY 1",
}
