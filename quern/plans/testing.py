"""Metric, multiple-testing and time-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import inference, metrics, series
from quern.sources.tables import read


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    return rows.withColumn("logit", (F.col("value") - 50) / 25).withColumn("target", (F.col("user_id") % 3 == 0).cast("double"))


def _loss(op):
    return lambda spark, sf_dir: _logits(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(op(F.col("logit"), F.col("target"))), 8).alias("loss"))


def roc_auc(spark, sf_dir):
    out = metrics.roc_auc(_logits(spark, sf_dir), "logit", "target", ("event_type",))
    return out.select("event_type", F.round("auc", 8).alias("auc"))


def roc_auc_all(spark, sf_dir):
    return metrics.roc_auc(_logits(spark, sf_dir), "logit", "target").select(F.round("auc", 8).alias("auc"))


def confusion(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    return metrics.confusion_matrix(labels, "quality", "toxic", 2)


def overlap(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("pred", (F.col("logit") > 0).cast("double"))
    return rows.groupBy("event_type").agg(F.round(metrics.dice(F.col("pred"), F.col("target")), 8).alias("dice"), F.round(metrics.jaccard(F.col("pred"), F.col("target")), 8).alias("jaccard"))


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("w"))


def ssd(spark, sf_dir):
    d = F.pow(F.col("a") - F.col("b") / 1000, F.lit(2))
    return _pair(spark, sf_dir).groupBy("l_returnflag").agg(F.round(metrics.domain_mean(d, F.col("w")), 6).alias("ssd"))


def ncc(spark, sf_dir):
    return _pair(spark, sf_dir).groupBy("l_returnflag").agg(F.round(metrics.ncc(F.col("a"), F.col("b"), F.col("w")), 7).alias("ncc"))


def joint_histogram(spark, sf_dir):
    out = metrics.joint_histogram(_pair(spark, sf_dir), "a", "b", 16)
    return out.select("i", "j", F.round("p", 9).alias("p")).filter("p > 0")


def mutual_information(spark, sf_dir):
    return metrics.mutual_information(metrics.joint_histogram(_pair(spark, sf_dir), "a", "b", 16)).select(F.round("mi", 7).alias("mi"))


def correlation_ratio(spark, sf_dir):
    return metrics.correlation_ratio(_pair(spark, sf_dir), "b", "a", 16).select(F.round("eta2", 7).alias("eta2"))


def gaussian_nll(spark, sf_dir):
    nll = metrics.gaussian_nll(F.col("logit"), F.lit(0.1), F.col("target") - 0.5)
    return _logits(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(nll), 8).alias("nll"))


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pseudo p-value for each part, from integers that both engines compute alike."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", (F.pow((k * 7919 % 10007) / F.lit(10007.0), F.lit(3.0))).alias("p"))


def _corrected(op):
    return lambda spark, sf_dir: op(_p(spark, sf_dir), "p").select("p_partkey", F.round("q", 8).alias("q"), F.col("reject").cast("int").alias("reject"))


def storey_pi0(spark, sf_dir):
    return inference.storey_pi0(_p(spark, sf_dir), "p").select(F.round("pi0", 8).alias("pi0"))


def conjunction(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    parts = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", inference.conjunction(parts).alias("stat"), inference.conjunction_pvalue(parts).alias("p"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("label"), "value")


def cluster_size(spark, sf_dir):
    return inference.cluster_size_map(_cells(spark, sf_dir), "label").select("event_id", F.col("size").cast("long").alias("size"))


def cluster_mass(spark, sf_dir):
    return inference.cluster_mass_map(_cells(spark, sf_dir), "label", "value", 60.0).select("event_id", F.round("mass", 6).alias("mass"))


def variogram(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") / F.lit(1.0)).alias("x"), (F.col("c_acctbal") / 1000).alias("v"))
    return inference.variogram(rows, "x", "v", 20.0, 10).select(F.col("bin").cast("long").alias("bin"), "n", F.round("gamma", 6).alias("gamma"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users, numbered by time; every fourth value is unobserved."""
    rows = read(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("event_id", "user_id", "ts", "value")
    rows = rows.withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double"))
    return rows.withColumn("seen", F.col("event_id") % 4 != 0)


def _ts(op, column: str, *args, digits: int = 6):
    def query(spark, sf_dir):
        out = op(_series(spark, sf_dir), "user_id", "t", "value", *args)
        return out.select("event_id", F.round(column, digits).alias(column))

    return query


def phase_frequency(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("phase", F.col("value") % 6.0 - 3.0)
    out = series.instantaneous_frequency(rows, "user_id", "t", "phase")
    return out.select("event_id", F.round("frequency", 6).alias("frequency"))


def cs_whiten(spark, sf_dir):
    return series.cs_whiten(_series(spark, sf_dir), "user_id", "value", 1.2, 0.7).select("event_id", F.round("white", 9).alias("white"))


def lomb_scargle(spark, sf_dir):
    out = series.lomb_scargle(_series(spark, sf_dir).filter("seen"), "user_id", "t", "value", [0.05, 0.11, 0.23])
    return out.select(F.col("series").alias("user_id"), "frequency", F.round("power", 6).alias("power"))


QUERIES = {
    "bce": _loss(metrics.bce_with_logits), "focal": _loss(metrics.focal_loss), "roc_auc": roc_auc, "roc_auc_all": roc_auc_all, "confusion_matrix": confusion,
    "dice_jaccard": overlap, "ssd": ssd, "ncc": ncc, "joint_histogram": joint_histogram, "mutual_information": mutual_information,
    "correlation_ratio": correlation_ratio, "gaussian_nll": gaussian_nll, "bonferroni": _corrected(inference.bonferroni), "fdr_bh": _corrected(inference.fdr_bh),
    "fdr_by": _corrected(inference.fdr_by), "fdr_storey": _corrected(inference.fdr_storey), "storey_pi0": storey_pi0, "conjunction": conjunction,
    "cluster_size": cluster_size, "cluster_mass": cluster_mass, "variogram": variogram,
    "linear_interpolate": _ts(series.linear_interpolate, "filled", "seen"), "polynomial_detrend": _ts(series.polynomial_detrend, "detrended"),
    "tsconv": _ts(series.tsconv, "convolved", [0.25, 0.5, 0.15, 0.1, -0.2]), "dilate": _ts(series.dilate, "dilated", 2), "erode": _ts(series.erode, "eroded", 2),
    "box_mean": _ts(series.box_mean, "smoothed", 3), "spatial_gradient": _ts(series.gradient, "gradient"), "ar1_whiten": _ts(series.ar1_whiten, "white", 0.4),
    "opening": _ts(series.opening, "opened", 1), "closing": _ts(series.closing, "closed", 1), "phase_frequency": phase_frequency, "cs_whiten": cs_whiten,
    "lomb_scargle": lomb_scargle,
}

_L = "WITH l AS (SELECT event_id, event_type, user_id, (value - 50) / 25 AS x, CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS t FROM events WHERE user_id IS NOT NULL)"
_BCE = "greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))"
_AUC = "r AS (SELECT {k} t, rank() OVER ({p} ORDER BY x) + (count(*) OVER (PARTITION BY {k} x) - 1) / 2.0 AS r FROM l) SELECT {k} round((sum(CASE WHEN t = 1 THEN r ELSE 0 END) - sum(t) * (sum(t) + 1) / 2) / (sum(t) * (count(*) - sum(t))), 8) AS auc FROM r {g}"
_P = "WITH p AS (SELECT p_partkey, pow((p_partkey * 7919 % 10007) / 10007.0::DOUBLE, 3) AS p FROM part), m AS (SELECT count(*)::DOUBLE AS m, least(greatest(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) / (count(*) * 0.5), 1.0 / count(*)), 1.0) AS pi0 FROM p), r AS (SELECT p_partkey, p, row_number() OVER (ORDER BY p, p_partkey) AS k FROM p)"
_Q = _P + ", q AS (SELECT p_partkey, least(1.0, min({f} * p / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r, m) SELECT p_partkey, round(q, 8) AS q, (q <= 0.05)::INT AS reject FROM q"
_S = "WITH s AS (SELECT event_id, user_id, value, event_id % 4 <> 0 AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS t FROM events WHERE user_id IS NOT NULL)"
_W = "OVER (PARTITION BY user_id ORDER BY t{})"
_F = " ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING"
_SOFT = "WITH r AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_extendedprice) AS b0, max(l_extendedprice) AS b1 FROM lineitem), x AS (SELECT (l_quantity - a0) / (a1 - a0) * 15 AS u, (l_extendedprice - b0) / (b1 - b0) * 15 AS v, l_extendedprice AS b FROM lineitem, r), f AS (SELECT u, v, b, least(floor(u), 14) AS i, least(floor(v), 14) AS j FROM x)"
_HIST = _SOFT + ", c AS (SELECT i + d.d AS i, j + e.e AS j, (CASE WHEN d.d = 0 THEN 1 - (u - i) ELSE u - i END) * (CASE WHEN e.e = 0 THEN 1 - (v - j) ELSE v - j END) AS w FROM f, range(2) d(d), range(2) e(e)), h AS (SELECT i::BIGINT AS i, j::BIGINT AS j, sum(w) / (SELECT count(*) FROM f) AS p FROM c GROUP BY 1, 2 HAVING sum(w) > 0)"

ORACLE_SQL = {
    "bce": f"{_L.replace(' WHERE user_id IS NOT NULL', '')} SELECT event_type, round(avg({_BCE}), 8) AS loss FROM l GROUP BY 1",
    "focal": f"{_L} SELECT event_type, round(avg((0.25 * t + 0.75 * (1 - t)) * pow(1 - (1 / (1 + exp(-x)) * t + (1 - 1 / (1 + exp(-x))) * (1 - t)), 2) * ({_BCE})), 8) AS loss FROM l GROUP BY 1",
    "roc_auc": f"{_L}, " + _AUC.format(k="event_type, ", p="PARTITION BY event_type", g="GROUP BY 1"), "roc_auc_all": f"{_L}, " + _AUC.format(k="", p="", g=""),
    "confusion_matrix": "SELECT a.i::BIGINT AS t, b.i::BIGINT AS p, count(doc_id) AS n FROM range(2) a(i) CROSS JOIN range(2) b(i) LEFT JOIN labels ON quality = a.i AND toxic = b.i GROUP BY 1, 2",
    "dice_jaccard": f"{_L}, q AS (SELECT event_type, t, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END AS p FROM l) SELECT event_type, round((2 * sum(p * t) + 1e-7) / (sum(p) + sum(t) + 1e-7), 8) AS dice, round((sum(p * t) + 1e-7) / (sum(p) + sum(t) - sum(p * t) + 1e-7), 8) AS jaccard FROM q GROUP BY 1",
    "ssd": "SELECT l_returnflag, round(sum(l_discount * pow(l_quantity - l_extendedprice / 1000, 2)) / greatest(sum(l_discount), 1e-12), 6) AS ssd FROM lineitem GROUP BY 1",
    "ncc": "WITH s AS (SELECT l_returnflag AS f, sum(l_discount) + 1e-8 AS n, sum(l_discount * l_quantity) AS a, sum(l_discount * l_extendedprice) AS b, sum(l_discount * l_quantity * l_extendedprice) AS ab, sum(l_discount * l_quantity * l_quantity) AS aa, sum(l_discount * l_extendedprice * l_extendedprice) AS bb FROM lineitem GROUP BY 1) SELECT f AS l_returnflag, round((ab / n - a / n * b / n) / (sqrt((aa / n - a / n * a / n) * (bb / n - b / n * b / n)) + 1e-8), 7) AS ncc FROM s",
    "joint_histogram": f"{_HIST} SELECT i, j, round(p, 9) AS p FROM h WHERE round(p, 9) > 0",
    "mutual_information": f"{_HIST}, a AS (SELECT i, sum(p) AS pi FROM h GROUP BY 1), b AS (SELECT j, sum(p) AS pj FROM h GROUP BY 1) SELECT round(sum(p * ln((p + 1e-10) / (pi * pj + 1e-10))), 7) AS mi FROM h JOIN a USING (i) JOIN b USING (j)",
    "correlation_ratio": f"{_SOFT}, c AS (SELECT i + d.d AS i, CASE WHEN d.d = 0 THEN 1 - (u - i) ELSE u - i END AS w, b FROM f, range(2) d(d)), g AS (SELECT i, sum(w) AS w, sum(w * b) AS s, sum(w * b * b) AS q FROM c GROUP BY 1) SELECT round((sum(CASE WHEN w > 1e-10 THEN s * s / w END) - sum(s) * sum(s) / sum(w)) / (sum(q) - sum(s) * sum(s) / sum(w)), 7) AS eta2 FROM g",
    "gaussian_nll": f"{_L} SELECT event_type, round(avg(0.5 * (ln(2 * pi()) + (t - 0.5) + (x - 0.1) * (x - 0.1) / exp(t - 0.5))), 8) AS nll FROM l GROUP BY 1",
    "bonferroni": f"{_P} SELECT p_partkey, round(least(1.0, p * m), 8) AS q, (least(1.0, p * m) <= 0.05)::INT AS reject FROM r, m",
    "fdr_bh": _Q.format(f="m"), "fdr_by": _Q.format(f="m * (SELECT sum(1.0::DOUBLE / k) FROM r)"), "fdr_storey": _Q.format(f="m * pi0"),
    "storey_pi0": f"{_P} SELECT round(pi0, 8) AS pi0 FROM m",
    "conjunction": "SELECT l_orderkey, l_linenumber, l_partkey, least(l_discount, l_tax, l_quantity / 100) AS stat, greatest(l_discount, l_tax, l_quantity / 100) AS p FROM lineitem",
    "cluster_size": "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 0 ELSE count(*) OVER (PARTITION BY user_id % 7) END AS size FROM events WHERE user_id IS NOT NULL",
    "cluster_mass": "SELECT event_id, round(CASE WHEN user_id % 7 = 0 THEN 0 ELSE sum(greatest(value - 60, 0)) OVER (PARTITION BY user_id % 7) END, 6) AS mass FROM events WHERE user_id IS NOT NULL",
    "variogram": "SELECT least(floor((a.c_custkey - b.c_custkey) / 20.0::DOUBLE * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(pow(a.c_acctbal / 1000 - b.c_acctbal / 1000, 2)) / 2, 6) AS gamma FROM customer a JOIN customer b ON b.c_custkey < a.c_custkey AND a.c_custkey - b.c_custkey <= 20 GROUP BY 1",
    "linear_interpolate": f"{_S}, b AS (SELECT *, last_value(CASE WHEN seen THEN t END IGNORE NULLS) {_W.format('')} AS ta, last_value(CASE WHEN seen THEN value END IGNORE NULLS) {_W.format('')} AS va, first_value(CASE WHEN seen THEN t END IGNORE NULLS) {_W.format(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS tb, first_value(CASE WHEN seen THEN value END IGNORE NULLS) {_W.format(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS vb FROM s) SELECT event_id, round(CASE WHEN seen THEN value ELSE coalesce(va + (t - ta) / (tb - ta) * (vb - va), va, vb, 0) END, 6) AS filled FROM b",
    "polynomial_detrend": f"{_S}, f AS (SELECT user_id, CASE WHEN count(*) > 1 THEN regr_slope(value, t) END AS b, CASE WHEN count(*) > 1 THEN regr_intercept(value, t) END AS a, avg(value) AS m FROM s GROUP BY 1) SELECT event_id, round(value - coalesce(a + b * t, m), 6) AS detrended FROM s JOIN f USING (user_id)",
    "tsconv": f"{_S} SELECT event_id, round(" + " + ".join(f"coalesce(lag(value, {2 - k}) {_W.format('')}, 0) * {w}" for k, w in enumerate([0.25, 0.5, 0.15, 0.1, -0.2])) + ", 6) AS convolved FROM s",
    "dilate": f"{_S} SELECT event_id, round(max(value) {_W.format(_F.format(2))}, 6) AS dilated FROM s", "erode": f"{_S} SELECT event_id, round(min(value) {_W.format(_F.format(2))}, 6) AS eroded FROM s",
    "opening": f"{_S}, e AS (SELECT event_id, user_id, t, min(value) {_W.format(_F.format(1))} AS x FROM s) SELECT event_id, round(max(x) {_W.format(_F.format(1))}, 6) AS opened FROM e",
    "closing": f"{_S}, e AS (SELECT event_id, user_id, t, max(value) {_W.format(_F.format(1))} AS x FROM s) SELECT event_id, round(min(x) {_W.format(_F.format(1))}, 6) AS closed FROM e",
    "box_mean": f"{_S} SELECT event_id, round(avg(value) {_W.format(_F.format(3))}, 6) AS smoothed FROM s",
    "spatial_gradient": f"{_S}, n AS (SELECT event_id, value, lag(value) {_W.format('')} AS a, lead(value) {_W.format('')} AS b FROM s) SELECT event_id, round(coalesce((b - a) / 2, b - value, value - a, 0), 6) AS gradient FROM n",
    "ar1_whiten": f"{_S} SELECT event_id, round(coalesce((value - 0.4 * lag(value) {_W.format('')}) / sqrt(1 - 0.4 * 0.4), value), 6) AS white FROM s",
    "phase_frequency": f"{_S}, p AS (SELECT event_id, user_id, t, value % 6.0 - 3.0 AS p FROM s), d AS (SELECT event_id, p - lag(p) {_W.format('')} AS d FROM p) SELECT event_id, round((d - round(d / (2 * pi())) * 2 * pi()) / (2 * pi()), 6) AS frequency FROM d WHERE d IS NOT NULL",
    "cs_whiten": f"{_S} SELECT event_id, round(1.2 * value + (0.7 - 1.2) * avg(value) OVER (PARTITION BY user_id), 9) AS white FROM s",
    "lomb_scargle": f"{_S}, x AS (SELECT user_id, t, value - avg(value) OVER (PARTITION BY user_id) AS x FROM s WHERE seen), v AS (SELECT user_id, var_samp(x) AS v FROM x GROUP BY 1), a AS (SELECT x.*, f, 2 * pi() * f AS w FROM x, (SELECT unnest([0.05, 0.11, 0.23]::DOUBLE[]) AS f)), u AS (SELECT user_id, f, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / (2 * any_value(w)) AS tau FROM a GROUP BY 1, 2), g AS (SELECT user_id, f, sum(x * cos(w * (t - tau))) AS xc, sum(x * sin(w * (t - tau))) AS xs, sum(cos(w * (t - tau)) * cos(w * (t - tau))) AS cc, sum(sin(w * (t - tau)) * sin(w * (t - tau))) AS ss FROM a JOIN u USING (user_id, f) GROUP BY 1, 2) SELECT user_id, f AS frequency, round((xc * xc / greatest(cc, 1e-12) + xs * xs / greatest(ss, 1e-12)) / (2 * greatest(v, 1e-12)), 6) AS power FROM g JOIN v USING (user_id)",
}
