"""Faces that run through each other, on the height field of events with its places shifted by up to two rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import crossings
from quern.plans import surfaces
from quern.sources.tables import read


def self_intersections(spark, sf_dir):
    e = F.col("event_id")
    x, y = F.floor(e / surfaces.WIDTH) + e * 37 % 101 / F.lit(50.0), e % surfaces.WIDTH + e * 53 % 97 / F.lit(150.0)
    vertices = read(spark, sf_dir, "events").select(e.alias("vid"), x.alias("x"), y.alias("y"), (F.col("value") / 25).alias("z"))
    return crossings.self_intersections(vertices, surfaces.faces(spark, sf_dir))


QUERIES = {"self_intersections": self_intersections}


def _volume(a: str, b: str, c: str, d: str) -> str:
    u, v, w = ([f"({p}.{k} - {a}.{k})" for k in "xyz"] for p in (b, c, d))
    return f"({u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) - {u[1]} * ({v[0]} * {w[2]} - {v[2]} * {w[0]}) + {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]}))"


_P = "p AS (SELECT event_id AS e, {'x': event_id // 100 + event_id * 37 % 101 / 50.0::DOUBLE, 'y': event_id % 100 + event_id * 53 % 97 / 150.0::DOUBLE, 'z': value / 25} AS p FROM events)"
_F = "g AS (SELECT e FROM p WHERE e % 100 < 99 AND e + 101 <= (SELECT max(e) FROM p)), f AS (SELECT 2 * e AS fid, e AS a, e + 1 AS b, e + 100 AS c FROM g UNION ALL SELECT 2 * e + 1, e + 1, e + 101, e + 100 FROM g)"
_T = "t AS MATERIALIZED (SELECT fid, fid // 200 AS r, fid // 2 % 100 AS q, f.a, f.b, f.c, i.p AS pa, j.p AS pb, k.p AS pc FROM f JOIN p i ON i.e = f.a JOIN p j ON j.e = f.b JOIN p k ON k.e = f.c)"
_NEAR = "o AS (SELECT t.*, r + i AS r2, q + j AS q2 FROM t, generate_series(-4, 4) m(i), generate_series(-2, 2) n(j))"
_BOX = " AND ".join(f"least(s.pa.{k}, s.pb.{k}, s.pc.{k}) <= greatest(t.pa.{k}, t.pb.{k}, t.pc.{k}) AND least(t.pa.{k}, t.pb.{k}, t.pc.{k}) <= greatest(s.pa.{k}, s.pb.{k}, s.pc.{k})" for k in "xyz")
_PAIRS = f"c AS MATERIALIZED (SELECT s.fid, t.fid AS other, s.pa AS sa, s.pb AS sb, s.pc AS sc, t.pa AS ta, t.pb AS tb, t.pc AS tc FROM o s JOIN t ON t.r = s.r2 AND t.q = s.q2 WHERE s.fid < t.fid AND {_BOX} AND NOT list_has_any([s.a, s.b, s.c], [t.a, t.b, t.c]))"
_SIDES = "v AS (" + " UNION ALL ".join(f"SELECT fid, other, {m}{i} AS p, {m}{j} AS q, {n}a AS a, {n}b AS b, {n}c AS c FROM c" for m, n in ("st", "ts") for i, j in ("ab", "bc", "ca")) + ")"
_W = f"w AS (SELECT fid, other, {_volume('a', 'b', 'c', 'p')} AS below, {_volume('a', 'b', 'c', 'q')} AS above, {_volume('p', 'q', 'a', 'b')} AS k, {_volume('p', 'q', 'b', 'c')} AS l, {_volume('p', 'q', 'c', 'a')} AS m FROM v)"

ORACLE_SQL = {
    "self_intersections": f"WITH {_P}, {_F}, {_T}, {_NEAR}, {_PAIRS}, {_SIDES}, {_W} SELECT DISTINCT fid, other FROM w WHERE abs(below - above) >= 1e-9 AND least(below, above) <= 1e-9 * abs(below - above) AND greatest(below, above) >= -1e-9 * abs(below - above) AND (least(k, l, m) >= -1e-9 * abs(below - above) OR greatest(k, l, m) <= 1e-9 * abs(below - above))",
}
