"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from quern.plans import algebra, covariances, descriptive, factors, fields, folds, matrices, mixed, modelling, motions, signals, smooths, spatial, surfaces, testing, vectors, volumes

FLAGSHIP = "corr"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (descriptive, algebra, testing, modelling, spatial, surfaces, motions, covariances, vectors, signals, fields, matrices, mixed, smooths, factors, volumes, folds):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
