"""Registered queries over the given tables."""

from rentloom.cases import address, analytics, ingest, models, quality, relations
from rentloom.cases.registry import QUERIES, SQL

MODULES = (ingest, quality, relations, address, analytics, models)


def registered() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(SQL)
