"""All registered queries and the SQL statements they must agree with."""

from __future__ import annotations

from . import detect, documents, fleet, gate, measure, platform

MODULES = [gate, measure, detect, platform, documents, fleet]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
