"""The registered queries of the library, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from courtside.plans import careers, learned, metrics, projections, relations, sequences, streams

PLANS = (projections, sequences, relations, metrics, learned, streams, careers)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
