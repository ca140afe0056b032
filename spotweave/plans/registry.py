"""Names the queries of the library and the SQL each must agree with."""

from __future__ import annotations

from functools import wraps

from spotweave.plans import base_queries, report_queries, signal_queries, table_queries
from spotweave.plans.shipping import ship

FLAGSHIP = "flagship"
MODULES = (base_queries, signal_queries, report_queries, table_queries)


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries():
    """Query name to callable (spark, sf_dir) -> DataFrame."""
    return {name: _shipped(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    """Query name to DuckDB SQL."""
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
