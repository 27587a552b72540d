"""touchpoint: marketing-attribution and audience analytics as Spark DataFrame operators.

Layout
------
functions/   Column-level building blocks (phone cleanup, UTM extraction, classifiers,
             event-parameter lookup, time-zone helpers). Pure ``Column -> Column``.
operators/   DataFrame-level operators (relational helpers, attribution, audiences,
             reports, data-quality checks, incremental loading).
sources/     Logical table schemas, readers and the adapters that derive the logical
             tables from the driver's test tables.
plans/       The registered queries (one per operator) and their DuckDB oracles.
streaming/   Structured Streaming wrapper around the incremental lead load.

Everything is expressed with built-in Spark SQL expressions: no Python UDFs.
"""

from touchpoint.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
