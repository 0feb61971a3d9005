"""Queries over the driver tables and over small fixtures; importing this registers them all."""

from traceframe.library import (  # noqa: F401
    aggregates,
    comparison,
    conditions,
    customer_conditions,
    evaluation,
    indexed,
    joins,
    lexical,
    projections,
    retrieval,
    settings,
    sources,
    status,
    table_views,
    views,
    whole_tables,
)
