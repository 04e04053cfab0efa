"""Registered queries: each operator bound to the test tables, with its DuckDB check."""

from pulseframe.catalog import (  # noqa: F401
    classifiers,
    evaluation,
    forecasting,
    labelling,
    scenarios,
    signals,
    sources,
    streams,
    weekly,
)
from pulseframe.catalog.base import ORACLES, QUERIES  # noqa: F401
