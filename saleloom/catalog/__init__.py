"""Registered queries, each next to the SQL that must give the same rows."""

from saleloom.catalog import (  # noqa: F401  (importing registers the queries)
    evaluation,
    features,
    fixed,
    forecasts,
    ingest,
    models,
    panel_ops,
    streams,
)
from saleloom.catalog.base import QUERIES, SQL, SURVEY_ROWS

__all__ = ["QUERIES", "SQL", "SURVEY_ROWS"]
