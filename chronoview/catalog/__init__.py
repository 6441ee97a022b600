"""Registered queries over the test tables, each with its SQL counterpart where SQL can say it."""

from chronoview.catalog import cohort, scores, tables, views  # noqa: F401
from chronoview.catalog.registry import ORACLES, QUERIES  # noqa: F401
