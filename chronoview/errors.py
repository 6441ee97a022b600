"""Fail-closed errors raised by actions on a violations frame."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ContractViolation(ValueError):
    """Raised when a violations frame is not empty."""


def require_columns(df: DataFrame, required: set[str], what: str) -> None:
    missing = sorted(required - set(df.columns))
    if missing:
        raise ContractViolation(f"{what} is missing columns {missing}")


def require_clean(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise if any violation exists; only the first few rows reach the driver."""
    examples = violations.limit(show).collect()
    if examples:
        details = "; ".join(", ".join(f"{k}={v}" for k, v in row.asDict().items())
                            for row in examples)
        raise ContractViolation(f"{what}: {details}")
