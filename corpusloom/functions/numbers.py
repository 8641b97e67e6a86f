"""Exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(dividend: Column, divisor: Column | int) -> Column:
    """Integer quotient, without a detour through doubles."""
    return F.call_function(
        "div", dividend, F.lit(divisor) if isinstance(divisor, int) else divisor
    )
