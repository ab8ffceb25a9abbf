"""Rounding that two engines agree on.

Results are decimals often lying exactly between two rounded values, where the last bit of a sum
decides. Shifting the border off the decimals (``floor(x * 10^d + 0.814..) / 10^d``) removes these ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BORDER = "0.8141592e0"

# Decimals kept for metrics with large values; six for all others.
DIGITS = {"DiskUsage": 2, "BytesRecvd": 2}


def digits_of(name: str) -> int:
    for metric, digits in DIGITS.items():
        if name.endswith(metric):
            return digits
    return 6


def settle(value: Column, digits: int = 6) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(float(BORDER))) / scale


def settled(*names: str) -> list[Column]:
    return [settle(F.col(n), digits_of(n)).alias(n) for n in names]


def settle_sql(expression: str, digits: int = 6) -> str:
    return f"floor(({expression})*1e{digits}+{BORDER})/1e{digits}"


def settled_sql(*names: str) -> str:
    return ", ".join(f"{settle_sql(n, digits_of(n))} AS {n}" for n in names)
