"""Decimal rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1: splits a double into two halves of 26 bits


def round_exact(x: Column, digits: int, ties_up: bool = False) -> Column:
    """Round a non-negative double (below 2**20) as Python's ``round`` does.

    Spark rounds the shortest decimal text of a double, so 2.675 becomes 2.68; by
    its binary value, slightly smaller, it is 2.67.  Splitting makes ``x * 2 * scale``
    exact, so its distance from the midpoint has the right sign.  Exact ties go to the
    even neighbour, or up.
    """
    scale = 10.0**digits
    below = F.floor(x * scale)
    carry = x * _SPLIT
    high = carry - (carry - x)
    low = x - high
    beyond = (high * (2 * scale) - (2 * below + 1)) + low * (2 * scale)
    tie = F.lit(True) if ties_up else below % 2 == 1
    up = (beyond > 0) | ((beyond == 0) & tie)
    return F.when(up, below + 1).otherwise(below) / scale
