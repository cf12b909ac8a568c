"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int) -> Column:
    """Rounds to decimal places, exact halves up; the same in every engine."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def decibel(rms: Column, floor: float) -> Column:
    return 20.0 * F.log10(rms + F.lit(floor))


def stripped(text: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
