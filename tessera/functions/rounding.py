"""Rounding that engines agree on."""

from pyspark.sql import functions as F


def micro(c):
    """c to six decimals, halves up."""
    return F.floor(c * 1e6 + 0.5) / 1e6
