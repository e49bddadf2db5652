"""Counter-based random numbers: the same arguments give the same number on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers lie in [0, 2**52).
BITS = 52


def hashed(*parts: Column | str | int) -> Column:
    """A uniform BIGINT of 52 bits from the parts, joined by colons and hashed."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 13), 16, 10).cast("long")


def below(n: Column, *parts: Column | str | int) -> Column:
    """Uniform in [0, n); null where n is 0. The bias is n / 2**52 at most."""
    return hashed(*parts) % F.nullif(n, F.lit(0))


def unit(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1)."""
    return hashed(*parts) / F.lit(float(1 << BITS))
