"""Stateless random numbers: hashes of their coordinates, the same in every engine and on every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*parts) -> Column:
    """A number in 0 .. 2**60-1 from the MD5 of the parts joined by colons."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("bigint")
