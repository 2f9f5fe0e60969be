"""Deterministic uniforms from md5, so retries and replays draw the same values
(``rand()`` gives no such promise once a task is re-run on another executor)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """``"p0:p1:..."`` as a string column (each part a Column or literal)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def md5_u32(key: Column) -> Column:
    """First 8 hex digits of md5(key) as an integer in [0, 2^32)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
