"""Counter-based random draws.

A draw is a function of (seed, stream name, counters) only, so results do not depend on how
rows are partitioned or on retried tasks, and another engine can reproduce them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def uniform(seed: int, stream: str, *counters: Column) -> Column:
    """Uniform on (0, 1) from the first 32 bits of an md5 digest."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[c.cast("string") for c in counters])
    bits = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / TWO32


def normal(seed: int, stream: str, *counters: Column) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    u1 = uniform(seed, stream + ":r", *counters)
    u2 = uniform(seed, stream + ":a", *counters)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def pick(seed: int, stream: str, n: Column, *counters: Column) -> Column:
    """Integer in [0, n)."""
    return F.floor(uniform(seed, stream, *counters) * n).cast("int")
