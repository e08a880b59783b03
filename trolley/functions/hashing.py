"""Engine-independent pseudo-random numbers derived from md5 of a key.

``u(parts) = int(first 8 hex digits of md5("p1:p2:..."), 16) / 2**32`` gives the same value in
Spark and in any SQL engine with md5, so sampled rows can be checked against an oracle and do
not change when a stage is retried on another executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296  # 2**32


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hash32(*parts, offset: int = 1) -> Column:
    """Unsigned 32-bit integer from 8 hex digits of md5 (digits offset..offset+7)."""
    return F.conv(F.substring(_key(*parts), offset, 8), 16, 10).cast("bigint")


def uniform(*parts, offset: int = 1) -> Column:
    """Uniform double in the open interval (0, 1)."""
    return (hash32(*parts, offset=offset) + F.lit(0.5)) / F.lit(float(TWO32))


def uniform_int(range_size: int, *parts) -> Column:
    """Uniform integer in [0, range_size) by integer arithmetic: h * range div 2**32.

    From 2**31 on, h has 56 bits (14 hex digits) and the product is an exact decimal.
    """
    if not 0 < range_size < 2 ** 63:
        raise ValueError(f"range_size must be in (0, 2^63), got {range_size}")
    if range_size < 2 ** 31:
        return F.shiftright(hash32(*parts) * F.lit(int(range_size)), 32)
    h56 = F.conv(F.substring(_key(*parts), 1, 14), 16, 10).cast("decimal(17,0)")
    product = h56 * F.lit(int(range_size)).cast("decimal(19,0)")
    return F.call_function("div", product, F.lit(2 ** 56).cast("decimal(18,0)"))


def gaussian(*parts) -> Column:
    """Standard normal by Box-Muller on two uniforms taken from one md5."""
    u1 = uniform(*parts, offset=1)
    u2 = uniform(*parts, offset=9)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# SQL text of the same functions, for oracle queries run by DuckDB.
def sql_key(*parts: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def sql_hash32(*parts: str, offset: int = 1) -> str:
    return f"(('0x' || substr({sql_key(*parts)}, {offset}, 8))::BIGINT)"


def sql_uniform(*parts: str, offset: int = 1) -> str:
    return f"(({sql_hash32(*parts, offset=offset)} + 0.5) / {float(TWO32)})"


def sql_uniform_int(range_size: str, *parts: str) -> str:
    return f"(({sql_hash32(*parts)} * ({range_size})) // {TWO32})"


def sql_gaussian(*parts: str) -> str:
    return (f"(sqrt(-2.0 * ln({sql_uniform(*parts, offset=1)})) * "
            f"cos({2.0 * math.pi!r} * {sql_uniform(*parts, offset=9)}))")
