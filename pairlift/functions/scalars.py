"""Column expressions: keys, p-value transforms, cell parsing, portable hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Smallest positive double: the floor used before a logarithm.
TINY = 4.9e-324


def composite_key(cols: Sequence[str | Column], sep: str = "-") -> Column:
    """Chosen columns joined into one text key."""
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def column_at(df: DataFrame, position: int) -> Column:
    """Column by 1-based position."""
    if not 1 <= position <= len(df.columns):
        raise ValueError(f"column {position} is outside 1..{len(df.columns)}")
    return F.col(f"`{df.columns[position - 1]}`")


def neg_log10(p: Column) -> Column:
    """-log10(p); p = 0 becomes the largest finite value instead of NULL."""
    return -F.log10(F.greatest(p, F.lit(TINY)))


def from_neg_log10(v: Column) -> Column:
    return F.pow(F.lit(10.0), -v)


def number_or_null(text: Column) -> Column:
    """Text to double: NA, NaN and anything that is no number become NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def hash_u32(key: Column, seed: int) -> Column:
    """A number in [0, 2**32) that depends on the key and seed only.

    It is taken from an MD5 digest, so it does not change with partitioning, Spark
    version or engine, and a split can be reproduced outside Spark.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_unit(key: Column, seed: int) -> Column:
    return hash_u32(key, seed) / F.lit(4294967296.0)


def _halves(x):
    """Upper and lower part of a double, 26 bits each."""
    c = x * 134217729.0
    high = c - (c - x)
    return high, x - high


def fixed_decimals(x: Column, digits: int) -> Column:
    """Round a double the way fixed-decimal printing does: by its exact binary value, ties to even.

    F.round works on the shortest decimal text and rounds 0.071875 up although the double
    lies below it. The rounding error of x * 10^digits is computed exactly and decides
    where the product itself looks like a tie.
    """
    scale = 10.0**digits
    scale_high, scale_low = _halves(scale)
    product = x * scale
    high, low = _halves(x)
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    base = F.floor(product)
    rest = product - base
    up = (
        (rest > 0.5)
        | ((rest == 0.5) & (error > 0))
        | ((rest == 0.5) & (error == 0) & (F.pmod(base, F.lit(2)) == 1))
    )
    return (base + F.when(up, 1).otherwise(0)) / F.lit(scale)
