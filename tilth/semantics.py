"""Rules that hold everywhere: missing values, right-closed bins, half-even rounding, spread, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def require_columns(df: DataFrame, *names: str | None) -> None:
    """ValueError with all names that df lacks."""
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"Column(s) not found: {', '.join(missing)}")


def number(c: Column | str) -> Column:
    """A double whose NaN is null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def holds(condition: Column) -> Column:
    """A condition whose unknown is false."""
    return F.coalesce(condition, F.lit(False))


def right_closed_bin(value: Column, width: Column | float) -> Column:
    """1 for [0, width], 2 for (width, 2 width] and so on."""
    return F.greatest(F.ceil(value / width), F.lit(1)).cast("int")


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def keyed_uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, whatever the partitioning."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
