"""Unit scaling, rounding, percent and rate text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MB/s per unit of a summary line. The binary figures are the
# rounded ones the published tables were made with.
MB_PER_UNIT = {
    "B": 1e-6,
    "KB": 1e-3,
    "kB": 1e-3,
    "MB": 1.0,
    "GB": 1e3,
    "KiB": 1.024e-3,
    "MiB": 1.04858,
    "GiB": 1073.74,
}

# Divisors of the plain unit changes.
DIVISORS = {
    "bytes_to_mb": 1e6,
    "ns_to_us": 1000.0,
    "ms_to_s": 1000.0,
    "kib_to_mib": 1024.0,
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scale(col: Column | str, change: str) -> Column:
    """Change of unit; ``kb_to_mib`` is integer division."""
    if change == "kb_to_mib":
        return bin_of(col, 1024)
    return _c(col) / F.lit(DIVISORS[change])


def to_mb_per_s(value: Column | str, unit: Column | str) -> Column:
    """Rate in MB/s from a figure and its unit; an unknown unit counts as MB."""
    table = F.create_map(*[F.lit(x) for pair in MB_PER_UNIT.items() for x in pair])
    return _c(value) * F.coalesce(F.try_element_at(table, _c(unit)), F.lit(1.0))


def round_half_up(col: Column | str) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.round(_c(col)).cast("bigint")


def measure_or_zero(col: Column | str) -> Column:
    """A measure that a result file does not have counts as 0."""
    return F.coalesce(_c(col), F.lit(0))


def bw_mbs(bw_bytes: Column | str) -> Column:
    return round_half_up(scale(measure_or_zero(bw_bytes), "bytes_to_mb"))


def iops(col: Column | str) -> Column:
    return round_half_up(measure_or_zero(col))


def percentile_of(percentiles: Column | str, key: str = "99.000000") -> Column:
    """One reported latency percentile, null where the result lacks it.

    Percentiles of several files must not be averaged; take minimum and
    maximum across files instead.
    """
    return F.try_element_at(_c(percentiles), F.lit(key))


def latency_us(percentiles: Column | str, key: str = "99.000000") -> Column:
    return round_half_up(scale(measure_or_zero(percentile_of(percentiles, key)), "ns_to_us"))


def pct_of(actual: Column | str, target: Column | str) -> Column:
    """Whole percent of a target, cut off and not rounded; null if target is 0."""
    ratio = F.try_divide(_c(actual).cast("double"), _c(target).cast("double"))
    return (ratio * F.lit(100)).cast("bigint")


def pct_text(pct: Column | str) -> Column:
    return F.coalesce(F.concat(_c(pct).cast("string"), F.lit("%")), F.lit("—"))


def fmt_rate(col: Column | str) -> Column:
    """``-`` for a missing rate, GB/s from 1000 MB/s up, MB/s below."""
    c = _c(col)
    return (
        F.when(c.isNull(), F.lit("-"))
        .when(c >= 1000, F.format_string("%.2f GB/s", c / 1000))
        .otherwise(F.format_string("%.0f MB/s", c))
    )


def size_bytes(col: Column | str) -> Column:
    """Bytes of a size such as ``128g`` or ``4k`` (powers of 1024)."""
    text = F.lower(F.trim(_c(col)))
    number = F.regexp_extract(text, r"^([0-9]+)\s*([kmgt]?)i?b?$", 1).try_cast("bigint")
    suffix = F.regexp_extract(text, r"^([0-9]+)\s*([kmgt]?)i?b?$", 2)
    factor = (
        F.when(suffix == "k", F.lit(1024))
        .when(suffix == "m", F.lit(1024**2))
        .when(suffix == "g", F.lit(1024**3))
        .when(suffix == "t", F.lit(1024**4))
        .otherwise(F.lit(1))
    )
    return number * factor.cast("bigint")


def whole_units(col: Column | str, decimals: int) -> Column:
    """A measurement with a fixed number of decimals as a whole number."""
    return F.rint(finite(col) * F.lit(float(10**decimals))).cast("bigint")


def finite(col: Column | str) -> Column:
    """A figure as a double; what is not a number (a word such as ``nan`` or ``inf`` in a log) is missing."""
    v = _c(col).cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def unit_sum(col: Column | str, decimals: int) -> Column:
    """Sum of whole units as a decimal, which can be added up further.

    The number is added in two parts, because one part could pass the range of
    a bigint on very many rows; a decimal sum would be several times slower.
    """
    units = whole_units(col, decimals)
    high = F.sum(F.shiftright(units, 20)).cast("decimal(38,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(38,0)")
    return (high * F.lit(1 << 20) + low).cast("decimal(38,0)")


def part_sum(col: Column | str, decimals: int | None = None) -> Column:
    """A sum that is added up further with ``F.sum`` and read with ``of_units``."""
    return F.sum(finite(col)) if decimals is None else unit_sum(col, decimals)


def of_units(col: Column | str, decimals: int | None = None) -> Column:
    return _c(col).cast("double") / F.lit(float(10 ** (decimals or 0)))


def exact_sum(col: Column | str, decimals: int | None = None) -> Column:
    """Sum; with ``decimals`` one whose value does not depend on the order rows arrive in.

    Only a caller that knows its measurements to have a fixed number of decimals
    passes it: digits beyond would be lost. Whole numbers are then added and
    turned into a double once. Without ``decimals`` doubles are added. A figure
    that is not a number counts as missing.
    """
    return F.sum(finite(col)) if decimals is None else of_units(unit_sum(col, decimals), decimals)


def epoch_us(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def bin_of(value: Column | str, width: int) -> Column:
    """Whole-number bin of ``width``, also right below zero."""
    v = _c(value).cast("bigint")
    return F.call_function("div", v - F.pmod(v, F.lit(width).cast("bigint")), F.lit(width).cast("bigint"))
