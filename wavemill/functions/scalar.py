"""Column functions for the null, NaN and rounding rules that built-ins alone do not give."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """Text as double; what does not parse, and NaN, is null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def status(text: Column) -> Column:
    """Without white space at either end, in upper case."""
    return F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b where b is above 0, else ``otherwise``."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(otherwise))


def decibel(x: Column, factor: float = 20.0, floor: float = 1e-10) -> Column:
    return factor * F.log10(F.greatest(x, F.lit(floor)))


def wrapped(phase: Column) -> Column:
    """A phase in [-pi, pi), by floored modulo."""
    return F.pmod(phase + math.pi, F.lit(2 * math.pi)) - math.pi


def median_of(values: Column) -> Column:
    """Median of an array without nulls."""
    s = F.array_sort(values)
    n = F.size(values)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0


def shortened(text: Column, most: int = 45, keep: int = 42) -> Column:
    """Trimmed; over ``most`` characters, the first ``keep`` and three dots."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, keep), F.lit("..."))).otherwise(t)


def spaced_out(times: Column, gap: float) -> Column:
    """Of an array of doubles, ascending, those more than ``gap`` after the last one kept."""
    none = F.array().cast("array<double>")
    add = lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > gap), F.concat(kept, F.array(t))).otherwise(kept)
    return F.aggregate(F.array_sort(times), none, lambda kept, t: F.when(F.size(kept) == 0, F.array(t)).otherwise(add(kept, t)))


def mean_channels(channels: Column) -> Column:
    """Sample by sample mean of an array of equally long channels."""
    first = F.get(channels, 0)
    total = F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))), F.transform(first, lambda x: x.cast("double")), lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(channels))


def power_of_dft(samples: Column, n: int) -> Column:
    """|X_k|^2 for k = 0..n/2 of ``n`` samples, by its definition; for short frames and checks."""

    def bin_power(k: int) -> Column:
        re = F.aggregate(F.zip_with(samples, F.array(*[F.lit(math.cos(2 * math.pi * k * i / n)) for i in range(n)]), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
        im = F.aggregate(F.zip_with(samples, F.array(*[F.lit(math.sin(2 * math.pi * k * i / n)) for i in range(n)]), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
        return re * re + im * im

    return F.array(*[bin_power(k) for k in range(n // 2 + 1)])
