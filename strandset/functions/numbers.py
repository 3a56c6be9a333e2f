"""Numbers of the metrics report, as columns and as plain functions."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The report's bisection steps and the largest bin with a coverage multiple.
BISECTIONS, LAST_BIN = 40, 100
LARGEST = 1e12


def percent_duplication(unpaired: Column, pairs: Column, unpaired_dups: Column, pair_dups: Column) -> Column:
    examined = unpaired + 2 * pairs
    return F.when(examined == 0, F.lit(0.0)).otherwise((unpaired_dups + 2 * pair_dups).cast("double") / examined)


def excess(x: Column, pairs: Column, unique: Column) -> Column:
    """Positive while the library would be larger than x times its unique pairs."""
    return 1 / x - 1 + F.exp(-pairs / (x * unique))


def library_size(pairs: Column, dups: Column) -> Column:
    """Unique molecules in a library of which `pairs` were seen, `dups` of them again; null where that has no answer."""
    n, unique = pairs.cast("double"), (pairs - dups).cast("double")
    powers = F.transform(F.sequence(F.lit(2), F.lit(12)), lambda i: F.pow(F.lit(10.0), i))
    high = F.get(F.filter(powers, lambda x: ~(excess(x, n, unique) > 0)), F.lit(0))  # null: past LARGEST

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        above = excess(middle, n, unique)
        return F.struct(F.when(above >= 0, middle).otherwise(state["low"]).alias("low"), F.when(above <= 0, middle).otherwise(state["high"]).alias("high"))

    start = F.struct(F.lit(1.0).alias("low"), high.alias("high"))
    estimate = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda s: F.floor(unique * (s["low"] + s["high"]) / 2))
    return F.when((pairs > 0) & (dups > 0) & (dups < pairs) & high.isNotNull(), estimate)


def coverage_multiple(size: Column, pairs: Column, unique: Column, bin_: Column) -> Column:
    """Return on sequencing bin_ times as much."""
    return F.when((bin_ <= LAST_BIN) & (unique > 0) & (size > 0), size * (1 - F.exp(-bin_ * pairs / size)) / unique).otherwise(0.0)


def trim_float(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.6f", value), "\\.?0+$", "")


def percent_of(unpaired: int, pairs: int, unpaired_dups: int, pair_dups: int) -> float:
    examined = unpaired + 2 * pairs
    return (unpaired_dups + 2 * pair_dups) / examined if examined else 0.0


def library_size_of(pairs: int, dups: int) -> int | None:
    """library_size for plain numbers."""
    if not 0 < dups < pairs:
        return None
    unique = pairs - dups
    over = lambda x: 1 / x - 1 + math.exp(-pairs / (x * unique))
    low, high = 1.0, next((10.0**i for i in range(2, 13) if not over(10.0**i) > 0), None)
    if high is None:
        return None
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        above = over(middle)
        low, high = (middle if above >= 0 else low), (middle if above <= 0 else high)
    return math.floor(unique * (low + high) / 2)


def trimmed(value: float) -> str:
    return f"{value:.6f}".rstrip("0").rstrip(".")


def report_date(when: datetime | None = None) -> str:
    return (when or datetime.now(timezone.utc)).strftime("%a %b %d %H:%M:%S UTC %Y")
