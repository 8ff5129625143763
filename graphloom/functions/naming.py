"""ID schemes and weight functions as Columns of a running number and a seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IDScheme = Callable[[Column], Column]
WeightFn = Callable[[int], Column]


def decimal_ids(i: Column) -> Column:
    return i.cast("string")


def symbol_ids(i: Column) -> Column:
    """A to Z; other numbers are an error."""
    ok = F.assert_true(i.between(0, 25), F.lit("symbol IDs stand for 0 to 25"))
    return F.coalesce(ok.cast("string"), F.char(F.lit(65) + i))


def alphanumeric_ids(i: Column) -> Column:
    return F.lower(F.conv(i.cast("string"), 10, 36))


def hex_ids(i: Column) -> Column:
    return F.lower(F.hex(i.cast("long")))


def excel_ids(i: Column) -> Column:
    """A..Z, AA, AB, ...: bijective base 26."""
    steps = F.sequence(F.lit(1), F.lit(14))
    start = F.struct((i.cast("long") + 1).alias("n"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        n = acc["n"] - 1
        more = F.concat(F.char(F.lit(65) + F.pmod(n, F.lit(26))), acc["s"])
        return F.struct(F.when(acc["n"] > 0, F.floor(n / 26)).otherwise(F.lit(0)).cast("long").alias("n"), F.when(acc["n"] > 0, more).otherwise(acc["s"]).alias("s"))

    return F.aggregate(steps, start, step, lambda acc: acc["s"])


def prefixed_ids(prefix: str) -> IDScheme:
    return lambda i: F.concat(F.lit(prefix), i.cast("string"))


def constant_weight(w: float = 1.0) -> WeightFn:
    if not w >= 0:
        raise ValueError("weight")
    return lambda seed: F.lit(float(w))


def uniform_weight(lo: float = 1.0, hi: float = 100.0) -> WeightFn:
    if not lo <= hi:
        raise ValueError("range")
    return lambda seed: F.lit(lo) + F.rand(seed) * (hi - lo)


def normal_weight(mean: float, stddev: float) -> WeightFn:
    """Rounded, and 0 where below."""
    if stddev < 0:
        raise ValueError("deviation")
    return lambda seed: F.greatest(F.lit(0.0), F.round(F.randn(seed) * stddev + mean))


def exponential_weight(rate: float) -> WeightFn:
    if rate <= 0:
        raise ValueError("rate")
    return lambda seed: F.round(-F.log(1 - F.rand(seed)) / rate)
