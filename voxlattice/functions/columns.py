"""Column expressions that the operators share. All are built-in functions: they stay inside whole-stage code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between low and high; null stays null (least and greatest alone would turn it into a bound)."""
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-9)))


def erb(hertz: Column) -> Column:
    return 21.4 * F.log10(1 + 0.00437 * hertz)


def erb_to_hertz(erbs: Column) -> Column:
    return (F.pow(F.lit(10.0), erbs / 21.4) - 1) / 0.00437


def _guarded(numerator: Column, square: Column, least: float) -> Column:
    return F.coalesce(F.try_divide(numerator, F.when(square > least, F.sqrt(square))), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: the correlation, 0 without variance or rows."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))), F.lit(0.0))


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.avg((x - y) * (x - y)))


def mae(x: Column, y: Column) -> Column:
    return F.avg(F.abs(x - y))


def bias(x: Column, y: Column) -> Column:
    return F.avg(x - y)


def average_rank(value: str, by: WindowSpec, same: WindowSpec) -> Column:
    """1-based rank, ties at their mean. by: partition ordered by the value; same: partition that holds its ties."""
    return F.rank().over(by) + (F.count(value).over(same) - 1) / F.lit(2.0)


def quantile_floor(values: Column, q: float) -> Column:
    """The element at floor(q (n - 1)) of the sorted array; 0 for an empty one."""
    at = F.floor(F.lit(q) * (F.size(values) - 1)).cast("int")
    return F.when(F.size(values) > 0, F.get(F.array_sort(values), at)).otherwise(F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once a row: what a lambda names is computed again for each element."""
    return F.transform(F.array(x), use)[0]


def cosine(a: Column, b: Column) -> Column:
    """Between 0 and 1; 0 without energy."""
    sums = F.struct(dot(a, b).alias("xy"), (dot(a, a) * dot(b, b)).alias("square"))
    return bound(sums, lambda s: clamp(_guarded(s["xy"], s["square"], 0.0)))


def centred(a: Column) -> Column:
    return bound(mean(a), lambda m: F.transform(a, lambda x: x - m))


def array_pearson(a: Column, b: Column) -> Column:
    """Of two arrays of equal length; 0 below a variance of 1e-12."""

    def of(c: Column) -> Column:
        sums = F.struct(dot(c["a"], c["b"]).alias("xy"), dot(c["a"], c["a"]).alias("xx"), dot(c["b"], c["b"]).alias("yy"))
        return bound(sums, lambda s: clamp(F.when((s["xx"] < 1e-12) | (s["yy"] < 1e-12), 0.0).otherwise(_guarded(s["xy"], s["xx"] * s["yy"], 0.0)), -1, 1))

    return bound(F.struct(centred(a).alias("a"), centred(b).alias("b")), of)


def slope(values: Column) -> Column:
    """Least-squares slope of ln(v + 1e-12) on ln(1 + i)."""
    y = F.transform(values, lambda v: F.ln(v + 1e-12))
    x = F.transform(values, lambda v, i: F.log1p(i.cast("double")))
    fit = lambda c: F.coalesce(F.try_divide(dot(c["x"], c["y"]), F.nullif(dot(c["x"], c["x"]), F.lit(0.0))), F.lit(0.0))
    return bound(F.struct(centred(x).alias("x"), centred(y).alias("y")), fit)


def draw(n: Column, *key: Column) -> Column:
    """A whole number below n from md5 of the key: the same in any engine, and no stride of the rows."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *key)), 1, 8), 16, 10).cast("long") % n
