"""Poisson and negative-binomial tails and quantiles as native expressions.

The probability of each count follows from the one before it, so one ``aggregate`` over a
sequence sums them; terms run in logs, so large means don't underflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line grids (fixed values): quantiles and the largest number of lines.
LOW_Q, HIGH_Q, MAX_LINES = 0.01, 0.99, 14


def _cdf(lam: Column, r: Column, k: Column) -> Column:
    """P(X <= k), k >= 0; Poisson where r is NULL."""
    nb = r.isNotNull()
    first = F.when(nb, r * (F.log(r) - F.log(r + lam))).otherwise(-lam)
    step = lambda i: F.when(nb, F.log((i + r) / (i + 1)) + F.log(lam / (r + lam))).otherwise(F.log(lam / (i + 1)))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))
    counts = F.when(k >= 1, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(counts, start, lambda acc, i: F.struct((acc["log"] + step(i)).alias("log"), (acc["sum"] + F.exp(acc["log"] + step(i))).alias("sum")), lambda acc: F.least(acc["sum"], F.lit(1.0)))


def over_probability(lam: Column, r: Column | None, line: Column) -> Column:
    """P(X > line); Poisson if ``r`` is None or NULL. NULL unless lam > 0."""
    r = F.lit(None).cast("double") if r is None else r
    return F.when(lam > 0, F.greatest(1 - _cdf(lam.cast("double"), r, F.floor(line)), F.lit(0.0)))


def moments_r(mean: Column, variance: Column) -> Column:
    """Dispersion by moments; NULL unless the (population) variance exceeds the mean."""
    return F.when(variance > mean, mean * mean / (variance - mean))


def independent_sum_r(la: Column, ra: Column, lb: Column, rb: Column) -> Column:
    """Dispersion of a sum of independent counts; a side without its own is Poisson."""
    extra = lambda lam, r: F.coalesce(F.when(r > 0, lam * lam / r), F.lit(0.0))
    total, over = la + lb, extra(la, ra) + extra(lb, rb)
    return F.when(over > 0, total * total / over)


def quantile(lam: Column, r: Column | None, q: float) -> Column:
    """The least k with P(X <= k) >= q, searched up to the mean and 12 deviations more."""
    r = F.lit(None).cast("double") if r is None else r
    nb = r.isNotNull()
    deviation = F.sqrt(F.when(nb, lam + lam * lam / r).otherwise(lam))
    top = F.ceil(lam + 12 * deviation + 20).cast("int")
    first = F.when(nb, r * (F.log(r) - F.log(r + lam))).otherwise(-lam)
    step = lambda i: F.when(nb, F.log((i + r) / (i + 1)) + F.log(lam / (r + lam))).otherwise(F.log(lam / (i + 1)))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"), F.lit(0).alias("k"))
    walk = lambda acc, i: F.when(acc["sum"] >= q, acc).otherwise(F.struct((acc["log"] + step(i)).alias("log"), (acc["sum"] + F.exp(acc["log"] + step(i))).alias("sum"), (acc["k"] + 1).alias("k")))
    return F.when(lam > 0, F.aggregate(F.sequence(F.lit(0), top), start, walk, lambda acc: acc["k"]))


def _quantiles(lam: Column, r: Column, low: float, high: float) -> Column:
    """Struct low, high: both quantiles in one pass, each the number of counts whose sum is still below it."""
    nb = r.isNotNull()
    top = F.ceil(lam + 12 * F.sqrt(F.when(nb, lam + lam * lam / r).otherwise(lam)) + 20).cast("int")
    first = F.when(nb, r * (F.log(r) - F.log(r + lam))).otherwise(-lam)
    rate = F.log(lam / F.when(nb, r + lam).otherwise(1.0))
    start = F.struct(first.alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).alias("low"), F.lit(-1).alias("high"), rate.alias("rate"), r.alias("r"))
    walk = lambda acc, i: F.struct(
        (acc["log"] + acc["rate"] + F.log(F.coalesce(acc["r"] + i, F.lit(1.0)) / (i + 1))).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"),
        (acc["low"] + (acc["sum"] < low).cast("int")).alias("low"), (acc["high"] + (acc["sum"] < high).cast("int")).alias("high"), acc["rate"].alias("rate"), acc["r"].alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(0), top), start, walk, lambda acc: F.struct(acc["low"].alias("low"), acc["high"].alias("high")))


def line_grid(mean: Column, r: Column | None) -> Column:
    """Half lines from the 1 % to the 99 % quantile and one more, trimmed at both ends to 14."""
    r = F.lit(None).cast("double") if r is None else r
    # an array of one, so that the pass is made once and not for each use
    both = F.array(_quantiles(mean.cast("double"), r.cast("double"), LOW_Q, HIGH_Q))
    return F.when(mean > 0, F.transform(both, _lines)[0]).otherwise(F.array().cast("array<double>"))


def _lines(q: Column) -> Column:
    low, high = F.greatest(q["low"] - 1, F.lit(0)), q["high"] + 1
    lines = F.transform(F.sequence(low, high - 1), lambda x: x + 0.5)
    excess = F.greatest(F.size(lines) - MAX_LINES, F.lit(0))
    return F.slice(lines, F.floor(excess / 2).cast("int") + 1, F.least(F.size(lines), F.lit(MAX_LINES))).cast("array<double>")


def line_difficulty(line: Column, lam: Column, r: Column | None) -> Column:
    """Where a line lies from the mean, in deviations: below -1, to 1, above."""
    variance = lam if r is None else F.when(r.isNotNull(), lam + lam * lam / r).otherwise(lam)
    z = (line - lam) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
    return F.when(z < -1, "muito_abaixo_da_media").when(z < 1, "proxima_da_media").when(z.isNotNull(), "muito_acima_da_media")
