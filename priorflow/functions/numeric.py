"""Null-safe numbers, prices and buckets as column expressions.

Absent is NULL, never 0 and never NaN. All prices are doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Required edges (fixed values): label, required edge, status when reached.
EDGE_LEVELS = [
    ("2pct", 0.02, "ATINGE_EDGE_2"),
    ("3pct", 0.03, "ATINGE_EDGE_3"),
    ("5pct", 0.05, "ATINGE_EDGE_5"),
    ("7_5pct", 0.075, "ATINGE_EDGE_7_5"),
    ("10pct", 0.10, "ATINGE_EDGE_10"),
]
BELOW = "ABAIXO_DO_LIMITE"
#: Half-open integer ranges (fixed values): first, last, label.
SAMPLE_SIZE_BUCKETS = [(0, 0, "cold_start"), (1, 9, "small_1_9"), (10, 49, "medium_10_49"), (50, None, "large_50_plus")]
RANKING_BUCKETS = [(1, 50, "top50"), (51, 100, "top51_100"), (101, 300, "top101_300"), (301, None, "outside_300")]
#: Probability buckets (fixed values): edges and labels, left-closed.
PROBABILITY_EDGES = [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
PROBABILITY_LABELS = ["<20%", "20-30%", "30-40%", "40-50%", "50-60%", "60-70%", "70-80%", "80-90%", "90%+"]
EXTREME_PROBABILITY = 0.90


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` where ``den > 0``, else NULL."""
    return F.when(den > 0, num / den)


def float_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as floating point has it: by 0 infinite, with its sign, and 0 by 0 NaN. NULL in, NULL out."""
    zero = F.when(den.cast("string") == "-0.0", float("-inf")).otherwise(float("inf"))
    return F.when(den != 0, num / den).when(den == 0, num * zero)


def round_scaled(x: Column, n: int) -> Column:
    """``x`` at ``n`` places as the SQL has it: scaled, halves away from zero, scaled back, with its sign.

    Spark's own ``round`` goes by the printed digits, so a product that ends in a half by its
    last bit may end one place lower. What is too large to be scaled stays as it is.
    """
    whole = F.round(x * F.lit(10.0**n), 0)
    out = F.when(whole == 0, x * F.lit(0.0)).otherwise(whole / F.lit(10.0**n))
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def no_nan(x: Column) -> Column:
    """NaN becomes NULL; used where floats enter or leave."""
    return F.when(~F.isnan(x), x)


def nan_mean(a: Column, b: Column) -> Column:
    """Mean of those of two that are there."""
    return F.coalesce((a + b) / 2, a, b)


def values_equal(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Both absent, or within a tolerance."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def fair_odds(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), 1 / p)


def minimum_odds(p: Column, required_edge: Column | float) -> Column:
    left = p - (F.lit(required_edge) if isinstance(required_edge, float) else required_edge)
    return F.when(left > 0, 1 / left)


def implied_probability(odds: Column) -> Column:
    return F.when(odds > 1, 1 / odds)


def edge(p: Column, implied: Column) -> Column:
    return p - implied


def overround(over_odds: Column, under_odds: Column) -> Column:
    """Struct overround, novig_over, novig_under; all NULL unless both sides are priced."""
    a, b = implied_probability(over_odds), implied_probability(under_odds)
    return F.struct((a + b - 1).alias("overround"), (a / (a + b)).alias("novig_over"), (b / (a + b)).alias("novig_under"))


def edge_status(p: Column, odds: Column) -> Column:
    """The highest edge level whose minimum odds the price reaches."""
    out = None
    for _, level, status in reversed(EDGE_LEVELS):
        reached = odds >= minimum_odds(p, level)
        out = F.when(reached, status) if out is None else out.when(reached, status)
    return F.when(p.isNull() | odds.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(BELOW))


def pnl_units(settlement: Column, odds: Column, stake: Column | float = 1.0) -> Column:
    stake = F.lit(stake) if isinstance(stake, float) else stake
    return F.when(settlement == "WIN", (odds - 1) * stake).when(settlement == "LOSS", -stake).when(settlement == "VOID", F.lit(0.0))


def closing_line_value(used: Column, closing: Column) -> Column:
    """Struct clv_pct, prob_diff of the price used against the closing price; prices of 0 divide as floats do."""
    one = F.lit(1.0)
    return F.struct(((float_ratio(used, closing) - 1) * 100).alias("clv_pct"), (float_ratio(one, closing) - float_ratio(one, used)).alias("prob_diff"))


def range_bucket(x: Column, ranges: Sequence[tuple[int, int | None, str]]) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in reversed(ranges):
        inside = (x >= low) if high is None else x.between(low, high)
        out = F.when(inside, label).otherwise(out)
    return out


def sample_size_bucket(n: Column) -> Column:
    return range_bucket(n, SAMPLE_SIZE_BUCKETS)


def ranking_bucket(rank: Column) -> Column:
    return range_bucket(rank, RANKING_BUCKETS)


def probability_bucket(p: Column) -> Column:
    """Left-closed buckets by literal comparison."""
    out = F.lit(PROBABILITY_LABELS[0])
    for low, label in zip(PROBABILITY_EDGES[1:-1], PROBABILITY_LABELS[1:]):
        out = F.when(p >= low, label).otherwise(out)
    return F.when(p.isNotNull(), out)


def probability_bucket_index(p: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(PROBABILITY_EDGES[1:-1], 1):
        out = F.when(p >= low, k).otherwise(out)
    return F.when(p.isNotNull(), out)


def equal_bin(p: Column, n: int = 10) -> Column:
    """Left-closed equal bins on [0, 1]; 1.0 falls in the last."""
    out = F.lit(0)
    for k in range(1, n):
        out = F.when(p >= k / n, k).otherwise(out)
    return F.when(p.isNotNull(), out)


def equal_bin_right(p: Column, n: int = 10) -> Column:
    """Right-closed equal bins on [0, 1]; 0.0 falls in the first."""
    out = F.lit(n - 1)
    for k in range(n - 2, -1, -1):
        out = F.when(p <= (k + 1) / n, k).otherwise(out)
    return F.when((p >= 0) & (p <= 1), out)


def quality_flags(sample_bucket: Column, method: Column, train_n: Column, p: Column, min_train_n: int = 500) -> list[Column]:
    """cold_start, insufficient_history, calibrator_insufficient_sample, extreme_probability."""
    false = F.lit(False)
    return [
        F.coalesce(sample_bucket == "cold_start", false).alias("cold_start"),
        F.coalesce(sample_bucket.isin("cold_start", "small_1_9"), false).alias("insufficient_history"),
        F.coalesce(~method.isin("raw", "raw_sem_periodo_anterior") & (train_n < min_train_n), false).alias("calibrator_insufficient_sample"),
        F.coalesce(p >= EXTREME_PROBABILITY, false).alias("extreme_probability"),
    ]


def restricted_flag(segments: Sequence[dict[str, str]], columns: dict[str, Column]) -> list[Column]:
    """restricted, restricted_reason: the first segment whose named columns all match."""
    hit, reason = F.lit(False), F.lit(None).cast("string")
    for segment in reversed(segments):
        here = F.lit(True)
        for name, value in segment.items():
            if name != "reason":
                here = here & F.coalesce(columns[name] == value, F.lit(False))
        hit, reason = here | hit, F.when(here, segment["reason"]).otherwise(reason)
    return [hit.alias("restricted"), reason.alias("restricted_reason")]


def label_odds(labels: Column, odds: Sequence[tuple[str, Column]]) -> Column:
    """The odds column that a label names."""
    pairs = [x for label, column in odds for x in (F.lit(label), column)]
    return F.try_element_at(F.create_map(*pairs), labels)
