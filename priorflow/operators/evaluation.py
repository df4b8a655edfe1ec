"""Metrics of point and probability forecasts by any segmentation, in one plan each.

Nested loops over folds, variants, windows and segments become rows: predictions are
unpivoted, segments exploded, and one grouping computes all metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import PROBABILITY_LABELS, equal_bin, equal_bin_right, probability_bucket_index


def unpivot_predictions(df: DataFrame, ids: Sequence[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each prediction column: (variant, window, pred)."""
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(w).alias("window"), F.col(c).cast("double").alias("pred")) for c, (v, w) in columns.items()])
    return df.select(*ids, F.explode(rows).alias("_p")).select(*ids, "_p.*")


def flatten(df: DataFrame, structs: Sequence[str]) -> DataFrame:
    """Struct columns as columns of their own, named ``struct_field``."""
    flat = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in structs for f in df.schema[s].dataType.names]
    return df.select(*[c for c in df.columns if c not in structs], *flat)


def prediction_columns(prefix: str, variants: dict[str, Sequence[str]]) -> dict[str, tuple[str, str]]:
    """Column name to (variant, window) for every variant and its windows."""
    return {f"{prefix}_{v}_{w}": (v, w) for v, windows in variants.items() for w in windows}


def split_approach(name: Column, variants: Sequence[str]) -> Column:
    """variant and window of 'variant_window', the longest variant first; fails on others."""
    pattern = f"^({'|'.join(sorted(variants, key=len, reverse=True))})_(.*)$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("variant"), F.regexp_extract(name, pattern, 2).alias("window"))).when(
        name.isNotNull(), F.raise_error(F.concat(F.lit("unknown approach: "), name)).cast("struct<variant:string,window:string>")
    )


def segments(df: DataFrame, by: dict[str, Column], only: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Each row once as overall and once for each segmentation it has a value in."""
    parts = [F.struct(F.lit("overall").alias("segment_type"), F.lit("overall").alias("segment_value"))]
    for name, value in by.items():
        inside = value.isNotNull() if not only or name not in only else value.isin(*only[name])
        parts.append(F.when(inside, F.struct(F.lit(name).alias("segment_type"), value.cast("string").alias("segment_value"))))
    return df.withColumn("_s", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull()))).select("*", "_s.*").drop("_s")


def numeric_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """n, mae, rmse, bias, corr, means and population variances of complete pairs; NULLs if there are none."""
    both = F.col(actual).isNotNull() & F.col(pred).isNotNull() & ~F.isnan(F.col(actual).cast("double")) & ~F.isnan(F.col(pred).cast("double"))
    y, p = F.when(both, F.col(actual).cast("double")), F.when(both, F.col(pred).cast("double"))
    e = p - y
    varied = (F.count(y) >= 2) & (F.var_pop(y) > 0) & (F.var_pop(p) > 0)
    return df.groupBy(*by).agg(
        F.count(y).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
        F.when(varied, F.corr(y, p)).alias("corr"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_pred"),
        F.var_pop(y).alias("var_actual"),
        F.var_pop(p).alias("var_pred"),
    )


def overdispersion(df: DataFrame, by: Sequence[str], value: str, limit: float = 1.15) -> DataFrame:
    x = F.col(value).cast("double")
    ratio = F.when(F.avg(x) > 0, F.var_pop(x) / F.avg(x))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), ratio.alias("ratio"), (ratio > limit).alias("overdispersed"))


def probability_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", eps: float = 1e-6, clip_brier: bool = True) -> DataFrame:
    """n, brier, log_loss of complete pairs.

    Baseline evaluation clips by 1e-6 for both; forward evaluation clips by 1e-9 and only for
    the log loss (``clip_brier=False``).
    """
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    t, raw = F.when(both, F.col(y).cast("double")), F.when(both, F.col(p).cast("double"))
    q = F.least(F.greatest(raw, F.lit(eps)), F.lit(1 - eps))
    b = q if clip_brier else raw
    return df.groupBy(*by).agg(F.count(t).alias("n"), F.avg((b - t) * (b - t)).alias("brier"), F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"))


def calibration_curve(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", bins: int = 10, right_closed: bool = False) -> DataFrame:
    """(bin, n, pred_mean, actual_rate) with all bins of each group; empty ones have n = 0."""
    cut = (equal_bin_right if right_closed else equal_bin)(F.col(p), bins)
    have = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, cut.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"), F.avg(F.col(y).cast("double")).alias("actual_rate"))
    if not by:
        frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        return frame.join(have, "bin", "left").fillna(0, ["n"])
    packed = have.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "pred_mean", "actual_rate").alias("v")))).alias("_m"))
    full = packed.select(*by, "_m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    v = F.try_element_at("_m", F.col("bin"))
    return full.select(*by, "bin", F.coalesce(v["n"], F.lit(0)).alias("n"), v["pred_mean"].alias("pred_mean"), v["actual_rate"].alias("actual_rate"))


def calibration_error(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", bins: int = 10, least: int = 20) -> DataFrame:
    """Expected calibration error; NULL for groups with fewer than ``least`` pairs."""
    have = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, equal_bin(F.col(p), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("a"), F.avg(F.col(y).cast("double")).alias("b"))
    return have.groupBy(*by).agg(F.sum("n").alias("n"), F.when(F.sum("n") >= least, F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", least: int = 100) -> DataFrame:
    """The nine fixed probability buckets that have rows, with a small-sample mark."""
    k = probability_bucket_index(F.col(p))
    names = F.array(*[F.lit(x) for x in PROBABILITY_LABELS])
    out = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, k.alias("bucket_idx")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"), F.avg(F.col(y).cast("double")).alias("actual_rate"))
    return out.select(*by, "bucket_idx", names[F.col("bucket_idx")].alias("bucket"), "n", "pred_mean", "actual_rate", (F.col("n") < least).alias("small_sample"))


def grouping_metrics(df: DataFrame, dimensions: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Overall and by each dimension alone: (dimension, value, ...) by grouping sets."""
    sets = [[]] + [[F.col(d)] for d in dimensions]
    rows = df.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(*aggregates, *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    which, value = F.lit("overall"), F.lit("overall")
    for d in dimensions:
        which, value = F.when(F.col(f"_g_{d}") == 0, d).otherwise(which), F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    keep = [c for c in rows.columns if c not in dimensions and not c.startswith("_g_")]
    return rows.select(which.alias("dimension"), value.alias("value"), *keep)


def winrate(df: DataFrame, by: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """Squared errors of two forecasts, how often b wins, and margins when it wins or loses."""
    ea, eb = F.pow(F.col(a) - F.col(y).cast("double"), F.lit(2)), F.pow(F.col(b) - F.col(y).cast("double"), F.lit(2))
    gain = ea - eb
    return df.filter(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ea).alias("brier_a"), F.avg(eb).alias("brier_b"), (100 * F.avg((gain > 0).cast("double"))).alias("win_pct_b"),
        F.avg(F.when(gain > 0, gain)).alias("mean_gain"), F.avg(F.when(gain < 0, -gain)).alias("mean_loss"), F.sum(gain).alias("net"),
    )


def summary_over_folds(df: DataFrame, group: Sequence[str], variant: Sequence[str], error: str = "error") -> DataFrame:
    """Mean, sample deviation and number of folds per variant, and the best variant of each group."""
    out = df.groupBy(*group, *variant).agg(F.avg(error).alias("mean_error"), F.stddev_samp(error).alias("std_error"), F.count(error).alias("n_folds"))
    nth = F.row_number().over(W.partitionBy(*group).orderBy(F.col("mean_error").asc_nulls_last(), *variant))
    return out.withColumn("is_best", nth == 1)


def temporal_robustness(df: DataFrame, group: Sequence[str], variant: Sequence[str], naive: str, fold: str = "fold", error: str = "error", n: str = "n", strong: float = 0.01, coverage: int = 300) -> DataFrame:
    """How each variant does against the naive one of its group in every fold."""
    base = df.filter(F.col(variant[0]) == naive).groupBy(*group, fold).agg(F.min(error).alias("naive_error"))
    rel = (F.col("naive_error") - F.col(error)) / F.col("naive_error")
    joined = df.filter(F.col(variant[0]) != naive).join(base, [*group, fold]).withColumn("rel", rel)
    return joined.groupBy(*group, *variant).agg(
        F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col(error) < F.col("naive_error")).alias("wins"), F.count_if((F.col(error) < F.col("naive_error")) & (F.col("rel") >= strong)).alias("strong_wins"),
        F.avg("rel").alias("mean_delta_rel"), F.stddev_pop("rel").alias("std_delta_rel"), F.min("rel").alias("min_delta_rel"), F.max("rel").alias("max_delta_rel"),
        F.bool_and(F.col(n) >= coverage).alias("coverage_ok_all_folds"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(fold), F.col("rel"))))).alias("rel_by_fold"),
    )


def surface_robustness(df: DataFrame, group: Sequence[str], variant: Sequence[str], naive: str, surface: str, error: str = "error", n: str = "n", least: int = 150, worst: float = 0.10) -> DataFrame:
    """Mean error against naive on each surface, and a mark where it is worse on enough rows."""
    base = df.filter(F.col(variant[0]) == naive).groupBy(*group, surface).agg(F.avg(error).alias("naive_error"))
    own = df.filter(F.col(variant[0]) != naive).groupBy(*group, *variant, surface).agg(F.avg(error).alias("model_error"), F.sum(n).alias("n_total"))
    bad = (F.col("n_total") >= least) & (F.col("model_error") > F.col("naive_error") * (1 + worst))
    return own.join(base, [*group, surface]).withColumn("deterioration_flagged", F.coalesce(bad, F.lit(False)))


def best_approach(df: DataFrame, group: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Most wins, then largest mean gain, then least deviation."""
    w = W.partitionBy(*group).orderBy(F.desc("wins"), F.desc("mean_delta_rel"), F.asc("std_delta_rel"), *tie)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def window_robustness(df: DataFrame, group: Sequence[str], window: str, fold: str, surface: str, error: str = "error") -> DataFrame:
    """Mean and deviation of the error across folds and across surfaces, ranked by their sum of ranks."""
    from .windows import ranks_sum

    by_fold = df.groupBy(*group, window, fold).agg(F.avg(error).alias("e")).groupBy(*group, window).agg(F.avg("e").alias("mean_error"), F.stddev_pop("e").alias("std_folds"))
    by_surface = df.groupBy(*group, window, surface).agg(F.avg(error).alias("e")).groupBy(*group, window).agg(F.stddev_pop("e").alias("std_surfaces"))
    return ranks_sum(by_fold.join(by_surface, [*group, window]), group, ["mean_error", "std_folds", "std_surfaces"])


def threshold_comparison(df: DataFrame, rank: str, thresholds: Sequence[int], won: str, p: str, pnl: str) -> DataFrame:
    """Cumulative groups rank >= threshold: n, win rate, Brier and ROI over all resolved rows."""
    rows = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter(F.col(rank) >= F.col("threshold"))
    y = F.col(won).cast("double")
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("win_rate"), F.avg(F.pow(F.col(p) - y, F.lit(2))).alias("brier"), (F.sum(pnl) / F.count(pnl)).alias("roi"))


def checkpoints(n: DataFrame, count: str, levels: Sequence[int] = (25, 50, 100, 250, 500)) -> DataFrame:
    return n.withColumn("checkpoint", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("reached", F.col(count) >= F.col("checkpoint"))
