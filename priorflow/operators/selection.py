"""Choices between models: per-surface variants, count distributions, dependence of sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import distributions as dist


def by_surface(surface: Column, special: str, there: Column, elsewhere: Column) -> Column:
    """One value on a special surface, another on the rest; NULL where the surface is."""
    return F.when(surface == special, there).when(surface != special, elsewhere)


def market_config(df: DataFrame, by: Sequence[str], actual: str, isolated: str, matchup: str, base: str, surface: str = "surface", special: str = "Grass") -> DataFrame:
    """Per market: base variant, and on the special surface the one of less mean error (base where none is known)."""
    inside = F.col(surface) == special
    error = lambda c: F.avg(F.when(inside, F.abs(F.col(c) - F.col(actual))))
    out = df.groupBy(*by).agg(F.first(base).alias("base_variant"), error(isolated).alias("mae_isolated"), error(matchup).alias("mae_matchup"), F.count(F.when(inside, F.abs(F.col(isolated) - F.col(actual)))).alias("n_special"))
    pick = F.when(F.col("mae_isolated").isNull() | F.col("mae_matchup").isNull(), F.col("base_variant")).when(F.col("mae_isolated") < F.col("mae_matchup"), "isolated").otherwise("matchup")
    return out.withColumn("special_variant", pick)


def variant_ladder(df: DataFrame, group: Sequence[str], variant: str, naive: str, order: Sequence[str], fold: str = "fold", error: str = "error", n: str = "n") -> DataFrame:
    """Each variant's relative gain over naive, by fold and on average of folds ('all_folds_mean')."""
    keep = df.filter(F.col(variant).isin(naive, *order)).groupBy(*group, variant, fold).agg(F.avg(error).alias("err"), F.sum(n).alias("n"))
    mean = keep.groupBy(*group, variant).agg(F.avg("err").alias("err"), F.sum("n").alias("n")).withColumn(fold, F.lit("all_folds_mean"))
    rows = keep.unionByName(mean)
    base = rows.filter(F.col(variant) == naive).select(*group, fold, F.col("err").alias("naive_err"))
    return rows.filter(F.col(variant) != naive).join(base, [*group, fold], "left").withColumn("delta_rel_vs_naive", (F.col("naive_err") - F.col("err")) / F.nullif("naive_err", F.lit(0.0)))


def count_market(train: DataFrame, test: DataFrame, by: Sequence[str], actual: str, pred: str) -> DataFrame:
    """Poisson and negative-binomial Brier and log loss of passing the training median.

    The median, mean, variance and dispersion come from the training rows of each group.
    """
    y = F.col(actual).cast("double")
    fit = train.groupBy(*by).agg(F.median(y).alias("threshold"), F.avg(y).alias("train_mean"), F.var_pop(y).alias("train_var"), dist.moments_r(F.avg(y), F.var_pop(y)).alias("r"))
    rows = test.join(fit, list(by)).filter(y.isNotNull() & (F.col(pred) > 0))
    lam, line, hit = F.col(pred).cast("double"), F.col("threshold"), (y > F.col("threshold")).cast("double")
    # tails are worked out once for each distinct prediction of a group, not for each row
    fixed = [*by, "threshold", "r", "train_mean", "train_var"]
    rows = rows.select(*fixed, y.alias("_y"), lam.alias("_lam"), hit.alias("_hit"))
    alike = rows.groupBy(*fixed, "_lam", "_hit").agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_mean"), F.var_pop("_y").alias("_var"))
    alike = alike.withColumn("_all", F.sum(F.col("_n") * F.col("_mean")).over(W.partitionBy(*fixed)) / F.sum("_n").over(W.partitionBy(*fixed)))
    lam, line = F.col("_lam"), F.col("threshold")
    alike = alike.select("*", dist.over_probability(lam, None, line).alias("_pp"), F.when(F.col("r").isNotNull(), dist.over_probability(lam, F.col("r"), line)).alias("_pn"))
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    mean = lambda x: F.sum(F.col("_n") * x) / F.sum("_n")
    brier = lambda c: mean(F.pow(clip(c) - F.col("_hit"), F.lit(2)))
    loss = lambda c: mean(-(F.col("_hit") * F.log(clip(c)) + (1 - F.col("_hit")) * F.log(1 - clip(c))))
    return alike.groupBy(*fixed).agg(
        F.sum("_n").alias("n"), brier("_pp").alias("brier_poisson"), loss("_pp").alias("log_loss_poisson"), brier("_pn").alias("brier_negbin"), loss("_pn").alias("log_loss_negbin"),
        mean(lam).alias("mean_pred"), mean(F.col("_mean")).alias("mean_actual"), mean(F.col("_var") + F.pow(F.col("_mean") - F.col("_all"), F.lit(2))).alias("var_actual"), mean(lam + lam * lam / F.col("r")).alias("var_implied_negbin"),
    )


def residual_correlation(df: DataFrame, match: Sequence[str], own: str, other: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of both sides' values over all rows that have both."""
    from .joins import opponent_join

    both = opponent_join(df, match, own, other, [value], "_o_").filter(F.col(value).isNotNull() & F.col(f"_o_{value}").isNotNull())
    a, b = F.col(value).cast("double"), F.col(f"_o_{value}").cast("double")
    varied = (F.count(a) >= 2) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_matches_x2"), F.when(varied, F.corr(a, b)).alias("corr"))


def independence_comparison(df: DataFrame, by: Sequence[str], la: str, lb: str, total_lam: str, total: str, r_side: Column, r_total: Column, train_mean: Column) -> DataFrame:
    """Per line: Brier of a sum of independent sides, and of the dispersion fitted to totals."""
    rs = dist.independent_sum_r(F.col(la), r_side, F.col(lb), r_side)
    rows = df.select(*by, F.col(la).alias("_la"), F.col(lb).alias("_lb"), F.col(total_lam).alias("_lt"), F.col(total).alias("_y"), rs.alias("_ri"), r_total.alias("_rt"), train_mean.alias("_m")).filter(F.col("_y").isNotNull() & (F.col("_ri") > 0))
    # tails are worked out once for each distinct row; grids are each row's own, joined on nothing
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    alike = alike.select("*", F.explode(dist.line_grid(F.col("_m"), F.col("_rt"))).alias("line"))
    alike = alike.select("*", dist.over_probability(F.col("_la") + F.col("_lb"), F.col("_ri"), F.col("line")).alias("_pi"), dist.over_probability(F.col("_lt"), F.col("_rt"), F.col("line")).alias("_pe"))
    hit = (F.col("_y") > F.col("line")).cast("double")
    brier = lambda p: F.sum(F.col("_n") * F.pow(F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6)) - hit, F.lit(2))) / F.sum("_n")
    return alike.groupBy(*by, "line").agg(F.sum("_n").alias("n"), brier("_pi").alias("brier_independent"), brier("_pe").alias("brier_empirical"))


def dependency_decision(df: DataFrame, by: Sequence[str], least: float = 0.03) -> DataFrame:
    """Keep the fitted dispersion unless independence gains ``least`` of the mean Brier score."""
    out = df.groupBy(*by).agg(F.avg("brier_independent").alias("a"), F.avg("brier_empirical").alias("b"))
    gain = (F.col("b") - F.col("a")) / F.col("b")
    return out.select(*by, "a", "b", gain.alias("relative_gain"), F.when(gain >= least, "independent").otherwise("empirical").alias("decision"))


def seeded_groups(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """All rows of ``n`` groups chosen by the md5 of key and seed: the same for the same seed."""
    chosen = df.select(*key).distinct().orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))), *key).limit(n)
    return df.join(F.broadcast(chosen), list(key), "left_semi")


def listing(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0, **groups: Sequence[str] | None) -> DataFrame:
    """A page, newest first, of rows whose columns are in the groups given, each with their ``total``."""
    for column, values in groups.items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*[F.desc(c) for c in order]).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def rejected(df: DataFrame, columns: Sequence[str], state: str = "classification") -> DataFrame:
    """Discarded rows, with those of the columns that there are."""
    return df.filter(F.col(state) == "DESCARTAR").select(*[c for c in columns if c in df.columns])


def between_days(df: DataFrame, utc: str, zone: str, first: str | None = None, last: str | None = None, **equal: str | None) -> DataFrame:
    """Rows whose day in a display zone lies between two days, and whose columns equal what is given."""
    day = F.to_date(F.from_utc_timestamp(utc, zone))
    if first:
        df = df.filter(day >= F.lit(first).cast("date"))
    if last:
        df = df.filter(day <= F.lit(last).cast("date"))
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def unresolved_sides(df: DataFrame, shared: Sequence[str], weak: Sequence[str] = ("unresolved", "fuzzy_review")) -> DataFrame:
    """A row per side of a match whose name was not safely resolved."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"player_{s}_raw").alias("raw_name"), F.col(f"method_{s}").alias("method")) for s in ("a", "b")])
    return df.select(*shared, F.explode(sides).alias("_s")).select(*shared, "_s.*").filter(F.col("method").isin(*weak))


def find_evaluated(df: DataFrame, wanted: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last evaluated row of each wanted key; NULLs match nothing."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_r"))
    return wanted.join(last, list(key), "left").select(*wanted.columns, "_r.*")


def confirmed_changes(raw: Column, confirmed: Column) -> Column:
    """Whether a confirmed list of readings differs from the raw one, order apart."""
    return ~F.array_sort(raw).eqNullSafe(F.array_sort(confirmed))


def badge(df: DataFrame, match: Sequence[str], state: str, priority: Sequence[str] = ("CONFERIR_ODDS", "OBSERVAR", "DESCARTADO")) -> DataFrame:
    """Each match's best state by priority."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(state))
    return df.groupBy(*match).agg(F.min_by(state, F.when(place > 0, place)).alias("badge"))


def classification_summary(df: DataFrame, by: Sequence[str], state: str = "classification") -> DataFrame:
    """Rows per group and state; NULL groups count."""
    return df.groupBy(*by, state).agg(F.count(F.lit(1)).alias("n"))


def problem_category(state: Column, matched: Column) -> Column:
    """What a report files a row under."""
    return F.when(~F.coalesce(matched, F.lit(False)), "SEM_LINHA").when(state.startswith("CANDIDATO"), "CANDIDATO").when(state == "OBSERVAR", "OBSERVAR").otherwise("DESCARTADO")


def discard_reason(reasons: Column) -> Column:
    """The first reason's gate, for a one-line report."""
    return F.when(F.size(reasons) > 0, F.regexp_extract(reasons[0], "^([^:]*)", 1))


def ordered_before(df: DataFrame, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with how many of their group come before them: paging without gaps."""
    return df.withColumn("n_before", F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1)
