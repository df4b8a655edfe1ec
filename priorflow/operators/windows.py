"""Point-in-time windows: sums, counts, means and decayed sums over earlier rows only.

Rows of an entity are ordered by date and then by a sequence that breaks ties; a row never
sees itself or what comes after. Missing values add 0. All windows of an entity share one
shuffle and one sort, as they partition and order alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import safe_ratio


@dataclass(frozen=True)
class Prior:
    """One window: kind is career, last_n, days, segment or decay; n its rows, days or half-life."""

    name: str
    kind: str
    n: int = 0


#: The windows a feature table has by default (fixed values).
DEFAULT_WINDOWS = [
    Prior("career", "career"),
    Prior("last10", "last_n", 10),
    Prior("last20", "last_n", 20),
    Prior("last50", "last_n", 50),
    Prior("last365d", "days", 365),
    Prior("surface_career", "segment"),
    Prior("decay90d", "decay", 90),
]


class Timeline:
    """How rows of an entity are ordered: entity columns, a date, tie-breakers, a segment."""

    def __init__(self, entity: Sequence[str], date: str, sequence: Sequence[str], segment: str | None = None):
        self.entity, self.date, self.sequence, self.segment = list(entity), date, list(sequence), segment
        self.day = F.unix_date(F.col(date).cast("date"))
        self.by = W.partitionBy(*self.entity).orderBy(date, *self.sequence)

    def _sum(self, value: Column, prior: Prior) -> Column:
        """The windowed sum, NULL without earlier rows but 0.0 for the kinds days and decay."""
        value = F.coalesce(value.cast("double"), F.lit(0.0))
        if prior.kind == "career":
            return F.sum(value).over(self.by.rowsBetween(W.unboundedPreceding, -1))
        if prior.kind == "last_n":
            return F.sum(value).over(self.by.rowsBetween(-prior.n, -1))
        if prior.kind == "segment":
            own = W.partitionBy(*self.entity, self.segment).orderBy(self.date, *self.sequence).rowsBetween(W.unboundedPreceding, -1)
            return F.when(F.col(self.segment).isNotNull(), F.sum(value).over(own))
        if prior.kind == "days":
            # all rows of the last days, this day's included, less this row and later ones of the day
            within = W.partitionBy(*self.entity).orderBy(self.day).rangeBetween(-(prior.n - 1), 0)
            later = W.partitionBy(*self.entity, self.day).orderBy(self.date, *self.sequence).rowsBetween(0, W.unboundedFollowing)
            return F.sum(value).over(within) - F.sum(value).over(later)
        if prior.kind == "decay":
            # ages in half-lives from the entity's last day, so no power overflows
            age = (self.day - F.max(self.day).over(W.partitionBy(*self.entity))) / F.lit(float(prior.n))
            scaled = F.sum(value * F.pow(F.lit(2.0), age)).over(self.by.rowsBetween(W.unboundedPreceding, -1))
            return F.coalesce(F.pow(F.lit(2.0), -age) * scaled, F.lit(0.0))
        raise ValueError(prior.kind)

    def _count(self, prior: Prior) -> Column:
        kind = Prior(prior.name, "career") if prior.kind == "decay" else prior
        return F.coalesce(self._sum(F.lit(1.0), kind), F.lit(0.0)).cast("long")

    def sums(self, df: DataFrame, values: Sequence[str], windows: Sequence[Prior], prefix: str = "prior_") -> DataFrame:
        """``prior_<value>_<window>`` and ``prior_matches_<window>`` for all pairs, in one select."""
        made = [self._sum(F.col(v), w).alias(f"{prefix}{v}_{w.name}") for w in windows for v in values]
        counts = [self._count(w).alias(f"{prefix}matches_{w.name}") for w in windows]
        return df.select("*", *made, *counts)

    def rates(self, df: DataFrame, metrics: dict[str, tuple[str, str]], windows: Sequence[Prior], prefix: str = "") -> DataFrame:
        """``<prefix><metric>_<window>``: sum of numerators over sum of denominators, NULL unless that is above 0."""
        return df.select("*", *[safe_ratio(self._sum(F.col(a), w), self._sum(F.col(b), w)).alias(f"{prefix}{m}_{w.name}") for w in windows for m, (a, b) in metrics.items()])

    def mean_of_present(self, value: Column, prior: Prior) -> Column:
        """Mean over earlier rows that have the value."""
        return safe_ratio(self._sum(value, prior), self._sum(value.isNotNull().cast("double"), prior))

    def history_means(self, df: DataFrame, targets: Sequence[str], windows: Sequence[Prior]) -> DataFrame:
        """``hist_mean_<target>_<window>``: earlier sum by the number of all earlier rows (decayed alike for decay)."""
        made = []
        for w in windows:
            n = self._sum(F.lit(1.0), w)
            made += [safe_ratio(self._sum(F.col(t), w), n).alias(f"hist_mean_{t}_{w.name}") for t in targets]
        return df.select("*", *made)


def snapshot_series(df: DataFrame, key: Sequence[str], time: Sequence[str], value: str) -> DataFrame:
    """snapshot_no from 1, previous value and change, per key in time order."""
    w = W.partitionBy(*key).orderBy(*time)
    before = F.lag(value).over(w)
    return df.select("*", F.row_number().over(w).alias("snapshot_no"), before.alias(f"previous_{value}"), (F.col(value) - before).alias(f"change_{value}"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def mark_first(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """True for all rows of a key but the first."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*key).orderBy(*order)) > 1)


def mark_repeated(df: DataFrame, key: Sequence[str], out: str = "is_repeated") -> DataFrame:
    """True for all rows of keys with more than one."""
    return df.withColumn(out, F.count(F.lit(1)).over(W.partitionBy(*key)) > 1)


def equity_curve(df: DataFrame, pnl: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """cumulative, peak, drawdown and loss_streak (runs of losses), in order, per ``by``.

    A group of ``by`` is one task's; :func:`long_equity_curve` deals one sequence, or hot
    groups, to many.
    """
    if not by:
        return long_equity_curve(df, pnl, order)
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("cumulative", F.sum(pnl).over(w)).withColumn("_run", F.sum(F.when(F.col(pnl) < 0, 0).otherwise(1)).over(w))
    peak = F.max("cumulative").over(w)
    streak = F.when(F.col(pnl) < 0, F.sum(F.when(F.col(pnl) < 0, 1).otherwise(0)).over(W.partitionBy(*by, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).otherwise(0)
    return df.select("*", peak.alias("peak"), (F.col("cumulative") - peak).alias("drawdown"), streak.cast("long").alias("loss_streak")).drop("_run")


def long_equity_curve(df: DataFrame, pnl: str, order: Sequence[str], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """As :func:`equity_curve`, for sequences of any length.

    Rows are dealt to ranges of the order and kept as a table of ``parts`` ranges. Each range
    has a summary: its sum, its peak, how many losses end it, and whether it is nothing but
    losses. Running over the summaries gives each range what comes before it, and a second
    pass adds that to windows within the range. A task holds a range's rows, and the summaries
    are ``parts`` rows (and one more for each group). Rows that tie in the order may stand in
    any order, as in any window.
    """
    from ..session import work_path

    spark, by = df.sparkSession, list(by)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, loss = work_path(spark, "curve-ranges"), F.col(pnl) < 0
    df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    within = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.coalesce(F.sum(pnl).over(within), F.lit(0.0))).withColumn("_run", F.sum(F.when(loss, 0).otherwise(1)).over(within))
    in_run = W.partitionBy("_part", *by, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_top", F.max("_sum").over(within)).withColumn("_streak", F.when(loss, F.sum(F.when(loss, 1).otherwise(0)).over(in_run)).otherwise(0))
    ends = rows.groupBy("_part", *by).agg(F.sum(F.coalesce(F.col(pnl), F.lit(0.0))).alias("sum"), F.max("_top").alias("top"), F.max("_run").alias("runs"), F.max_by("_streak", F.struct(*order, "_streak")).alias("tail"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_base", F.coalesce(F.sum("sum").over(before), F.lit(0.0))).withColumn("_chain", F.sum(F.when(F.col("runs") > 0, 1).otherwise(0)).over(W.partitionBy(*by).orderBy("_part")))
    # losses that end a range: its own, and those of the ranges of nothing but losses before it
    ends = ends.withColumn("_ending", F.sum("tail").over(W.partitionBy(*by, "_chain").orderBy("_part")))
    ends = ends.select("_part", *by, "_base", F.max(F.col("_base") + F.col("top")).over(before).alias("_peak"), F.coalesce(F.lag("_ending").over(W.partitionBy(*by).orderBy("_part")), F.lit(0)).alias("_ended"))
    ends = F.broadcast(ends) if not by else ends  # one row for each of ``parts`` ranges
    joined = rows.join(ends, ["_part", *by])
    cumulative, peak = F.col("_base") + F.col("_sum"), F.greatest(F.col("_base") + F.col("_top"), F.col("_peak"))
    streak = F.when(loss, F.col("_streak") + F.when(F.col("_run") == 0, F.col("_ended")).otherwise(0)).otherwise(0)
    return joined.select(*df.columns, cumulative.alias("cumulative"), peak.alias("peak"), (cumulative - peak).alias("drawdown"), streak.cast("long").alias("loss_streak"))


def monotone_groups(df: DataFrame, key: Sequence[str], x: str, y: str, tolerance: float = 1e-9, tie: Sequence[str] = ()) -> DataFrame:
    """Per key with 2 rows or more: n, and whether y never rises along x."""
    ahead = F.lead(y).over(W.partitionBy(*key).orderBy(x, *tie))
    steps = df.select(*key, (F.coalesce(ahead - F.col(y), F.lit(0.0)) <= tolerance).alias("_ok"))
    return steps.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_and("_ok").alias("monotone")).filter("n >= 2")


def order_violations(df: DataFrame, key: Sequence[str], position: str, value: str) -> DataFrame:
    """out_of_order: both rows of a neighbouring pair, in reading order, whose values fall."""
    w = W.partitionBy(*key).orderBy(position)
    here = F.col(value)
    bad = F.coalesce(here < F.lag(value).over(w), F.lit(False)) | F.coalesce(here > F.lead(value).over(w), F.lit(False))
    return df.withColumn("out_of_order", bad)


def ranks_sum(df: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """rank_<m> (least is 1, NULL takes the group's last rank) and rank_total."""
    made = []
    for m in measures:
        r = F.when(F.col(m).isNotNull(), F.rank().over(W.partitionBy(*group).orderBy(F.col(m).asc_nulls_last())))
        made.append(r.alias(f"_r_{m}"))
    df = df.select("*", *made)
    filled = [F.coalesce(F.col(f"_r_{m}"), F.max(f"_r_{m}").over(W.partitionBy(*group))).alias(f"rank_{m}") for m in measures]
    df = df.select("*", *filled).drop(*[f"_r_{m}" for m in measures])
    return df.withColumn("rank_total", sum((F.col(f"rank_{m}") for m in measures), F.lit(0)))
