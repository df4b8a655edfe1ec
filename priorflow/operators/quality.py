"""Reports on tables: missing values, usable groups, mirrors, keys, coverage, drift."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_report(df: DataFrame, by: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Missing values of each column per group: (…, column, n, n_null, pct_null)."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("int").alias("gone")) for c in columns])
    long = df.select(*by, F.explode(rows).alias("_r")).select("*", "_r.*").drop("_r")
    keys = [c for c in long.columns if c not in ("column", "gone")]
    return long.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"), F.sum("gone").alias("n_null"), F.round(100 * F.avg("gone"), 2).alias("pct_null"))


def usable_report(df: DataFrame, match: Sequence[str], by: Sequence[str], needed: dict[str, Sequence[str]]) -> DataFrame:
    """Matches all of whose rows have the needed columns, by group and in total ('TODOS')."""
    have = [F.bool_and(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])).alias(name) for name, cols in needed.items()]
    per_match = df.groupBy(*match, *by).agg(*have)
    sums = [F.count(F.lit(1)).alias("n_matches"), *[F.count_if(F.col(n)).alias(f"usable_{n}") for n in needed]]
    cols = [F.col(c) for c in by]
    out = per_match.groupingSets([cols, []], *cols).agg(*sums, F.grouping_id().alias("_g"))
    label = [F.when(F.col("_g") > 0, "TODOS").otherwise(F.col(c).cast("string")).alias(c) for c in by]
    return out.select(*label, "n_matches", *[f"usable_{n}" for n in needed])


def group_size_check(df: DataFrame, match: Sequence[str], size: int = 2) -> DataFrame:
    """Matches that don't have exactly ``size`` rows."""
    return df.groupBy(*match).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") != size)


def mirror_check(df: DataFrame, match: Sequence[str], result: str, pairs: Sequence[tuple[str, str]], win: str = "W", loss: str = "L") -> DataFrame:
    """Per pair (own, other's) the matches whose two rows disagree; both missing agree."""
    sides = [df.filter(F.col(result) == r).select(*match, *[F.col(c).alias(f"{c}_{r}") for c in sorted({x for p in pairs for x in p})]) for r in (win, loss)]
    both = sides[0].join(sides[1], list(match))
    bad = [F.count_if(~F.col(f"{a}_{win}").eqNullSafe(F.col(f"{b}_{loss}"))).alias(f"bad_{a}") for a, b in pairs]
    return both.agg(F.count(F.lit(1)).alias("n_matches"), *bad)


def id_check(df: DataFrame, keys: Sequence[str], match: Sequence[str], result: str, win: str = "W") -> DataFrame:
    """Rows without a key, and matches with more than one winner."""
    nulls = df.agg(*[F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys])
    many = df.filter(F.col(result) == win).groupBy(*match).count().filter("count > 1").agg(F.count(F.lit(1)).alias("multiple_winners"))
    return nulls.crossJoin(many)


def sample_size_report(df: DataFrame, counts: dict[str, str], thresholds: Sequence[int] = (1, 10, 20, 50)) -> DataFrame:
    """(window, threshold, share of rows with so many earlier matches)."""
    rows = F.array(*[F.struct(F.lit(w).alias("window"), F.col(c).alias("n")) for w, c in counts.items()])
    long = df.select(F.explode(rows).alias("_r")).select("_r.*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return long.groupBy("window", "threshold").agg(F.avg((F.col("n") >= F.col("threshold")).cast("double")).alias("share"))


def status_report(df: DataFrame, status: str) -> DataFrame:
    """Rows and share of each status."""
    from pyspark.sql import Window as W

    out = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def coverage_report(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, and the share with any of the columns missing."""
    gone = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(gone.cast("double")).alias("share_any_missing"))


def filled_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share of rows that have it)."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().cast("double").alias("has")) for c in columns])
    return df.select(F.explode(rows).alias("_r")).select("_r.*").groupBy("column").agg(F.avg("has").alias("share"))


def schema_drift(headers: DataFrame, source: str, header: str) -> DataFrame:
    """Columns that each source lacks or adds against the commonest header (ties: least)."""
    counted = headers.groupBy(header).count().orderBy(F.desc("count"), header).limit(1).select(F.col(header).alias("_ref"))
    cols = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x))
    return headers.crossJoin(F.broadcast(counted)).select(source, F.array_except(cols(F.col("_ref")), cols(F.col(header))).alias("missing"), F.array_except(cols(F.col(header)), cols(F.col("_ref"))).alias("added"))


def staleness_report(history: DataFrame, future: DataFrame, by: Sequence[str], history_date: str, future_date: str) -> DataFrame:
    """Last known and first coming day of each group, and the days between."""
    a = history.groupBy(*by).agg(F.max(F.col(history_date).cast("date")).alias("last_known"))
    b = future.groupBy(*by).agg(F.min(F.col(future_date).cast("date")).alias("first_coming"))
    return b.join(a, list(by), "left").withColumn("gap_days", F.datediff("first_coming", "last_known"))


def daily_summary(df: DataFrame, match: Sequence[str], market: str, flag: str) -> DataFrame:
    """Per match: lines, candidates and markets with any."""
    per = df.groupBy(*match, market).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("k"))
    out = per.groupBy(*match).agg(F.sum("n").alias("n_lines"), F.sum("k").alias("n_candidates"), F.count_if(F.col("k") > 0).alias("n_markets"))
    return out.withColumn("has_candidates", F.col("n_candidates") > 0)


def flag_summary(df: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])
