"""Append-only ledgers: keyed appends, immutable registration, settlement, price movement.

Every function plans a batch against a ledger's current rows and returns DataFrames; the
``write_*`` helpers append them. ``append_stream`` runs the same keyed append for each
micro-batch of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.utils import AnalysisException

from ..functions.numeric import closing_line_value, pnl_units, values_equal
from ..operators.windows import equity_curve, first, latest

TERMINAL = ("WIN", "LOSS", "VOID")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows of its schema where it isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def new_rows(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First incoming row of each key that the ledger doesn't have; NULL keys equal NULL."""
    fresh = first(incoming, key, order)
    seen = existing.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    return fresh.join(seen, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]), "left_anti")


def append(spark: SparkSession, path: str, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> None:
    """Append with keyed dedup: only new files, nothing rewritten."""
    new_rows(read_or_empty(spark, path, incoming.schema), incoming, key, order).write.mode("append").parquet(path)


def append_stream(stream: DataFrame, path: str, key: Sequence[str], order: Sequence[str], checkpoint: str, available_now: bool = True):
    """A streaming query that appends each micro-batch with keyed dedup; replays add nothing."""
    def batch(df: DataFrame, _: int) -> None:
        append(df.sparkSession, path, df, key, order)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def register(existing: DataFrame, incoming: DataFrame, ident: str, frozen: dict[str, str], order: Sequence[str]) -> DataFrame:
    """Each incoming row as added, skipped or rejected, with the frozen fields that differ.

    ``frozen`` names fields and their kind, number or text. Known ids must repeat all frozen
    fields; within a batch the first row of an id counts.
    """
    head = first(incoming, [ident], order).select(F.col(ident).alias("_i"), *[F.col(c).alias(f"_h_{c}") for c in frozen])
    old = existing.select(F.col(ident).alias("_e"), *[F.col(c).alias(f"_o_{c}") for c in frozen])
    nth = F.row_number().over(W.partitionBy(ident).orderBy(*order))
    rows = incoming.withColumn("_nth", nth).join(old, F.col(ident) == F.col("_e"), "left").join(head, F.col(ident) == F.col("_i"))
    known = F.col("_e").isNotNull()

    def same(c: str, kind: str) -> Column:
        base = F.when(known, F.col(f"_o_{c}")).otherwise(F.col(f"_h_{c}"))
        return values_equal(F.col(c), base) if kind == "number" else F.col(c).eqNullSafe(base)

    differing = F.filter(F.array(*[F.when(~same(c, kind), F.lit(c)) for c, kind in frozen.items()]), lambda x: x.isNotNull())
    status = F.when(~known & (F.col("_nth") == 1), "added").when(F.size(differing) == 0, "skipped").otherwise("rejected")
    return rows.select(*incoming.columns, status.alias("status"), differing.alias("differing"))


#: How a match may have ended (fixed values).
MATCH_STATUS = ("completed", "retirement", "walkover")


def record_results(existing: DataFrame, incoming: DataFrame, key: str, parts: dict[str, tuple[str, str]], fields: Sequence[str], order: Sequence[str], status: str = "match_status") -> DataFrame:
    """Results as added, skipped or rejected; an unknown status is rejected before anything else.

    ``parts`` names totals and the two columns they add up from, where they aren't given.
    """
    total = lambda name, a, b: F.coalesce(F.col(name), F.col(a) + F.col(b)).alias(name)
    full = incoming.select(*[c for c in incoming.columns if c not in parts], *[total(n, a, b) for n, (a, b) in parts.items()])
    known = F.coalesce(F.col(status).isin(*MATCH_STATUS), F.lit(False))
    kinds = {f: "text" if full.schema[f].dataType == T.StringType() else "number" for f in fields}
    good = register(existing, full.filter(known), key, kinds, order)
    bad = full.filter(~known).select("*", F.lit("rejected").alias("status"), F.array(F.lit(status)).alias("differing"))
    return good.unionByName(bad)


def run_day(predictions: DataFrame, results: DataFrame, log: DataFrame, outcome: Callable[[], Column], key: Sequence[str], settled_at: Column, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One day's work over DataFrames: the settlement events to append to the log, and the
    dashboard as it is after them."""
    events = settlement_events(predictions, results, log, outcome, key, settled_at)
    state = log.select("prediction_id", "settlement", "settled_at").unionByName(events.filter("event != 'rejected'").select("prediction_id", "settlement", "settled_at"))
    return events, dashboard(predictions, latest(state, ["prediction_id"], ["settled_at"]), by)


def settlement_events(predictions: DataFrame, results: DataFrame, log: DataFrame, outcome: Callable[[], Column], key: Sequence[str], settled_at: Column) -> DataFrame:
    """What settling writes now: prediction_id, settlement, event (settled, changed or rejected).

    State changes only are written; a terminal outcome never changes, and a later one that
    differs is rejected.
    """
    last = latest(log, ["prediction_id"], ["settled_at"]).select("prediction_id", F.col("settlement").alias("_last"))
    now = predictions.join(results, list(key), "left").withColumn("settlement", outcome()).join(last, "prediction_id", "left")
    frozen = F.coalesce(F.col("_last").isin(*TERMINAL), F.lit(False))
    event = F.when(F.col("_last").isNull(), "settled").when(F.col("_last") == F.col("settlement"), "unchanged").when(frozen, "rejected").otherwise("changed")
    return now.withColumn("event", event).filter("event != 'unchanged'").select("prediction_id", "settlement", F.col("_last").alias("previous"), "event", settled_at.alias("settled_at"))


def odds_movement(snapshots: DataFrame, key: Sequence[str], cutoff: str | None = None, odds: str = "decimal_odds", at: str = "collected_at") -> DataFrame:
    """Per key: snapshots, first, last and best price, and the closing one (last before ``cutoff``); NULL prices are in the count only."""
    before = F.lit(True) if cutoff is None else F.col(at) <= F.col(cutoff)
    priced = F.when(F.col(odds).isNotNull(), F.col(at))
    return snapshots.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_snapshots"), F.min_by(odds, priced).alias("first_odds"), F.max_by(odds, priced).alias("last_odds"), F.max(odds).alias("max_odds"),
        F.max_by(odds, F.when(before, priced)).alias("closing_odds"),
    )


def clv(predictions: DataFrame, movement: DataFrame, key: Sequence[str], used: str = "decimal_odds", unpriced: bool = False) -> DataFrame:
    """clv_pct, prob_diff and beat_close of each prediction with a closing price; ``unpriced`` keeps those whose movement has none, with NULLs."""
    v = closing_line_value(F.col(used), F.col("closing_odds"))
    out = predictions.join(movement, list(key))
    out = out if unpriced else out.filter(F.col("closing_odds").isNotNull())
    return out.select("*", v["clv_pct"].alias("clv_pct"), v["prob_diff"].alias("prob_diff"), (F.col(used) > F.col("closing_odds")).alias("beat_close"))


def paper_test(predictions: DataFrame, settlements: DataFrame, order: Sequence[str], by: Sequence[str] = (), stake: float = 1.0) -> DataFrame:
    """Predictions with their settlement, P&L and equity curve; pending ones have none."""
    rows = predictions.join(settlements.select("prediction_id", "settlement", "settled_at"), "prediction_id")
    rows = rows.withColumn("pnl", pnl_units(F.col("settlement"), F.col("decimal_odds"), stake))
    return equity_curve(rows.filter("pnl IS NOT NULL"), "pnl", order, by)


def paper_summary(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, stakes, P&L and both returns: on decided stakes, and on all resolved ones."""
    s = F.col("settlement")
    staked, all_resolved = F.count_if(s.isin("WIN", "LOSS")), F.count_if(s.isin(*TERMINAL))
    return curve.groupBy(*by).agg(
        F.count_if(s == "WIN").alias("wins"), F.count_if(s == "LOSS").alias("losses"), F.count_if(s == "VOID").alias("voids"), staked.alias("staked"), F.sum("pnl").alias("pnl"),
        F.when(staked > 0, F.sum("pnl") / staked).alias("roi"), F.when(all_resolved > 0, F.sum("pnl") / all_resolved).alias("roi_resolved"), F.min("drawdown").alias("max_drawdown"), F.max("loss_streak").alias("max_loss_streak"),
    )


def first_snapshot(registered: DataFrame) -> DataFrame:
    """The price at registration as each new prediction's first snapshot."""
    return registered.filter("status = 'added'").select("prediction_id", "bookmaker", "decimal_odds", "collected_at")


def with_versions(df: DataFrame, versions: dict[str, str | None], staleness_days: Column) -> DataFrame:
    """Version columns and the staleness at registration as constants."""
    return df.select("*", *[F.lit(v).cast("string").alias(k) for k, v in versions.items()], staleness_days.alias("staleness_at_registration"))


def dashboard(predictions: DataFrame, settlements: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: registered, pending and settled predictions, hit rate and mean edge."""
    rows = predictions.join(settlements.select("prediction_id", "settlement"), "prediction_id", "left")
    s = F.col("settlement")
    decided = F.count_if(s.isin("WIN", "LOSS"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(~s.isin(*TERMINAL), F.lit(True))).alias("pending"), F.count_if(s == "WIN").alias("wins"), F.count_if(s == "LOSS").alias("losses"),
        F.when(decided > 0, F.count_if(s == "WIN") / decided).alias("hit_rate"), F.avg("edge").alias("mean_edge"),
    )


def integrate(existing: DataFrame, incoming: DataFrame, transform: Callable[[DataFrame], DataFrame], keys: dict[str, Column | str], contexts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Existing rows and what is new of the incoming ones, transformed.

    Only what the ledger has counts as known: equal incoming rows are all kept.
    """
    from ..operators.joins import detect_existing

    marked = detect_existing(incoming, existing, keys, contexts)
    fresh = marked.filter(~F.col("is_duplicate")).select(*incoming.columns)
    return existing.unionByName(transform(fresh), allowMissingColumns=True)
