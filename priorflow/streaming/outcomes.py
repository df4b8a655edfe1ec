"""Outcomes of a stream of events, kept per key: the first event registers the key, the first
terminal outcome settles it, and other outcomes after that are rejected.

State is a row per key, in a table beside the stream's checkpoint; events of a load that the
key has seen already are replays and do nothing. Each micro-batch joins its events with the
state, finds its changes by windows over each key's events, and writes the changes and the
state of the keys it met to folders of the batch's number. A batch that is run again reads
only what batches before it wrote, and writes its folders anew, so the sink never holds a
change twice. Every few batches the state of all keys is written together.

Defined results: events of a load are in the order of their numbers, NULL last; a NULL key is
a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ledgers import TERMINAL

STATE = "key string, seen long, first_event long, settled string, settled_by long"
CHANGE = "key string, event long, change string, settlement string, previous string"
#: The state of all keys is written by the last of this many batches (fixed value).
WHOLE = 16


def _order() -> Column:
    return F.struct("load", F.col("event").isNull().alias("unknown"), "event")


def _states(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Each key's state before ``batch``."""
    paths = [f"{path}/batch={b}" for b in range(max(batch - batch % WHOLE - 1, 0), batch)]
    if not paths:
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(f"{STATE}, batch int").option("basePath", path).parquet(*paths)
    names = ["seen", "first_event", "settled", "settled_by"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("key", *[f"s.{n}" for n in names])


def _fresh(events: DataFrame, states: DataFrame) -> DataFrame:
    """Events that are no replays, with the state of their key."""
    known = states.withColumnRenamed("key", "_key")
    rows = events.join(known, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")
    return rows.filter(F.col("load") > F.coalesce("seen", F.lit(-1)))


def _changes(fresh: DataFrame) -> DataFrame:
    key = W.partitionBy("key").orderBy(F.col("load"), F.col("event").asc_nulls_last())
    so_far, outcome = key.rowsBetween(W.unboundedPreceding, W.currentRow), F.when(F.col("settlement").isin(*TERMINAL), F.col("settlement"))
    rows = fresh.select("*", F.row_number().over(key).alias("nth"), F.coalesce("settled", F.first(outcome, True).over(so_far)).alias("final"), F.count(outcome).over(so_far).alias("decided"))
    change = lambda name, previous: F.struct(F.lit(name).alias("change"), "settlement", previous.cast("string").alias("previous"))
    found = F.array(
        F.when((F.col("nth") == 1) & F.col("seen").isNull(), change("registered", F.lit(None))),
        F.when(outcome.isNotNull() & (F.col("decided") == 1) & F.col("settled").isNull(), change("settled", F.lit(None))),
        F.when(outcome != F.col("final"), change("rejected", F.col("final"))),
    )
    return rows.select("key", "event", F.explode(F.filter(found, lambda c: c.isNotNull())).alias("c")).select("key", "event", "c.*")


def _next_states(fresh: DataFrame) -> DataFrame:
    """The state of each key met, after its events."""
    done = F.col("settlement").isin(*TERMINAL)
    at = F.when(done, _order())
    met = fresh.groupBy("key").agg(
        F.max("load").alias("seen"), F.first("seen").alias("known"), F.first("first_event").alias("old_first"), F.min_by("event", _order()).alias("new_first"),
        F.first("settled").alias("old"), F.first("settled_by").alias("old_by"), F.min_by("settlement", at).alias("new"), F.min_by("event", at).alias("new_by"),
    )
    kept = lambda known, old, new: F.when(known.isNotNull(), F.col(old)).otherwise(F.col(new))
    return met.select("key", "seen", kept(F.col("known"), "old_first", "new_first").alias("first_event"), F.coalesce("old", "new").alias("settled"), kept(F.col("old"), "old_by", "new_by").alias("settled_by"))


def follow_outcomes(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query over (key, load, event, settlement) that writes changes below ``path``.

    It takes what is there and ends; the next run goes on from the checkpoint. A load's files
    must come in one run, as a key takes a load it has seen for a replay.
    """
    kept = f"{checkpoint}/keys"

    def write(events: DataFrame, batch: int) -> None:
        states = _states(events.sparkSession, kept, batch)
        fresh = _fresh(events, states)
        _changes(fresh).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        after = _next_states(fresh)
        if batch % WHOLE == WHOLE - 1:
            met = after.select(F.col("key").alias("_key"))
            after = after.unionByName(states.join(met, F.col("key").eqNullSafe(F.col("_key")), "left_anti"))
        after.write.mode("overwrite").parquet(f"{kept}/batch={batch}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes written so far."""
    return spark.read.schema(f"{CHANGE}, batch int").option("basePath", path).parquet(path).drop("batch")
