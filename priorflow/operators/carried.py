"""Windows that go on from a stored state, without the rows they were made of.

An entity's state is one row: sums and number of all its rows, its last rows (as many as the
longest ``last_n`` window has), sums per day (as far back as the longest ``days`` window
looks), sums per segment, decayed sums, and where its rows end. ``advance`` adds a batch of
later rows, ``features`` gives the windows of rows that come after the state, as
:class:`~priorflow.operators.windows.Timeline` would over all rows together: a window over
the batch itself and what the state adds to it. Rows that come before the state's end can't
be added; they are an error, and their entities must be built anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.numeric import safe_ratio
from ..sources.manifest import Manifest
from .windows import Prior, Timeline


class Carried:
    """The state of ``values`` over ``windows`` for entities of a timeline."""

    def __init__(self, timeline: Timeline, values: Sequence[str], windows: Sequence[Prior]):
        self.timeline, self.values, self.windows = timeline, list(values), list(windows)
        self.ring = max((w.n for w in windows if w.kind == "last_n"), default=0)
        self.days = max((w.n for w in windows if w.kind == "days"), default=0)
        self.decays = sorted({w.n for w in windows if w.kind == "decay"})

    # --- building -------------------------------------------------------------------------

    def _order(self) -> Column:
        return F.struct(F.col(self.timeline.date), *[F.col(c) for c in self.timeline.sequence])

    def _values(self) -> Column:
        return F.array(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in self.values])

    def summarize(self, rows: DataFrame) -> DataFrame:
        """The state of ``rows`` alone. Sums are added up per day and segment before they meet
        in an entity, and last rows are cut before they are shuffled, so a hot entity is no
        single task's."""
        t, entity = self.timeline, self.timeline.entity
        segment = F.lit(None).cast("string") if t.segment is None else F.col(t.segment)
        adds = [F.sum(F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(f"s{i}") for i, v in enumerate(self.values)]
        cells = rows.groupBy(*entity, t.day.alias("day"), segment.alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.max(self._order()).alias("last"), *adds)
        end = F.max("day").over(W.partitionBy(*entity))
        cells = cells.select(*entity, "day", "segment", "n", "last", F.array(*[f"s{i}" for i in range(len(self.values))]).alias("sums"), end.alias("end"))
        total = F.array(*[F.sum(F.col("sums")[i]) for i in range(len(self.values))])
        faded = [F.array(*[F.sum(F.col("sums")[i] * F.pow(F.lit(2.0), (F.col("day") - F.col("end")) / F.lit(float(h)))) for i in range(len(self.values))]) for h in self.decays]
        by_day = cells.groupBy(*entity, "day", "end").agg(F.sum("n").alias("n"), F.max("last").alias("last"), total.alias("sums"))
        recent = F.when(F.col("day") > F.col("end") - self.days, F.struct("day", "n", "sums"))
        whole = by_day.groupBy(*entity).agg(F.sum("n").alias("n"), total.alias("sums"), F.max("end").alias("end"), F.max("last").alias("last"), F.sort_array(F.collect_list(recent)).alias("by_day"), F.array(*faded).cast("array<array<double>>").alias("faded"))
        parts = cells.filter("segment IS NOT NULL").groupBy(*entity, "segment").agg(F.sum("n").alias("n"), total.alias("sums")).groupBy(*entity).agg(F.collect_list(F.struct("segment", "n", "sums")).alias("by_segment"))
        nth = F.row_number().over(W.partitionBy(*entity).orderBy(F.desc(t.date), *[F.desc(c) for c in t.sequence]))
        ring = rows.select(*entity, self._order().alias("at"), self._values().alias("sums"), nth.alias("nth")).filter(F.col("nth") <= self.ring)
        ring = ring.groupBy(*entity).agg(F.sort_array(F.collect_list(F.struct("at", "sums"))).alias("ring"))
        out = whole.join(parts, entity, "left").join(ring, entity, "left")
        first = rows.groupBy(*entity).agg(F.min(self._order()).alias("first"))
        return out.join(first, entity).select(*entity, "n", "sums", "end", "first", "last", "by_day", "faded", F.coalesce("by_segment", F.array().cast(parts.schema["by_segment"].dataType)).alias("by_segment"), F.coalesce("ring", F.array().cast(ring.schema["ring"].dataType)).alias("ring"))

    def _plus(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def merge(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Two states of the same entities, the second one of later rows; fails where it isn't later."""
        entity, fields = self.timeline.entity, [c for c in old.columns if c not in self.timeline.entity]
        both = old.select(*entity, F.struct(*fields).alias("o")).join(new.select(*entity, F.struct(*fields).alias("n")), entity, "full_outer")
        o, n = F.col("o"), F.col("n")
        later = F.when(n["first"] > o["last"], n["end"]).otherwise(F.raise_error(F.lit("rows come before the state's end; build their entities anew")).cast("int"))
        fade = lambda k, h: F.transform(o["faded"][k], lambda x: x * F.pow(F.lit(2.0), (o["end"] - n["end"]) / F.lit(float(h))))
        # a day that both have is the last of the one and the first of the other
        ends, starts = F.element_at(o["by_day"], -1), F.element_at(n["by_day"], 1)
        shared = (F.size(o["by_day"]) > 0) & (F.size(n["by_day"]) > 0) & (ends["day"] == starts["day"])
        one = F.struct(starts["day"].alias("day"), (ends["n"] + starts["n"]).alias("n"), self._plus(ends["sums"], starts["sums"]).alias("sums"))
        days = F.when(shared, F.concat(F.slice(o["by_day"], F.lit(1), F.size(o["by_day"]) - 1), F.array(one), F.slice(n["by_day"], F.lit(2), F.size(n["by_day"])))).otherwise(F.concat(o["by_day"], n["by_day"]))
        cells = F.concat(o["by_segment"], n["by_segment"])
        zero = F.array(*[F.lit(0.0) for _ in self.values])

        def of_segment(name: Column) -> Column:
            own = F.filter(cells, lambda c: c["segment"] == name)
            return F.struct(name.alias("segment"), F.aggregate(own, F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"), F.aggregate(own, zero, lambda a, c: self._plus(a, c["sums"])).alias("sums"))

        joined = F.struct(
            (o["n"] + n["n"]).alias("n"), self._plus(o["sums"], n["sums"]).alias("sums"), later.alias("end"), o["first"].alias("first"), n["last"].alias("last"),
            F.filter(days, lambda d: d["day"] > n["end"] - self.days).alias("by_day"), F.array(*[self._plus(fade(k, h), n["faded"][k]) for k, h in enumerate(self.decays)]).cast("array<array<double>>").alias("faded"),
            F.transform(F.array_distinct(F.transform(cells, lambda c: c["segment"])), of_segment).alias("by_segment"),
            F.slice(F.concat(o["ring"], n["ring"]), F.greatest(F.size(o["ring"]) + F.size(n["ring"]) - self.ring + 1, F.lit(1)), F.lit(max(self.ring, 1))).alias("ring"),
        )
        merged = F.when(o.isNull(), n).when(n.isNull(), o).otherwise(joined.cast(both.schema["o"].dataType))
        return both.select(*entity, merged.alias("m")).select(*entity, *[F.col(f"m.{c}").alias(c) for c in fields])

    # --- answering ------------------------------------------------------------------------

    def _tails(self, steps: Column, width: int) -> Column:
        """Sums of the last 0, 1, 2 … arrays of ``steps``, so that any tail is one look-up."""
        zero = F.array(F.array(*[F.lit(0.0) for _ in range(width)]))
        return F.aggregate(F.reverse(steps), zero, lambda a, x: F.concat(a, F.array(self._plus(F.element_at(a, -1), x))))

    def _packed(self, state: DataFrame) -> DataFrame:
        """(entity, _state): one struct, with tails of last rows and of days."""
        days = F.transform("by_day", lambda d: F.concat(d["sums"], F.array(d["n"].cast("double"))))
        tails = self._tails(days, len(self.values) + 1).alias("day_tails"), self._tails(F.transform("ring", lambda x: x["sums"]), len(self.values)).alias("ring_tails")
        return state.select(*self.timeline.entity, F.struct("n", "sums", "end", "last", "faded", "by_segment", F.transform("by_day", lambda d: d["day"]).alias("days"), *tails).alias("_state"))

    def _from_state(self, w: Prior, at: int | None) -> Column:
        """What the state adds to a window: of value number ``at``, or (None) the number of rows."""
        s, day, before = F.col("_state"), F.col("_day"), F.col("_before")
        own = (lambda x: x["n"].cast("double")) if at is None else (lambda x: x["sums"][at])
        if w.kind == "career":
            return own(s)
        if w.kind == "last_n":
            room = F.greatest(F.least(F.lit(w.n) - before, F.size(s["ring_tails"]) - 1), F.lit(0))
            return F.when(s.isNotNull(), room.cast("double") if at is None else F.get(s["ring_tails"], room)[at])
        if w.kind == "days":
            return F.get(s["day_tails"], F.col(f"_days_{w.name}"))[len(self.values) if at is None else at]
        if w.kind == "segment":
            return own(F.col("_segment"))
        faded = s["faded"][self.decays.index(w.n)][at]
        return faded * F.pow(F.lit(2.0), (s["end"] - day) / F.lit(float(w.n)))

    def _batch(self, w: Prior, at: int | None) -> str:
        return f"_batch_{'n' if at is None else at}_{w.name}"

    def _window(self, w: Prior, at: int | None) -> Column:
        batch = F.col(self._batch(w, at))
        if w.kind in ("days", "decay"):
            return batch + F.coalesce(self._from_state(w, at), F.lit(0.0))
        known = self._from_state(w, at)
        if w.kind == "segment":
            known = F.when(F.col(self.timeline.segment).isNotNull(), known)
        return F.when(batch.isNotNull() | known.isNotNull(), F.coalesce(batch, F.lit(0.0)) + F.coalesce(known, F.lit(0.0)))

    def features(self, state: DataFrame, rows: DataFrame, rates: dict[str, tuple[str, str]] | None = None, prefix: str = "prior_") -> DataFrame:
        """``rows`` with the columns of ``Timeline.sums`` (and, for ``rates``, ``Timeline.rates``),
        as over the state's rows and these together."""
        t, entity = self.timeline, self.timeline.entity
        counted = {w.name: Prior(w.name, "career") if w.kind == "decay" else w for w in self.windows}
        # windows run over the batch's own narrow rows; states, each up to days and last rows long, meet
        # them only then, and of a state just numbers are kept
        batch = [t._sum(F.col(v), w).alias(self._batch(w, i)) for i, v in enumerate(self.values) for w in self.windows] + [t._sum(F.lit(1.0), w).alias(self._batch(w, None)) for w in counted.values()]
        narrow = rows.select("*", t.day.alias("_day"), (F.row_number().over(t.by) - 1).alias("_before"), *batch)
        joined = narrow.join(self._packed(state).hint("merge"), entity, "left")
        recent = lambda w: F.size(F.filter("_state.days", lambda d: d > F.col("_day") - w.n))
        segment = F.lit(None).cast("string") if t.segment is None else F.col(t.segment)
        joined = joined.select("*", *[recent(w).alias(f"_days_{w.name}") for w in self.windows if w.kind == "days"], F.get(F.filter("_state.by_segment", lambda c: c["segment"] == segment), F.lit(0)).alias("_segment"))
        checked = F.when(F.col("_state").isNull() | (self._order() > F.col("_state.last")), F.col("_before")).otherwise(F.raise_error(F.lit("rows come before the state's end")).cast("int"))
        joined = joined.withColumn("_before", checked)
        sums = {(v, w.name): self._window(w, i) for i, v in enumerate(self.values) for w in self.windows}
        counts = [F.coalesce(self._window(counted[w.name], None), F.lit(0.0)).cast("long").alias(f"{prefix}matches_{w.name}") for w in self.windows]
        made = joined.select("*", *[c.alias(f"_w_{v}_{w}") for (v, w), c in sums.items()], *counts)
        ratios = [safe_ratio(F.col(f"_w_{a}_{w.name}"), F.col(f"_w_{b}_{w.name}")).alias(f"{m}_{w.name}") for m, (a, b) in (rates or {}).items() for w in self.windows]
        named = [F.col(f"_w_{v}_{w.name}").alias(f"{prefix}{v}_{w.name}") for w in self.windows for v in self.values]
        return made.select(*rows.columns, *named, *[f"{prefix}matches_{w.name}" for w in self.windows], *ratios)


class CarriedStore:
    """States on disk, by buckets of entities. A batch reads and rewrites the buckets of its own
    entities; answers read those of the rows asked for. Writers meet in the manifest."""

    def __init__(self, spark: SparkSession, path: str, carried: Carried, buckets: int = 64):
        self.spark, self.path, self.carried, self.buckets = spark, path.rstrip("/"), carried, buckets
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.carried.timeline.entity), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets`` numbers

    def state(self, entries: list[dict], buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The stored states of some buckets (all unless given), or None before the first commit."""
        if not entries:
            return None
        schema = T.StructType.fromJson(entries[0]["schema"])
        wanted = sorted({e["path"] for e in entries if buckets is None or e["bucket"] in buckets})
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def advance(self, rows: DataFrame) -> int:
        """Add a batch of rows; returns the version made."""
        version, entries = self.manifest.read()
        touched = self._touched(rows)
        if not touched:
            return version
        new = self.carried.summarize(rows)
        old = self.state(entries, touched)
        merged = new if old is None else self.carried.merge(old, new)
        folder = f"{self.path}/states/{uuid.uuid4().hex}"
        merged.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(folder)
        schema = merged.schema.jsonValue()
        kept = [e for e in entries if e["bucket"] not in touched]
        return self.manifest.commit(version, kept + [{"bucket": b, "path": f"{folder}/bucket={b}", "schema": schema} for b in touched])

    def answer(self, rows: DataFrame, rates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """Features of rows that come after all that was added."""
        _, entries = self.manifest.read()
        state = self.state(entries, self._touched(rows))
        if state is None:
            state = self.carried.summarize(rows.limit(0))
        return self.carried.features(state, rows, rates)
