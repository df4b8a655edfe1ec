"""A keyed ledger that knows what it may hold without reading it.

Rows lie in runs (one for each append) and buckets of a key hash. Every run has a Bloom
filter for each bucket, stored as rows (bucket, word, bits) and sized by the run's rows. An
append asks the filters first and opens the buckets of runs that may hold one of its keys, no
others: new keys cost a look at the filters alone. Appends of two writers meet in the
manifest; the later one plans anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import first
from ..session import work_path
from ..sources.manifest import CommitConflict, Manifest


class IndexedLedger:
    """First-wins rows by ``key`` (NULL keys equal NULL), ``order`` within a batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], order: Sequence[str], buckets: int = 64, bits_per_key: int = 12, hashes: int = 6):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, list(key), list(order)
        self.buckets, self.bits_per_key, self.hashes = buckets, bits_per_key, hashes
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        #: What the last append opened: (run, bucket) pairs.
        self.opened: list[tuple[str, int]] = []

    # --- hashes and filters ---------------------------------------------------------------

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with two hashes of the key and its bucket."""
        parts = [p for k in self.key for p in (F.col(k), F.col(k).isNull())]
        out = rows.select("*", F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(29), *parts).alias("_h2"))
        return out.withColumn("bucket", F.pmod(F.col("_h1"), F.lit(self.buckets)).cast("int"))

    def _places(self, width: Column) -> Column:
        """Positions in a filter of ``width`` bits."""
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: F.pmod(F.xxhash64("_h2", i), width)))

    def _maybe(self, batch: DataFrame, runs: list[dict]) -> DataFrame:
        """(run, bucket) of the filters that hold all bits of some key of ``batch``."""
        listed = F.array(*[F.struct(F.lit(r["run"]).alias("run"), F.lit(r["width"]).alias("width")) for r in runs])
        asked = batch.select("_h1", "_h2", "bucket", F.explode(listed).alias("r")).select("_h1", "bucket", "r.run", self._places(F.col("r.width")).alias("places"))
        asked = asked.select("_h1", "bucket", "run", F.size("places").alias("wanted"), F.explode("places").alias("place"))
        index = self.spark.read.schema("run string, bucket int, word long, bits long").parquet(*[f"{self.path}/filters/{r['run']}" for r in runs])
        word, bit = F.expr("place div 64").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
        held = asked.select("_h1", "bucket", "run", "wanted", word, bit.alias("bit")).join(index, ["run", "bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return held.groupBy("run", "bucket", "_h1").agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("wanted")).filter("n = wanted").select("run", "bucket").distinct()

    def _write_filters(self, rows: DataFrame, run: str, width: int) -> None:
        bits = rows.select("bucket", F.explode(self._places(F.lit(width).cast("long"))).alias("place"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
        words = bits.groupBy("bucket", F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
        words.select(F.lit(run).alias("run"), "bucket", "word", "bits").write.parquet(f"{self.path}/filters/{run}")

    # --- appends and reads ----------------------------------------------------------------

    def _rows(self, folders: list[str]) -> DataFrame:
        base = f"{self.path}/rows"
        return self.spark.read.schema(self.schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders]).select(*self.schema.names)

    def _seen(self, pairs: list[tuple[str, int]]) -> DataFrame:
        return self._rows([f"run={run}/bucket={bucket}" for run, bucket in pairs]).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])

    def append(self, batch: DataFrame, retries: int = 3) -> int:
        """Add the first row of each key that isn't there yet; returns how many were added."""
        path = work_path(self.spark, "ledger-batch")
        self._hashed(first(batch.select(*self.schema.names), self.key, self.order)).write.parquet(path)
        rows = self.spark.read.parquet(path)
        for attempt in range(retries + 1):
            version, runs = self.manifest.read()
            fresh = rows
            # at most as many pairs as there are files
            self.opened = sorted((r.run, r.bucket) for r in self._maybe(rows, runs).collect()) if runs else []
            if self.opened:
                same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)])
                fresh = rows.join(self._seen(self.opened), same, "left_anti")
            run = uuid.uuid4().hex
            if fresh.isEmpty():
                return 0
            fresh.select(*self.schema.names, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/run={run}")
            written = self._hashed(self._rows([f"run={run}"]))
            added = written.count()
            width = max(64, -(-added * self.bits_per_key // self.buckets))
            self._write_filters(written, run, width)
            try:
                self.manifest.commit(version, [*runs, {"run": run, "width": width, "n": added}])
                return added
            except CommitConflict:
                if attempt == retries:
                    raise
        return 0

    def read(self) -> DataFrame:
        """All rows of the newest version."""
        _, runs = self.manifest.read()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._rows([f"run={r['run']}" for r in runs])
