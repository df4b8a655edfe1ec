"""Line deduplication over levelled sorted runs of line hashes.

A store holds *runs*: tables bucketed and sorted by a 128-bit line hash. ``LineStore.add``
takes one batch: its hashes are merge-anti-joined with the hashes that runs own, and the
batch's run owns those that are new (``is_new``); for the others it holds only what the
batch adds to them (documents, and the largest id). As soon as a level has ``fan_out`` runs
they are compacted into one run of the next level: owners take in what was added, by merge
joins of sorted runs. ``merged`` is one such merge of all runs, owners alone.

All runs are bucketed alike, so a batch is shuffled once, when its own hashes are counted,
and no merge shuffles. Everything here is built-in DataFrame functions.

A store with a path of its own stays: a numbered manifest beside the runs lists them by level,
so that a later job opens it and its batches meet all lines ever added. A writer that finds
its number taken by another one fails.

A *key* is a line stripped of ``[ \\t-\\r]`` at both ends, with A-Z lower-cased. Each row
counts as one document. Defined results: a null or empty text is one empty line; rows that
repeat count each; among equal ids all holders of the largest id keep the line; null ids
count as smaller than all others; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifest
from . import scratch

#: Documents are dealt to so many slices; batches are ranges of them.
SLICES = 4096
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(17), key).alias("h2"))


class LineStore:
    """Levelled runs in the shared folder; ``fan_out`` runs of a level become one of the next.

    Batches are counted with as many shuffle partitions as runs have buckets, so that they
    lie as the runs do.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 2, buckets: int | None = None, path: str | None = None):
        self.spark, self.fan_out = spark, fan_out
        self.path = path or scratch.new_path(spark, "line-store")
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        self.version, entries = self.manifest.read()
        self.buckets = entries[0]["buckets"] if entries else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: list[str] = []
        self._entries: list[list[dict]] = [[] for _ in range(1 + max((e["level"] for e in entries), default=0))]
        self.levels: list[list[DataFrame]] = [[] for _ in self._entries]
        for entry in entries:
            self._entries[entry["level"]].append(entry)
            self.levels[entry["level"]].append(self._opened(entry))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _opened(self, entry: dict) -> DataFrame:
        """A run written before, under a name in this session's catalog."""
        name = f"priorflow_line_run_{uuid.uuid4().hex}"
        by = "CLUSTERED BY (h1, h2) SORTED BY (h1, h2)"
        self.spark.sql(f"CREATE TABLE {name} ({entry['columns']}) USING parquet {by} INTO {self.buckets} BUCKETS LOCATION '{entry['path']}'")
        self._tables.append(name)
        return self.spark.table(name)

    def _write(self, entries: DataFrame, level: int) -> DataFrame:
        name, path = f"priorflow_line_run_{uuid.uuid4().hex}", f"{self.path}/runs/{uuid.uuid4().hex}"
        writer = entries.write.format("parquet").option("compression", "zstd").option("path", path)
        with scratch.shuffle_partitions(self.spark, self.buckets):
            writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self._tables.append(name)
        run = self.spark.table(name)
        self._entries[level].append({"level": level, "path": path, "buckets": self.buckets, "columns": ", ".join(f"{c} {t}" for c, t in run.dtypes)})
        self.levels[level].append(run)
        return run

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """All entries of ``runs``, one for each hash: what is added joins its owner's entry."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select("h1", "h2", F.col("n_docs").alias("n"), F.col("max_id").alias("m"), F.col("is_new").alias("new"))
            out = out.hint("merge").join(other, ["h1", "h2"], "full_outer").select(
                "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_id", "m").alias("max_id"),
                (F.coalesce("is_new", F.lit(False)) | F.coalesce("new", F.lit(False))).alias("is_new"),
            )
        return out

    def add(self, postings: DataFrame) -> DataFrame:
        """Merge a batch of (h1, h2, id), a row per document and key; returns the batch's run."""
        entries = postings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("max_id")).withColumn("is_new", F.lit(True))
        for known in self.runs():
            owned = known.filter("is_new").select("h1", "h2", F.lit(True).alias("owned"))
            entries = entries.hint("merge").join(owned, ["h1", "h2"], "left").select("h1", "h2", "n_docs", "max_id", (F.col("is_new") & F.col("owned").isNull()).alias("is_new"))
        run = self._write(entries, 0)
        self._compact()
        self.version = self.manifest.commit(self.version, [e for level in self._entries for e in level])
        return run

    def _compact(self) -> None:
        for level in range(64):
            if level >= len(self.levels) or len(self.levels[level]) < self.fan_out:
                return
            if level + 1 == len(self.levels):
                self.levels.append([])
                self._entries.append([])
            self._write(self._merge(self.levels[level]), level + 1)
            self.levels[level], self._entries[level] = [], []

    def merged(self) -> DataFrame:
        """(h1, h2, n_docs, max_id), one row for each hash ever added."""
        return self._merge(self.runs()).filter("is_new").drop("is_new")

    def close(self) -> None:
        """Take the runs' names out of the session's catalog."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _among(value: Column, groups: Column) -> Column:
    """Whether a hash is in ``groups``, lists by its remainder: fewer to look through than in one list."""
    return F.array_contains(F.get(groups, F.pmod(value, F.size(groups)).cast("int")), value)


def _grouped(values: Column) -> Column:
    """Lists of hashes by their remainder, about as many lists as a list has hashes."""
    n = F.ceil(F.sqrt(F.size(values))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(values, lambda v: F.pmod(v, n) == i))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 20,
    min_docs: int = 3,
    batches: int | None = None,
    fan_out: int = 4,
    part_docs: int = 20_000,
    bucket_rows: int = 2_000_000,
    batch_rows: int = 500_000_000,
    store: LineStore | None = None,
) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and two more columns at the end,
    ``n_lines`` and ``n_dropped`` (with underscores added where such columns exist).

    Keys of ``min_length`` code points or more that ``min_docs`` documents or more hold lose
    all their lines but those of the largest id. Documents go through the store in
    batches by a hash of the id, of about ``batch_rows`` lines and four at least (or
    ``batches``); buckets of runs hold up to about ``bucket_rows`` lines. With a ``store`` that
    stays, lines of all documents ever added count, and these documents are added to them. A line in more than ``part_docs`` documents is dealt to a task for about every so
    many.
    """
    spark = docs.sparkSession
    doc, body = F.col(id_col), F.col(text_col)
    rowkey = F.xxhash64(doc, body, F.lit(3))
    keyed = F.array_distinct(
        F.transform(F.filter(F.transform(lines_of(body), line_key), lambda k: F.length(k) >= min_length), key_hash)
    )
    postings = scratch.keep(
        docs.select(doc.alias("id"), rowkey.alias("row"), F.pmod(F.xxhash64(doc), F.lit(SLICES)).cast("int").alias("slice"), F.explode(keyed).alias("k"))
        .select("id", "row", "slice", "k.h1", "k.h2")
        .sortWithinPartitions("slice"),  # so that a batch reads its own part of each file
        "line-postings",
    )
    total = postings.count()
    batches = batches or min(SLICES, max(4, -(-total // batch_rows)))
    store = store or LineStore(spark, fan_out, min(100_000, max(spark.sparkContext.defaultParallelism, total // bucket_rows)))
    for batch in range(batches):
        first, last = batch * SLICES // batches, (batch + 1) * SLICES // batches - 1
        store.add(postings.filter(F.col("slice").between(first, last)).select("h1", "h2", "id"))
    # a line of many documents is dealt to several tasks; such lines are few, whatever the input's size
    part_docs = max(part_docs, total // 100_000)
    repeated = scratch.keep(store.merged().filter(F.col("n_docs") >= min_docs).withColumn("parts", F.ceil(F.col("n_docs") / part_docs)), "repeated-lines")
    store.close()
    hot = repeated.filter("parts > 1").select("h1", "h2", F.col("parts").alias("n"))
    lines = repeated.select("h1", "h2", "max_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    lost = (
        postings.join(F.broadcast(hot), ["h1", "h2"], "left")
        .withColumn("part", F.coalesce(F.pmod("row", F.col("n")), F.lit(0)))
        .join(lines, ["h1", "h2", "part"])
        .filter(~F.col("id").eqNullSafe(F.col("max_id")))
        .groupBy("row")
        .agg(F.collect_set("h1").alias("lost1"), F.collect_set("h2").alias("lost2"))
    )
    row, lost1, lost2, parts, left, n_lines, n_dropped = scratch.free_names(docs, "line_row", "line_lost1", "line_lost2", "line_parts", "line_left", "n_lines", "n_dropped")
    lost = lost.select(F.col("row").alias(row), _grouped(F.col("lost1")).alias(lost1), _grouped(F.col("lost2")).alias(lost2))
    joined = docs.withColumn(row, rowkey).join(lost, row, "left").withColumn(parts, lines_of(body))

    def stays(line: Column) -> Column:
        key = line_key(line)
        hashed = key_hash(key)
        return (F.length(key) < min_length) | ~(_among(hashed["h1"], F.col(lost1)) & _among(hashed["h2"], F.col(lost2)))

    kept = F.filter(F.col(parts), stays)
    joined = joined.withColumn(left, F.when(F.col(lost1).isNull(), F.col(parts)).otherwise(kept))
    others = [F.col(c) for c in docs.columns if c != text_col]
    clean = F.array_join(F.col(left), "\n")
    return joined.select(
        *others,
        F.when(F.col(lost1).isNull(), F.coalesce(body, F.lit(""))).otherwise(clean).alias(text_col),
        F.size(parts).cast("long").alias(n_lines),
        (F.size(parts) - F.size(left)).cast("long").alias(n_dropped),
    )
