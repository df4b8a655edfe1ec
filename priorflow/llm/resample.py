"""Quality by importance resampling.

Two generative models of hashed n-grams (tokens, pairs of neighbours, and one n-gram for a
token that repeats its neighbour; a token is a word or a run of marks) are fitted in a fixed
number of buckets: one of target text, the labelled documents of
good quality that aren't toxic, and one of raw text, all documents. A document's importance
is the log ratio of the two models, the sum over its n-grams of log(target / raw), where

* ratios near 1, and those that chance explains, count as 1, for and against the target alike;
* the sum is taken from what target text of the same length has (its mean per n-gram times
  the length) and brought to a text of ``REFERENCE`` n-grams by the root of the length, as
  chance spreads; so length alone earns nothing, and a long text needs no more evidence
  than a short one.

The resampler draws ``k`` documents without replacement by Gumbel top-k: the ``k`` largest
``importance + Gumbel noise`` stay, so a document's chance to come next is in proportion to
``exp(importance)``, its weight. Unless ``k`` is given it is the sum of the weights, each in
units of a weight that all but ``1 - keep_target`` of the target documents have, and at most
1: about the number of documents no less like the target than those are. The noise is a hash
of id, text and seed, so runs repeat.

The k-th largest key is found by counting keys in ranges, three times, never by sorting all.

Defined results: null and empty texts have importance 0 (no evidence against them);
equal rows have equal keys, and stay or go together: all that tie with the k-th stay;
without labels nothing is known against any document and all stay; an empty table gives no
rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords, scratch

#: Buckets of tokens and of pairs; the last bucket counts repeats.
TOKENS, PAIRS = 1 << 18, 1 << 16
N_BUCKETS = TOKENS + PAIRS + 1
_BLOCK = 1 << 14
#: At most about so many labelled documents are used to fit the target model.
MAX_LABELS = 60_000
#: Added to the number of n-grams, so that one chance n-gram in a short text weighs little.
STEADY = 64
#: Number of n-grams of the text that importances are those of.
REFERENCE = 200

#: Byte -> itself within a token: words, and apart from them runs of marks; 0 for blanks.
_KIND = np.array([0 if c <= 32 or c == 127 else 1 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 2 for c in range(256)], np.uint8)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's begin."""
    raw, offsets = bytewords.buffer(texts)
    kind = _KIND[raw]
    change = np.ones(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(raw))
    inside = kind[starts] > 0
    starts, ends = starts[inside], ends[inside]
    words = bytewords.Words.__new__(bytewords.Words)
    words.bytes = bytewords.WORD_BYTES[raw] | np.where(kind == 2, raw, 0).astype(np.uint8)
    # a run of marks counts by its first three bytes, so that long and short runs agree
    ends = np.where(kind[starts] == 2, np.minimum(ends, starts + 3), ends)
    return words.spans(words.running(), starts, ends), np.searchsorted(starts, offsets)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the text of each."""
    tokens, first = _tokens(texts)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inner = owner[:-1] == owner[1:]
    pairs = bytewords.mix(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:])
    place = np.where(tokens[:-1] == tokens[1:], np.uint64(N_BUCKETS - 1), (pairs & np.uint64(PAIRS - 1)) + np.uint64(TOKENS))
    buckets = np.concatenate((tokens & np.uint64(TOKENS - 1), place[inner]))
    return buckets.astype(np.int64), np.concatenate((owner, owner[:-1][inner]))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, max_labels: int, target: str) -> DataFrame:
    """``docs`` with ``target``: 1 good, 0 not, null unlabelled or outside the bounded sample."""
    (key,) = scratch.free_names(docs, "label_id")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.min(good.cast("int")).alias(target))
    n = labels.count()
    if n > max_labels:  # keeps the broadcast below the bound, whatever the labels' number
        cut = int(max_labels / n * 1_000_000)
        known = known.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < cut)
    return docs.join(F.broadcast(known), docs[id_col] == known[key], "left").drop(key)


def _ratios(docs: DataFrame, text_col: str, target: str) -> np.ndarray:
    """Log ratios of the two models, from counts over all documents; 0 where they don't differ surely."""
    n_blocks = -(-N_BUCKETS // _BLOCK)

    def packed(totals: dict[int, np.ndarray]):
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["block", "counts"])

    def count(batches):
        total = np.zeros((2, n_blocks * _BLOCK), np.int64)
        for batch in batches:
            good = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False) == 1
            for i, rows in bytewords.slices(batch.column(0)):
                bucket, owner = features(rows)
                total[0] += np.bincount(bucket, minlength=total.shape[1])
                total[1] += np.bincount(bucket[good[i : i + len(rows)][owner]], minlength=total.shape[1])
        yield packed({k: np.ascontiguousarray(total[:, k * _BLOCK : (k + 1) * _BLOCK]) for k in range(n_blocks)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield packed(sums)

    schema = "block int, counts binary"
    counts = np.zeros((2, n_blocks * _BLOCK))
    for row in docs.select(text_col, target).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toLocalIterator():
        counts[:, row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, np.int64).reshape(2, -1)
    raw, target = counts
    if not target.sum():
        return np.zeros(len(raw))
    # expected target counts if each bucket were as common in target as in raw text
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + 0.5) / (expected + 0.5))
    noise = 1 / np.sqrt(np.minimum(target, expected) + 1)
    return np.where(np.abs(ratio) > 1 + 3 * noise, ratio, 0.0)


def _scored(docs: DataFrame, text_col: str, ratios, name: str, length: str) -> DataFrame:
    """``docs`` with the sum of log ratios and the number of n-grams."""

    def score(batches):
        own = ratios.value
        for batch in batches:
            out, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, rows in bytewords.slices(batch.column(text_col)):
                bucket, owner = features(rows)
                out[i : i + len(rows)] = np.bincount(owner, own[bucket], len(rows))
                grams[i : i + len(rows)] = np.bincount(owner, minlength=len(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array(grams)], names=[*batch.schema.names, name, length])

    return docs.mapInArrow(score, T.StructType(docs.schema.fields + [T.StructField(name, T.DoubleType()), T.StructField(length, T.LongType())]))


def kth_largest(keys: DataFrame, k: int, digits: int = 3, width: int = 4096) -> float:
    """The k-th largest of the doubles ``key``, by counting in ``width`` ranges, ``digits`` times."""
    ends = keys.agg(F.min("key"), F.max("key")).first()
    low, high = ends[0], ends[1]
    for _ in range(digits):
        if not low < high:
            break
        step = (high - low) / width
        place = F.least(F.greatest(F.floor((F.col("key") - low) / step), F.lit(0)), F.lit(width - 1))
        counts = keys.filter(F.col("key").between(low, high)).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        above = keys.filter(F.col("key") > high).count()
        for row in sorted(counts, key=lambda r: -r.place):
            if above + row.n >= k:
                low, high = row.a, row.b
                break
            above += row.n
    rest = k - keys.filter(F.col("key") > high).count()
    last = keys.filter(F.col("key").between(low, high)).groupBy("key").count().orderBy(F.desc("key"))
    for row in last.toLocalIterator():
        rest -= row["count"]
        if rest <= 0:
            return row.key
    return low


def gumbel_noise(id_: Column, text: Column, seed: int | Column) -> Column:
    """Standard Gumbel noise from 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(id_, text, seed if isinstance(seed, Column) else F.lit(seed)), 12).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int | None = None,
    max_labels: int = MAX_LABELS,
    keep_target: float = 0.999,
    seed: int = 7,
) -> DataFrame:
    """``docs`` and three more columns at the end: ``importance``, ``gumbel_key`` and ``kept``
    (with underscores added where such columns exist)."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    target, evidence, length, importance, key, kept = scratch.free_names(docs, "target", "evidence", "n_grams", "importance", "gumbel_key", "kept")
    known = _labelled(docs, labels, id_col, max_labels, target)
    ratios = spark.sparkContext.broadcast(_ratios(known, text_col, target))
    scored = scratch.keep(_scored(known, text_col, ratios, evidence, length), "scored")
    sums = scored.filter(F.col(target) == 1).agg(F.sum(evidence), F.sum(length)).first()
    mean = (sums[0] or 0.0) / max(sums[1] or 0, 1)
    spread = F.sqrt((F.col(length) + F.lit(STEADY)) / F.lit(REFERENCE))
    keyed = scored.withColumn(importance, (F.col(evidence) - F.col(length) * F.lit(mean)) / spread)
    keyed = keyed.withColumn(key, F.col(importance) + gumbel_noise(F.col(id_col), F.col(text_col), seed))
    least = keyed.filter(F.col(target) == 1).agg(F.percentile_approx(importance, F.lit(1 - keep_target), F.lit(100_000))).first()[0]
    unit = min(least if least is not None else 0.0, 0.0)
    total = keyed.agg(F.sum(F.exp(F.least(F.col(importance) - F.lit(unit), F.lit(0.0)))), F.count(F.lit(1))).first()
    k = min(total[1], round(total[0] or 0) if k is None else k)
    cut = kth_largest(keyed.select(F.col(key).alias("key")), k) if 0 < k < total[1] else float("-inf") if k else float("inf")
    return keyed.withColumn(kept, F.col(key) >= F.lit(cut)).select(*docs.columns, importance, key, kept)
