"""What a chain of quality filters removes in every order, and copies by partition refinement.

Copies: documents are split by code-point length, then by the hash of one block of the text
after another (blocks grow, the last is the rest); after each split classes of one document
are dropped. The texts of what survives are compared whole: equal texts of a class are one
group, and all ids but its smallest are marked. So equal hashes of different texts join
nothing.

The block hashes of a text are made in the one scan that makes its filter bits, so rounds
work on narrow rows; texts are read once more, for the surviving classes. A class in many
documents is joined by broadcast: as only classes of over ``max(256, total / 100000)`` rows
are, there are at most 100000 of them.

Audit: a document's failed filters are a mask of bits. Masks are counted per part, and all
orders are worked out from those counts, 32 numbers a part.

Defined results: null texts and parts are empty strings; a null id marks nothing and isn't
marked; rows that repeat count each, and equal ids aren't smaller than each other; labels of
one id are put together (any 1 counts), null ones are no label; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch

FILTERS = "ABCDE"
#: First code points of blocks after the first.
BLOCKS = (256, 4096, 65536)
#: Up to so many classes go to the scan of texts by broadcast, at 60 bytes or less each.
MOST_CLASSES = 200_000


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A 1, B 2, C 4, D 8."""
    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        return F.when(n < 50, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)).cast("long") < 65 * n, 2).otherwise(0)

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long")
    shouts = F.when(100 * capitals > 5 * F.char_length(text).cast("long"), 4).otherwise(0)
    marks = F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)
    return F.get(F.transform(F.array(words), of), F.lit(0)) + shouts + marks


def levels(text: Column, blocks: Sequence[int] = BLOCKS) -> dict[str, Column]:
    """What splits texts, in order: the length, then a hash for each block of code points."""
    starts, ends = [0, *blocks], [*blocks, (1 << 31) - 1]
    return {"length": F.char_length(text)} | {f"block{k}": F.xxhash64(F.substring(text, a + 1, b - a)) for k, (a, b) in enumerate(zip(starts, ends))}


def _hot(sizes: DataFrame, key: list[str], hot_rows: int) -> DataFrame:
    return F.broadcast(sizes.filter(F.col("n") > hot_rows).select(*key, F.lit(True).alias("hot_class")))


def _in_classes(rows: DataFrame, sizes: DataFrame, key: list[str], hot_rows: int) -> DataFrame:
    """``rows`` whose ``key`` is in ``sizes`` (key, n, and what else it has)."""
    marked = rows.join(_hot(sizes, key, hot_rows), key, "left")
    hot = marked.filter("hot_class").join(F.broadcast(sizes.filter(F.col("n") > hot_rows)), key)
    cold = marked.filter("hot_class IS NULL").join(sizes.filter(F.col("n") <= hot_rows), key)
    return hot.unionByName(cold).drop("hot_class", "n")


def refine(rows: DataFrame, key: Sequence[str], hot_rows: int) -> DataFrame:
    """Rows that share the whole ``key`` with another row, split by one column after another.

    Each round counts the classes of the rows still there and drops those of one row.
    """
    for k in range(1, len(key) + 1):
        sizes = rows.groupBy(*key[:k]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = scratch.keep(_in_classes(rows, sizes, list(key[:k]), hot_rows), f"refined-{k}")
    return rows


def copies(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: Sequence[int] = BLOCKS, most: int = MOST_CLASSES) -> DataFrame:
    """Of ``rows``, a stored table made from ``docs`` with a column ``id`` and those of
    :func:`levels`, the ones whose text is that of a smaller id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = levels(text, blocks)
    key, hot_rows = list(split), max(256, rows.count() // 100_000)
    left = refine(rows, key, hot_rows)
    sizes = scratch.keep(left.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "copy-classes")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("body"), *[c.alias(n) for n, c in split.items()])
    if sizes.count() <= most:
        texts = texts.join(F.broadcast(sizes.select(*key)), key, "left_semi")
    else:
        texts = _in_classes(texts, sizes, key, hot_rows)
    groups = scratch.keep(texts.groupBy(*key, "body").agg(F.min("id").alias("least")), "equal-texts")
    classes = scratch.keep(groups.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least")).join(sizes, key), "classes-by-text")
    # a class is one text, unless different texts have the same hashes
    found = _in_classes(left, classes.filter("texts = 1").drop("texts"), key, hot_rows).filter(F.col("id") > F.col("least")).drop("least")
    mixed = classes.filter("texts > 1").select(*key)
    if mixed.isEmpty():
        return found
    bodies = texts.join(mixed, key, "left_semi").join(groups, [*key, "body"])
    times = bodies.filter(F.col("id") > F.col("least")).groupBy(*key, "id").agg(F.count(F.lit(1)).alias("times"))
    nth = F.row_number().over(W.partitionBy(*key, "id").orderBy("id"))
    return found.unionByName(left.join(times, [*key, "id"]).withColumn("nth", nth).filter("nth <= times").drop("nth", "times"))


def failed_filters(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", blocks: Sequence[int] = BLOCKS, most: int = MOST_CLASSES
) -> DataFrame:
    """A row per document: (id, part, mask, good, toxic); the mask has a bit for each failed
    filter, 16 for copies. ``labels`` has (doc_id, quality, toxic)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = levels(text, blocks)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_failures(text).alias("mask"),
        F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in split.items()],
    )
    rows = scratch.keep(rows, "filter-bits")
    again = copies(docs, rows, id_col, text_col, blocks, most).select("row", F.lit(True).alias("copy"))
    rows = rows.join(again, "row", "left").select("id", "part", (F.col("mask") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))
    if labels is None:
        return rows.select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("g"), F.bool_or(F.col("toxic") == 1).alias("t"))
    # as stored tables, so that rows of an id that repeats can be split among tasks
    rows, known = scratch.keep(rows, "failed-filters"), scratch.keep(known, "label-flags")
    return rows.join(known, "id", "left").select(*rows.columns, F.coalesce("g", F.lit(False)).alias("good"), F.coalesce("t", F.lit(False)).alias("toxic"))


def all_orders(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of filters and step: what the step's filter keeps, removes and loses.

    ``masks`` has a row per document (part, mask, good, toxic). They are counted per part and
    mask; a part becomes one row of 2**filters counts of each kind, and every order and step a
    sum over them.
    """
    counts = masks.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    n_masks, n_orders = 1 << len(filters), math.factorial(len(filters))
    kinds = {"docs": F.col("n"), "good": F.when(F.col("good"), F.col("n")), "toxic": F.when(F.col("toxic"), F.col("n"))}
    of = lambda mask, n: F.coalesce(F.sum(F.when(F.col("mask") == mask, n)), F.lit(0))
    parts = counts.groupBy("part").agg(*[F.array(*[of(m, n) for m in range(n_masks)]).alias(kind) for kind, n in kinds.items()])
    orders = F.array(*[F.lit("".join(order)) for order in permutations(filters)])
    bits = F.transform(F.split("filter_order", ""), lambda letter: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(filters), letter) - 1))
    rows = parts.select("*", F.explode(orders).alias("filter_order")).withColumn("bits", bits).select("*", F.posexplode("bits").alias("place", "bit"))
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("place")), F.lit(0), lambda a, b: a + b))
    bit, before = F.col("bit"), F.col("before")

    def total(kind: str, test, weight=lambda m: F.lit(1)) -> Column:
        """Sum of the counts of masks that pass the test."""
        return F.aggregate(F.transform(kind, lambda n, m: F.when(test(m), n * weight(m)).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n)

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    # of k failed filters, each is first in one of k orders
    share = F.array(*[F.lit(n_orders // max(1, m.bit_count())) for m in range(n_masks)])
    return rows.select(
        "part", "filter_order", (F.col("place") + 1).alias("step"),
        total("docs", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("docs", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("docs", lambda m: fails(m) & gone(m)).alias("redundant"), total("docs", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"), total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        total("docs", fails, lambda m: F.get(share, m)).alias("shapley"),
    )
