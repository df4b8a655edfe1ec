"""How far the sources of a language are from each other and from the whole, term by term.

Terms are runs of letters (A-Z a-z and everything beyond ASCII), with A-Z lower-cased. A
language keeps the terms that ``min_docs`` of its documents or more hold. Each (language,
source) group, and each language, gives each kept term ``p = 1 + floor(SCALE * (count + 1) /
(N + V))``; a group is ``sum(floor((p - q)**2 / q))`` away from another one.

Kept terms are dealt to blocks by their hash. A block is one dense tile of int64, its
language's groups by its terms, of up to about ``cells`` numbers: all pairs of its groups are
worked out by broadcasting, some rows of the tile at a time, and each group's best terms
come from the tile as a heap of ``top``. The partial pair matrices are summed and the heaps
merged by Spark; the heaps are cut before they are shuffled.

All arithmetic is exact in 64 bits as long as a group has fewer than 9 * 10**15 terms in all
and pair values stay below 2**63 (the sum of p of a group is about 10**9 + V).

Defined results: null text, language and source are empty strings; groups without terms are
groups, and a language without kept terms gives its pairs the value 0; rows that repeat
count each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch
from .bytewords import Words, slices

SCALE = 1_000_000_000
#: Byte -> lower-cased byte of a term, or 0 between terms.
TERM_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_FOUND = "lang string, source string, part string, item string, value long"


def _term_counts(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of some texts: occurrences, and documents that hold the term."""
    words = Words(texts, TERM_BYTES)
    lengths = words.ends - words.starts
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(words.bytes[words.bytes != 0])]).dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
    in_doc = pa.table({"doc": doc, "code": terms.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    found = pa.table({"group": group[in_doc["doc"].to_numpy()], "code": in_doc["code"], "n": in_doc["count_all"]})
    found = found.group_by(["group", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table({"group": found["group"], "term": pc.take(terms.dictionary, found["code"]).cast(pa.string()), "n": found["n_sum"], "docs": found["count_all"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    if len(tables) == 1:
        return tables[0]
    both = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return both.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTS.names)


def _count(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, put together before they leave it; up to ``most`` rows are held."""
    held, rows = [], 0
    for batch in batches:
        names = pa.table({"lang": batch.column(0), "source": batch.column(1), "at": np.arange(len(batch))})
        groups = names.group_by(["lang", "source"], use_threads=False).aggregate([("at", "list")])
        group = np.zeros(len(batch), np.int64)
        for k, at in enumerate(groups["at_list"].combine_chunks()):
            group[at.values.to_numpy()] = k
        for first, texts in slices(batch.column(2), 4 << 20):
            found = _term_counts(texts, group[first : first + len(texts)])
            held.append(pa.table({"lang": pc.take(groups["lang"], found["group"]), "source": pc.take(groups["source"], found["group"]), "term": found["term"], "n": found["n"], "docs": found["docs"]}).cast(_COUNTS))
            rows += len(found)
            if rows > most:
                held = [_merged(held)]
                if len(held[0]) > most // 2:
                    yield from held.pop().to_batches(1 << 16)
                rows = sum(map(len, held))
    if held:
        yield from _merged(held).to_batches(1 << 16)


def shares(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """``1 + floor(SCALE * (counts + 1) / totals)``, three decimal digits at a time so that
    nothing overflows."""
    rest = counts + 1
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


def tile(counts: np.ndarray, totals: np.ndarray, vocabulary: int, top: int, cells: int) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Of one block: the pair matrix (row's distance to column), and per group its best
    (term, value), best first; ties in the order of terms.

    ``counts`` is groups by terms, ``totals`` the groups' counts of all kept terms.
    """
    n, width = counts.shape
    pairs, best = np.zeros((n, n), np.int64), [[] for _ in range(n)]
    if not width:
        return pairs, best
    p = shares(counts, (totals + vocabulary)[:, None])
    q = shares(counts.sum(0), int(totals.sum()) + vocabulary)
    for i in range(n):
        for j in range(0, n, step := max(1, cells // width)):
            gap = p[i][None, :] - p[j : j + step]
            pairs[i, j : j + step] = (gap * gap // p[j : j + step]).sum(1)
        ahead = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        gap = p[i][ahead] - q[ahead]
        value = gap * gap // q[ahead]
        order = np.argsort(-value, kind="stable")[:top]
        best[i] = list(zip(ahead[order].tolist(), value[order].tolist()))
    return pairs, best


def _tiles(top: int, cells: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        sources, lang = right["source"].to_pylist(), right["lang"][0].as_py()
        terms = pc.unique(left["term"]).sort() if len(left) else pa.array([], pa.string())
        counts = np.zeros((len(sources), len(terms)), np.int64)
        if len(left):
            row, column = pc.index_in(left["source"], right["source"]), pc.index_in(left["term"], terms)
            counts[row.to_numpy(), column.to_numpy()] = left["n"].to_numpy()
        pairs, best = tile(counts, right["total"].to_numpy(), right["vocabulary"][0].as_py(), top, cells)
        i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = right["source"].combine_chunks()
        held = [len(b) for b in best]
        at = pa.array([k for b in best for k, _ in b], pa.int64())
        return pa.table({
            "lang": pa.array([lang] * (len(i) + sum(held)), pa.string()),
            "source": pa.concat_arrays([names.take(pa.array(i)), names.take(pa.array(np.repeat(np.arange(len(sources)), held)))]),
            "part": pa.array(["pair"] * len(i) + ["term"] * sum(held), pa.string()),
            "item": pa.concat_arrays([names.take(pa.array(j)), terms.take(at)]),
            "value": pa.array(np.concatenate([pairs[i, j], np.array([v for b in best for _, v in b], np.int64)]), pa.int64()),
        })

    return work


def _with(df: DataFrame, other: DataFrame, on: str, most: int = 100_000) -> DataFrame:
    """A join with a table of one row per ``on``, by broadcast only if it has few rows."""
    return df.join(F.broadcast(other) if other.count() <= most else other, on)


def divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, cells: int = 1 << 20
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the
    language by their distance, part ``term`` the ``top`` terms that the source has more of
    than the language."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # all rows of a (lang, term) lie together, so counts and documents need one shuffle
    counts = plain.mapInArrow(lambda batches: _count(batches), "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    kept = counts.withColumn("held", F.sum("docs").over(term)).withColumn("nth", F.row_number().over(term.orderBy("source")))
    kept = scratch.keep(kept.filter(F.col("held") >= min_docs).select("lang", "source", "term", "n", (F.col("nth") == 1).alias("is_first")), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("total"))
    groups = scratch.keep(groups, "divergence-groups")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(kept.groupBy("lang").agg(F.count_if("is_first").alias("v")), "lang", "left")
    sizes = sizes.select("lang", F.coalesce("v", F.lit(0)).alias("vocabulary"), F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) * F.col("groups") / cells)).alias("blocks"))
    sizes = scratch.keep(sizes, "divergence-sizes")
    dealt = _with(kept, sizes.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    each = _with(groups, sizes, "lang").select("lang", "source", "total", "vocabulary", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    found = dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(_tiles(top, cells), _FOUND)
    found = scratch.keep(found, "divergence-tiles")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
