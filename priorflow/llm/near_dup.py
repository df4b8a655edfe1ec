"""Near-duplicate classes by consistent weighted sampling.

Texts with equal word sequences form a *node*. A node's weighted set holds its shingles of
``width`` consecutive words (all words, if fewer), weighted by TF times IDF:

* TF is ``1 + floor(log2(count))``;
* IDF is 1 less 0.05 for every factor of 4 by which the share of documents that hold the
  shingle exceeds 2**-12, and 0.8 at least: a logarithm of the share, in whole steps, that no
  group of copies can bring so low that its members' other words decide. Shares come from a
  count-min sketch over all documents. Its size is fixed, and each cell is freed of what
  other shingles put there on average, so that a shingle of its own keeps 1.0 however long
  texts are.

Improved consistent weighted sampling draws 64 samples of each set: two sets share a sample
with a probability of their weighted Jaccard similarity. Samples are banded (16 bands of 4);
nodes of a band's bucket are first compared with the bucket's least node, and pairs are
verified by the exact weighted Jaccard similarity of all shingles. Nodes of buckets that
still hold several classes are dealt anew by the rarest shingles of which two similar sets
must share one (prefix filter), and each in turn is a head there, compared with all nodes
of other classes that share enough with any set to be similar, until every bucket has one class or all its nodes were heads. So two
similar nodes of a band's bucket always end in one class; a link is missed only if no band
proposes it. Classes are connected components of verified links.

Sampling draws one table of (r, c, beta) triples for each possible weight and looks hashes
up there; equal shingles with equal weights so get equal samples in every task.

Defined results: documents without words (null, empty or only marks) are classes of their
own; rows that repeat, and ids that repeat, fall in the class of their text; the class id is
the smallest id in the class (null only if all its ids are); an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords, scratch

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 4
_SIZE, _DEPTH, _BLOCK = 1 << 19, 2, 1 << 13
#: Shares of documents above which a shingle's IDF falls by one step.
_SHARES = (2.0**-10, 2.0**-8, 2.0**-6, 2.0**-4)
_TABLE = 14  # bits of a row of random triples
_TF_LEVELS = 24
#: Nodes from which on a bucket of shingles is large.
_LARGE = 64


def _combine(columns: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(columns[0]), 0x2545F4914F6CDD1D, np.uint64)
    for column in columns:
        out = bytewords.mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def shingles(words: np.ndarray, first: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, their counts, and where each text's begin."""
    n = len(words)
    counts = np.diff(first)
    windows = _combine([words[k : n - width + 1 + k] for k in range(width)]) if n >= width else np.zeros(0, np.uint64)
    found, times, sizes = [], [], np.zeros(len(counts), np.int64)
    for i, (a, m) in enumerate(zip(first[:-1].tolist(), counts.tolist())):
        if m == 0:
            continue
        own = windows[a : a + m - width + 1] if m >= width else _combine([words[a + k : a + k + 1] for k in range(m)])
        own, count = np.unique(own, return_counts=True)
        found.append(own)
        times.append(count)
        sizes[i] = len(own)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), begins
    return np.concatenate(found), np.concatenate(times), begins


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(64 - _SIZE.bit_length() + 1)
    return [((hashes * np.uint64(m)) >> bits).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Weights:
    """IDF steps by sketch place, and the tables of samples for each weight."""

    def __init__(self, steps: np.ndarray, seed: int = 20):
        self.steps, self.seed = steps, seed  # steps: (depth, size) uint8
        self._tables = None

    def __getstate__(self):
        return {"steps": self.steps, "seed": self.seed, "_tables": None}

    def levels(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A small integer for each weight: 5 times the TF level plus the IDF step."""
        step = np.minimum.reduce([self.steps[k][place] for k, place in enumerate(_places(hashes))])
        tf = np.minimum(np.frexp(counts.astype(np.float64))[1] - 1, _TF_LEVELS - 1)
        return (5 * tf + step).astype(np.uint8)

    @staticmethod
    def weight(level: np.ndarray) -> np.ndarray:
        level = level.astype(np.float64)
        return (1 + level // 5) * (1 - 0.05 * (level % 5))

    def _draws(self):
        rng = np.random.Generator(np.random.PCG64(self.seed))
        n = 1 << _TABLE
        r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
        rows = []
        for level in range(5 * _TF_LEVELS):
            w = float(self.weight(np.array(level)))
            t = np.floor(np.log(w) / r + beta)
            rows.append(None if w <= 0 else (c * np.exp(-r * (t - beta) - r)).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32))
        keys = np.random.Generator(np.random.PCG64(self.seed + 1)).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
        self._tables = (np.concatenate(rows), keys[0], keys[1] * np.uint64(2) + np.uint64(1))

    def bands(self, hashes: np.ndarray, levels: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(texts, BANDS) band hashes; texts must all have a shingle."""
        if self._tables is None:
            self._draws()
        table, salts, factors = self._tables
        base = levels.astype(np.uint64) << np.uint64(_TABLE)
        out = np.zeros((len(begins) - 1, BANDS), np.uint64)
        low, shift = np.uint64(0xFFFFFFFF), np.uint64(64 - _TABLE)
        for band in range(BANDS):
            mixed = np.full(len(begins) - 1, band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                x = (hashes ^ salts[k]) * factors[k]
                x ^= x >> np.uint64(29)
                sample = np.minimum.reduceat(table[(base | (x >> shift)).astype(np.int64)] | (x & low), begins[:-1])
                mixed = bytewords.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + sample)
            out[:, band] = mixed
        return out


def _document_shares(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """IDF steps from a count-min sketch of document counts over all documents."""

    def count(batches):
        sketch, n = np.zeros((_DEPTH, _SIZE), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, rows in bytewords.slices(batch.column(0)):
                words = bytewords.Words(rows)
                hashes, _, _ = shingles(words.hashes(), words.first, width)
                for k, place in enumerate(_places(hashes)):
                    sketch[k] += np.bincount(place, minlength=_SIZE)
        flat = sketch.reshape(-1, _BLOCK)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in flat], pa.binary()), pa.array([n] * len(flat), pa.int64())], names=["block", "counts", "n"])

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for block, counts, n in zip(*(c.to_pylist() for c in batch.columns)):
                have = total.setdefault(block, [np.zeros(_BLOCK, np.int64), 0])
                have[0] += np.frombuffer(counts, np.int64)
                have[1] += n
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v[0].tobytes() for v in total.values()], pa.binary()), pa.array([v[1] for v in total.values()], pa.int64())], names=["block", "counts", "n"]
            )

    schema = "block int, counts binary, n long"
    parts = docs.select(text_col).mapInArrow(count, schema)
    blocks = parts.repartition("block").mapInArrow(add, schema).collect()  # _DEPTH * _SIZE / _BLOCK rows of 64 KB, whatever the input
    cells, n = np.zeros((_DEPTH * _SIZE // _BLOCK, _BLOCK), np.int64), max([1, *(b.n for b in blocks)])
    for b in blocks:
        cells[b.block] = np.frombuffer(b.counts, np.int64)
    return idf_steps(cells.reshape(_DEPTH, _SIZE), n)


def idf_steps(cells: np.ndarray, n: int) -> np.ndarray:
    """IDF steps of a sketch of ``n`` documents; a cell's count is less what the other cells
    have on average, rounded to whole documents."""
    others = np.rint((cells.sum(1, keepdims=True) - cells) / (cells.shape[1] - 1))
    share = (cells - others) / n
    return sum((share > s).astype(np.uint8) for s in _SHARES)


def _signatures(docs: DataFrame, id_col: str, text_col: str, weights, width: int) -> DataFrame:
    """(id, text_key, node, bands): 16 bytes for the word sequence (null without words) and band hashes."""

    def sign(batches):
        own = weights.value
        for batch in batches:
            ids, keys, texts = batch.columns
            for i, rows in bytewords.slices(texts):
                words = bytewords.Words(rows)
                hashed = words.hashes()
                some = np.flatnonzero(np.diff(words.first))
                nodes: list[bytes | None] = [None] * len(rows)
                bands: list[np.ndarray | None] = [None] * len(rows)
                if len(some):
                    hashes, counts, begins = shingles(hashed, words.first, width)
                    table = own.bands(hashes, own.levels(hashes, counts), np.concatenate((begins[:-1][some], begins[-1:])))
                    names = bytewords.digests(hashed, words.first)
                    for k, j in enumerate(some.tolist()):
                        nodes[j], bands[j] = names[j], table[k].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(rows)), keys.slice(i, len(rows)), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "text_key", "node", "bands"]
                )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(sign, schema)


def _weighted_sets(texts: DataFrame, weights, width: int) -> DataFrame:
    """(node, hashes, levels) of (text) rows."""

    def build(batches):
        own = weights.value
        for batch in batches:
            for _, rows in bytewords.slices(batch.column(0)):
                words = bytewords.Words(rows)
                hashed = words.hashes()
                hashes, counts, begins = shingles(hashed, words.first, width)
                levels = own.levels(hashes, counts)
                names = bytewords.digests(hashed, words.first)
                spans = [(i, a, b) for i, (a, b) in enumerate(zip(begins[:-1], begins[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i, _, _ in spans], pa.binary()), pa.array([hashes[a:b].tobytes() for _, a, b in spans], pa.binary()), pa.array([levels[a:b].tobytes() for _, a, b in spans], pa.binary())],
                    names=["node", "hashes", "levels"],
                )

    return texts.mapInArrow(build, "node binary, hashes binary, levels binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending hashes, levels)."""
    wa, wb = Weights.weight(a[1]), Weights.weight(b[1])
    _, i, j = np.intersect1d(a[0], b[0], True, True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both / max(float(wa.sum() + wb.sum()) - both, 1e-12)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b, similarity) of ``pairs`` (a, b) that reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("levels").alias("la"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("levels").alias("lb"))

    def compare(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            views = [[np.frombuffer(x.as_buffer(), t) for x in batch.column(c)] for c, t in ((2, np.uint64), (3, np.uint8), (4, np.uint64), (5, np.uint8))]
            got = np.array([weighted_jaccard((p, q), (r, s)) for p, q, r, s in zip(*views)], float)
            ok = pa.array(got >= threshold)
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok), pa.array(got).filter(ok)], names=["a", "b", "similarity"])

    joined = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return joined.select("a", "b", "ha", "la", "hb", "lb").mapInArrow(compare, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of ``edges`` (a, b) is linked to.

    Labels spread over links and jump to their label's label; each round is written to the
    shared folder, and a round that changes nothing ends the loop.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = scratch.keep(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")), "labels")
        labels = new.select("node", "root")
        if new.filter("moved").isEmpty():
            return labels


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """``labels`` after new links: only the classes they join are worked again."""
    if labels is None:
        return components(found)
    root = lambda column: found.select("a", "b").join(labels.withColumnRenamed("node", column).withColumnRenamed("root", f"root_{column}"), column, "left").select("a", "b", f"root_{column}")
    both = root("a").join(root("b"), ["a", "b"]).select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b")
    moved = scratch.keep(components(both), "moved").select(F.col("node").alias("old"), F.col("root").alias("new"))
    kept = labels.join(moved, labels.root == moved.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    added = moved.join(labels, moved.old == labels.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return scratch.keep(kept.unionByName(added), "labels")


def _cells(sets: DataFrame) -> DataFrame:
    """(bucket, node, weight, total) of every shingle; ``total`` is its set's weight."""

    def open_up(batches):
        for batch in batches:
            nodes, hashes, levels = batch.columns
            sizes = [len(v.as_buffer()) for v in levels]
            flat = np.frombuffer(b"".join(h.as_buffer() for h in hashes), np.int64)
            weight = Weights.weight(np.frombuffer(b"".join(v.as_buffer() for v in levels), np.uint8))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(owner, weight, len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(flat), nodes.take(pa.array(owner)), pa.array(weight.astype(np.float32)), pa.array(total[owner])], names=["bucket", "node", "weight", "total"])

    return sets.select("node", "hashes", "levels").mapInArrow(open_up, "bucket long, node binary, weight float, total double")


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, total, common): the shingles, rarest in ``sets`` first, of which two sets
    that reach ``threshold`` share one.

    The overlap of such sets is at least ``threshold`` times either weight, so it can't lie
    only in a rest that weighs less. Shingles that one set alone has are no buckets, and what
    the others weigh, ``common``, bounds a set's overlap with any other.
    """

    def cut(batches):
        for batch in batches:
            nodes, totals, cells = batch.columns
            common, places, found = [], [], []
            for i, (total, own) in enumerate(zip(totals.to_pylist(), cells)):
                n, bucket, weight = (own.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                order = np.lexsort((bucket, n))
                rest = np.cumsum(weight[order][::-1].astype(np.float64))[::-1]  # from each shingle on
                kept = bucket[order][rest >= threshold * total - 1e-3]
                common.append(rest[0])
                places.append(np.full(len(kept), i))
                found.append(kept)
            if found:
                at = pa.array(np.concatenate(places))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), nodes.take(at), totals.take(at), pa.array(common).take(at)], names=["bucket", "node", "total", "common"])

    cells = scratch.keep(_cells(sets), "cells")
    counts = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = cells.join(counts, "bucket").groupBy("node").agg(F.first("total").alias("total"), F.collect_list(F.struct("n", "bucket", "weight")).alias("cells"))
    return lists.select("node", "total", "cells").mapInArrow(cut, "bucket long, node binary, total double, common double")


def _rooted(members: DataFrame, labels: DataFrame, turn: int = 0) -> DataFrame:
    """``members`` with their ``root``, of buckets that hold several classes and a head of ``turn`` or later."""
    named = members.drop("root").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = named.groupBy("bucket").agg(F.max("turn").alias("last"), F.min("root").alias("x"), F.max("root").alias("y"))
    return named.join(ends.filter((F.col("x") != F.col("y")) & (F.col("last") >= turn)).select("bucket"), "bucket")


def _links(members: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) of ``members`` (bucket, node), and (node, root)."""
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"))
    pairs = members.join(heads, "bucket").filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    seen = scratch.keep(pairs, "pairs")
    links = scratch.keep(_verified(seen, sets, threshold), "verified")
    labels = components(links)

    open_nodes = _rooted(members.withColumn("turn", F.lit(0)), labels).select("node").distinct()
    parts = scratch.keep(_prefixes(sets.join(open_nodes, "node", "left_semi"), threshold), "prefixes")
    sizes = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # a hash deals the nodes of a bucket to turns of about 3, 12, 48, ... heads
    place = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)) / float(1 << 30) * F.col("size")
    dealt = scratch.keep(parts.join(sizes, "bucket").withColumn("turn", F.floor(F.log2(place + 1) / 2).cast("int")), "dealt")
    # two nodes that share several large buckets only meet in the least of them
    large = dealt.filter(F.col("size") >= _LARGE).groupBy("node").agg(F.collect_list("bucket").alias("large"))
    lesser = F.when(F.col("size") >= _LARGE, F.filter("large", lambda b: b < F.col("bucket"))).otherwise(F.array().cast("array<long>"))
    dealt = dealt.join(large, "node", "left").withColumn("lesser", lesser).drop("large")
    # no overlap is beyond what either set shares with any other
    may_reach = (1 + threshold) * F.least("common", "head_common") >= threshold * (F.col("total") + F.col("head_total")) - 1e-3
    live, turn = scratch.keep(_rooted(dealt, labels), "live"), 0
    while not live.isEmpty():
        salts = F.ceil(F.col("size") / 1000)
        ahead = live.filter(F.col("turn") == turn).select(
            "bucket", F.col("node").alias("head"), F.col("root").alias("head_root"), F.col("total").alias("head_total"), F.col("common").alias("head_common"), F.col("lesser").alias("head_lesser"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")
        )
        pairs = (
            live.filter(F.col("turn") >= turn).withColumn("salt", F.pmod(F.xxhash64("node"), salts)).join(ahead, ["bucket", "salt"])
            .filter((F.col("root") != F.col("head_root")) & may_reach & ~F.arrays_overlap("lesser", "head_lesser") & ((F.col("turn") > turn) | (F.col("node") > F.col("head"))))
            .select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
            .distinct()
        )
        pairs = scratch.keep(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = seen.unionByName(pairs)
        found = scratch.keep(_verified(pairs, sets, threshold), "verified")
        if not found.isEmpty():
            links, labels = links.unionByName(found), _relabelled(labels, found)
        turn += 1
        live = scratch.keep(_rooted(live, labels, turn), "live")
    return links, labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH
) -> DataFrame:
    """One row per row of ``docs``: (id, node, class_id, class_size, links).

    ``class_size`` counts rows, ``links`` the verified links of the row's text to others; pairs
    that other links had put in one class before aren't compared and don't count.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    weights = spark.sparkContext.broadcast(Weights(_document_shares(docs, text_col, width)))
    rows = scratch.keep(_signatures(docs, id_col, text_col, weights, width), "signatures")
    words = rows.filter(F.col("node").isNotNull())
    nodes = scratch.keep(words.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "nodes")

    members = nodes.select("node", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    members = scratch.keep(members.join(full, "bucket"), "members")
    needed = members.select("node").distinct()
    ids = nodes.join(needed, "node").select(F.col("least").alias(id_col)).distinct()
    texts = docs.select(id_col, text_col).join(ids, docs[id_col].eqNullSafe(ids[id_col]), "left_semi").select(text_col)
    sets = scratch.keep(_weighted_sets(texts, weights, width).join(needed, "node", "left_semi").dropDuplicates(["node"]), "weighted-sets")

    links, labels = _links(members, sets, threshold)
    links = links.select("a", "b").distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    placed = nodes.select("node", "least", "n").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    named = placed.join(classes, "root").join(degree, "node", "left").select("node", "root", "class_id", "class_size", "links")
    return rows.select("id", "text_key", "node").join(named, "node", "left").select(
        "id", "text_key", "node", "root",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, and of equal rows any one."""
    classes = scratch.keep(near_duplicates(docs, id_col, text_col, **options).filter(F.col("node").isNotNull()).select("id", "text_key", "root"), "classes")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key"))
    heads = classes.groupBy("root").agg(F.min(first).alias("head"))
    marked = classes.join(heads, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_key") == F.col("head.text_key")))
    go = marked.filter(~F.col("stays")).select("id", "text_key").distinct()
    again = marked.filter("stays").groupBy("id", "text_key").count().filter("count > 1").select("id", "text_key")
    here = docs[id_col], F.xxhash64(docs[text_col])
    same = lambda other: here[0].eqNullSafe(other["id"]) & (here[1] == other["text_key"])
    kept = docs.join(go, same(go), "left_anti")
    unique = kept.join(again, same(again), "left_anti")
    repeated = kept.join(again, same(again), "left_semi").dropDuplicates([id_col, text_col])
    return unique.unionByName(repeated)
