"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one node with the smallest ids of its rows. Nodes are dealt to shards of
about ``shard_rows`` by a hash. In each shard a graph is built in two passes: a greedy
search from the medoid proposes candidates for each node, and robust pruning keeps the
nearest candidate and drops those it covers (``alpha * d(kept, c) <= d(node, c)``), which
keeps edges that point different ways. Links are made both ways and pruned again where a
node has too many. Queries run a beam search in every shard, in blocks, and the best of all
shards are merged. Graphs are tables in the shared folder, so a lost executor costs only its
tasks.

Nearness is the cosine in double precision on the original vectors; searches use normalised
copies in single precision, and results are scored anew.

Defined results: vectors that are null, empty, zero, or hold null or non-finite parts take no
part; vectors of other lengths only meet their own; repeated rows and equal vectors are all
candidates, ties going to smaller ids; a query without other candidates gives no row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import scratch

DEGREE, BEAM, ALPHA, SHARD_ROWS, QUERY_BLOCK = 24, 64, 1.2, 4096, 4096
#: A dim of fewer shards has copies of them, up to so many tasks.
TASKS = 64


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest part is near 1: cosines stay, and no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    return (vectors / norms[:, None]).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query (rows in step) the ``beam`` nearest nodes met, nearest first: (nodes, distances).

    ``graph`` holds neighbours, -1 where there are fewer. Distances are 1 - cosine; missing
    places have node -1 and distance infinity.
    """
    n_q, n = len(queries), len(points)
    beam = min(beam, n)
    nodes = np.full((n_q, beam), -1, np.int64)
    dist = np.full((n_q, beam), np.inf, np.float32)
    done = np.ones((n_q, beam), bool)
    nodes[:, 0], dist[:, 0], done[:, 0] = entry, 1 - queries @ points[entry], False
    seen = np.zeros((n_q, n), bool)
    seen[:, entry] = True
    live = np.arange(n_q)
    while len(live):
        todo = np.where(done[live], np.inf, dist[live])
        best = todo.argmin(axis=1)
        more = np.isfinite(todo[np.arange(len(live)), best])
        live, best = live[more], best[more]
        if not len(live):
            break
        done[live, best] = True
        near = graph[nodes[live, best]]
        fresh = near >= 0
        safe = np.where(fresh, near, 0)
        fresh &= ~seen[live[:, None], safe]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], safe[rows, cols]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[rows, cols] = 1 - np.einsum("ij,ij->i", queries[live[rows]], points[safe[rows, cols]])
        all_d = np.concatenate((dist[live], d), axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.arange(all_d.shape[1])[None, :].repeat(len(live), 0)
        at = np.arange(len(live))[:, None]
        dist[live] = all_d[at, order]
        nodes[live] = np.concatenate((nodes[live], np.where(fresh, near, -1)), axis=1)[at, order]
        done[live] = np.concatenate((done[live], ~fresh), axis=1)[at, order]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse candidates for each node; rows in step, candidates nearest first."""
    dist = np.where((candidates < 0) | (candidates == nodes[:, None]), np.inf, dist)
    vectors = points[np.maximum(candidates, 0)]
    between = 1 - np.einsum("bid,bjd->bij", vectors, vectors)
    out = np.full((len(nodes), degree), -1, np.int64)
    left = np.isfinite(dist)
    rows = np.arange(len(nodes))
    for k in range(degree):
        ahead = np.where(left, dist, np.inf)
        best = ahead.argmin(axis=1)
        some = np.isfinite(ahead[rows, best])
        if not some.any():
            break
        out[some, k] = candidates[rows[some], best[some]]
        left &= ~(some[:, None] & (alpha * between[rows, best] <= dist))
        left[rows[some], best[some]] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 256, seed: int = 1) -> tuple[np.ndarray, int]:
    """(neighbours, medoid) for unit vectors."""
    n = len(points)
    rng = np.random.default_rng(seed)
    entry = int((points @ points.mean(axis=0)).argmax())
    graph = np.full((n, degree), -1, np.int64)
    if n == 1:
        return graph, entry
    start = rng.integers(0, n, (n, min(degree // 2, n - 1)))
    graph[:, : start.shape[1]] = np.where(start == np.arange(n)[:, None], (start + 1) % n, start)
    for factor in (1.0, alpha):
        for part in np.array_split(rng.permutation(n), -(-n // batch)):
            near, dist = beam_search(points, graph, entry, points[part], beam)
            own = graph[part]
            own_d = np.where(own >= 0, 1 - np.einsum("bid,bd->bi", points[np.maximum(own, 0)], points[part]), np.inf)
            own_d[(own[:, :, None] == near[:, None, :]).any(axis=2)] = np.inf
            kept = robust_prune(points, part, np.concatenate((near, own), 1), np.concatenate((dist, own_d), 1), degree, factor)
            graph[part] = kept
            _link_back(points, graph, part, kept, degree, factor)
    return graph, entry


def _link_back(points, graph, part, kept, degree, alpha) -> None:
    """Add the edges (neighbour, node); where there is no room, prune old and new together."""
    rows, cols = np.nonzero(kept >= 0)
    source, target = part[rows], kept[rows, cols]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    who, begin, count = np.unique(target, return_index=True, return_counts=True)
    width = min(int(count.max(initial=0)), 2 * degree)
    place = np.arange(len(target)) - np.repeat(begin, count)
    ok = place < width
    new = np.full((len(who), width), -1, np.int64)
    new[np.repeat(np.arange(len(who)), count)[ok], place[ok]] = source[ok]
    old = graph[who]
    new[(new[:, :, None] == old[:, None, :]).any(axis=2)] = -1
    merged = np.concatenate((old, new), 1)
    size = (merged >= 0).sum(1)
    packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
    fits = size <= degree
    graph[who[fits]] = packed[fits, :degree]
    if (~fits).any():
        nodes, cand = who[~fits], packed[~fits]
        for a in range(0, len(nodes), 512):
            some, c = nodes[a : a + 512], cand[a : a + 512]
            d = np.where(c >= 0, 1 - np.einsum("bid,bd->bi", points[np.maximum(c, 0)], points[some]), np.inf)
            graph[some] = robust_prune(points, some, c, d, degree, alpha)


def _usable(vector: Column) -> Column:
    """Has parts, all of them finite, not all zero."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0),
        F.lit(False),
    )


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def build_index(vectors: DataFrame, k: int, id_col: str, vector_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: (dim, shard, n, entry, points, graph, ids); every usable row is in one.

    ``ids`` are each node's ``k + 1`` smallest, all a top-k search can need.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    # the smallest ids of equal vectors, first within parts, so that no group is gathered whole
    part = F.pmod(F.xxhash64("id"), F.lit(max(32, rows.count() // 1_000_000)))
    some = rows.withColumn("part", part).withColumn("nth", F.row_number().over(W.partitionBy("v", "part").orderBy("id"))).filter(F.col("nth") <= k + 1)
    nodes = some.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    nodes = scratch.keep(nodes.withColumn("dim", F.size("v")).withColumn("spread", F.xxhash64("v")), "vector-nodes")
    sizes = {r.dim: r["count"] for r in nodes.groupBy("dim").count().collect()}
    n_shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(max(1, -(-n // shard_rows)))) for d, n in sizes.items()], F.lit(1)) if sizes else F.lit(1)
    shards = nodes.withColumn("shard", F.pmod("spread", n_shards).cast("int"))

    def build(key, table):
        dim, shard = key[0].as_py(), key[1].as_py()
        table = table.combine_chunks().sort_by("spread")
        points = _matrix(table.column("v").combine_chunks())
        graph, entry = build_graph(unit(points))
        ids = np.full((len(points), k + 1), -1, np.int64)
        for i, own in enumerate(table.column("ids").to_pylist()):
            ids[i, : len(own)] = own
        return pa.table(
            {"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([len(points)], pa.int64()), "entry": pa.array([entry], pa.int64()),
             "points": pa.array([points.tobytes()], pa.binary()), "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary())}
        )

    # a count of its own, as small shards gathered in one task take as long as all their graphs
    total = sum(max(1, -(-n // shard_rows)) for n in sizes.values()) or 1
    schema = "dim int, shard int, n long, entry long, points binary, graph binary, ids binary"
    return scratch.keep(shards.repartition(2 * total, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, schema), "vector-graphs")


def search(
    index: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, beam: int = BEAM, block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, never its own row."""
    rows = queries.filter(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("dim", F.size("v"))
    total = rows.count()
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // block)))).cast("int"))

    def pack(key, table):
        points = _matrix(table.column("v").combine_chunks())
        ids = table.column("id").to_numpy()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "qids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([points.tobytes()], pa.binary())})

    packed = scratch.keep(blocks.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, qids binary, q binary"), "query-blocks")
    # each block goes to every shard of its dim; where shards are few, their copies share the blocks
    last = index.groupBy("dim").agg(F.max("shard").alias("last"))
    salts = F.greatest(F.lit(1), F.floor(F.lit(TASKS) / (F.col("last") + 1)).cast("int"))
    asked_of = packed.join(F.broadcast(last), "dim").withColumn("salt", F.pmod(F.col("block"), salts)).withColumn("shard", F.explode(F.sequence(F.lit(0), "last")))
    copies = packed.select("dim", "block").join(F.broadcast(last), "dim").select("dim", F.pmod(F.col("block"), salts).alias("salt")).distinct()
    tasks = asked_of.join(index.join(F.broadcast(copies), "dim").hint("merge"), ["dim", "shard", "salt"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                raw = scaled(np.frombuffer(row["points"], np.float64).reshape(-1, dim))
                points = unit(raw)
                graph = np.frombuffer(row["graph"], np.int32).reshape(len(raw), -1).astype(np.int64)
                ids = np.frombuffer(row["ids"], np.int64).reshape(len(raw), -1)
                asked, q = np.frombuffer(row["qids"], np.int64), scaled(np.frombuffer(row["q"], np.float64).reshape(-1, dim))
                for a in range(0, len(q), 512):
                    yield _answers(points, raw, graph, row["entry"], ids, asked[a : a + 512], q[a : a + 512], k, beam)

    found = tasks.select("dim", "points", "graph", "ids", "entry", "qids", "q").mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(points, raw, graph, entry, ids, asked, q, k, beam) -> pa.RecordBatch:
    near, _ = beam_search(points, graph, entry, unit(q), beam)
    near = near[:, : 2 * (k + 1)]  # more than k + 1 nodes, so that single precision loses none
    safe = np.maximum(near, 0)
    score = np.einsum("bid,bd->bi", raw[safe], q) / (np.linalg.norm(raw, axis=1)[safe] * np.linalg.norm(q, axis=1)[:, None])
    found = np.where(near[:, :, None] >= 0, ids[safe], -1).reshape(len(q), -1)
    score = np.repeat(score, ids.shape[1], axis=1)
    score = np.where((found < 0) | (found == asked[:, None]), -np.inf, score)
    order = np.lexsort((found, -score), axis=1)[:, :k]
    found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
    ok = np.isfinite(score)
    who = np.repeat(asked[:, None], order.shape[1], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(who[ok]), pa.array(found[ok]), pa.array(score[ok])], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """Build the index over all of ``vectors`` and search it for all of ``queries``."""
    scratch.small_batches(vectors.sparkSession)
    return search(build_index(vectors, k, id_col, vector_col, shard_rows), queries, k, id_col, vector_col, beam)
