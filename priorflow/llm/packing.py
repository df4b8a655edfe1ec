"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenised once into a table in the shared folder. A document is cut into full
pieces, which are sequences by themselves, and one last piece. Only the histogram of last
pieces' lengths, at most ``size`` numbers, reaches the driver. There lengths are placed
longest first, all of one length together: into the packs with most room (the shortest),
or else into new packs; packs are counts of patterns, so work depends on ``size`` alone.
Patterns then join back to documents by the rank of each piece among those of its length.

Ranks are counted in parts by hash, so that a length that a third of all documents have is
no single task.

Defined results: null and empty texts are the end id alone; rows and ids that repeat are
packed each; pieces keep their document's order of ids; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import bytewords, scratch
from .tokens import shared


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_tokens, ids): ids as little-endian unsigned 32-bit integers with the end id."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        for batch in batches:
            for i, rows in bytewords.slices(batch.column(1)):
                ids = [x + end for x in shared(tokenizer_path).encode(rows.to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(rows)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(encode, schema).select(F.monotonically_increasing_id().alias("row"), "id", "n_tokens", "ids")


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) patterns that hold exactly ``counts[length]`` pieces of each length."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []  # heap of -room
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(times: int, lengths: tuple[int, ...], room: int) -> None:
        if room == 0:
            done.append((times, lengths))
            return
        if not by_room.get(room):
            heapq.heappush(rooms, -room)
        by_room.setdefault(room, []).append((times, lengths))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        placed = []
        while left:
            while rooms and not by_room.get(-rooms[0]):
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < length:
                fill = size // length  # copies a new pack can take
                placed += [(left // fill, (length,) * fill, size - fill * length)] if left >= fill else []
                if left % fill:
                    placed.append((1, (length,) * (left % fill), size - (left % fill) * length))
                break
            times, lengths = by_room[room].pop()
            fill = min(room // length, left)
            whole = min(times, left // fill)
            placed.append((whole, lengths + (length,) * fill, room - fill * length))
            if whole < times:
                put(times - whole, lengths, room)
            left -= whole * fill
        for times, lengths, room in placed:
            put(times, lengths, room)
    return done + [p for group in by_room.values() for p in group]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) for all ranks."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            out.append((length, rank, rank + times, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return out


#: Up to so many rows of ranks' beginnings are broadcast; more are joined as the ranks lie.
MOST_OFFSETS = 1_000_000


def pack(tokens: DataFrame, size: int = 1024, spread: int | None = None, payload=None, part_rows: int = 200_000) -> DataFrame:
    """Pieces of :func:`tokenise` rows: (row, id, n_tokens, start, length, sequence_id, offset, ...).

    ``payload(ids, start, length)`` says what is kept of each piece's bytes: the bytes
    themselves, unless given. Documents whose last pieces are equally long are ranked in
    ``spread`` parts, unless given as many as keep a part near ``part_rows`` documents even if
    all were equally long.
    """
    spark = tokens.sparkSession
    spread = spread or max(64, -(-tokens.count() // part_rows))
    if payload is None:
        payload = lambda ids, start, length: F.substring(ids, (4 * start + 1).cast("int"), (4 * length).cast("int"))
    full = F.floor(F.col("n_tokens") / size)
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / size)), lambda i: i * size)
    piece = lambda s: F.struct(s.alias("start"), F.least(F.lit(size).cast("long"), F.col("n_tokens") - s).alias("length"), payload(F.col("ids"), s, F.least(F.lit(size).cast("long"), F.col("n_tokens") - s)).alias("payload"))
    rows = tokens.select("row", "id", "n_tokens", full.alias("n_full"), (F.col("n_tokens") % size).alias("rest"), F.pmod(F.xxhash64("row"), F.lit(spread)).cast("int").alias("part"), F.transform(starts, piece).alias("pieces"))

    tallies = tokens.select(full.alias("n_full"), (F.col("n_tokens") % size).alias("rest"), F.pmod(F.xxhash64("row"), F.lit(spread)).cast("int").alias("part"))
    tallies = scratch.keep(tallies.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("n_full")), "length-tallies")  # size * spread rows at most
    before = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = {r.rest: (r.n, r.n_full) for r in tallies.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("n_full").alias("n_full")).collect()}
    patterns = pack_histogram({length: n for length, (n, _) in counts.items() if length}, size)
    whole_from, base = {}, sum(times for times, _ in patterns)
    for length in sorted(counts):
        whole_from[length] = base
        base += counts[length][1]
    offsets = tallies.select("rest", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_from"), F.coalesce(F.sum("n_full").over(before), F.lit(0)).alias("full_from"))
    base_of = spark.createDataFrame(list(whole_from.items()) or [(0, 0)], "rest long, full_base long")
    slots = spark.createDataFrame(places(patterns), "rest long, lo long, hi long, first_sequence long, offset long")

    own = W.partitionBy("rest", "part").orderBy("row")
    ranked = (
        rows.withColumn("nth", F.row_number().over(own) - 1)
        .withColumn("full_nth", F.coalesce(F.sum("n_full").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(offsets) if spread * size <= MOST_OFFSETS else offsets, ["rest", "part"])
        .join(F.broadcast(base_of), "rest")
        .withColumn("rank", F.col("rank_from") + F.col("nth"))
    )
    slots = slots.withColumnRenamed("rest", "slot_rest")
    placed = ranked.join(F.broadcast(slots), (F.col("rest") == F.col("slot_rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    last = F.col("first_sequence") + F.col("rank") - F.col("lo")
    return placed.select("row", "id", "n_tokens", F.col("full_base").alias("b"), "full_from", "full_nth", last.alias("last"), F.col("offset").alias("o"), F.posexplode("pieces").alias("pos", "p")).select(
        "row", "id", "n_tokens", "p.start", "p.length", "p.payload",
        F.when(F.col("p.length") == size, F.col("b") + F.col("full_from") + F.col("full_nth") + F.col("pos")).otherwise(F.col("last")).alias("sequence_id"),
        F.when(F.col("p.length") == size, F.lit(0)).otherwise(F.col("o")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", payload=None) -> DataFrame:
    """Tokenise ``docs`` into a table and pack it."""
    scratch.small_batches(docs.sparkSession)
    return pack(scratch.keep(tokenise(docs, tokenizer_path, end_id, id_col, text_col), "tokens"), size, payload=payload)
