"""Token-id files: documents in ascending id order, coded by :mod:`id_coder`.

Texts are range-partitioned and sorted by id, then tokenised in place and written as files
of about ``file_ids`` ids, each a row of a Parquet table in the shared folder: the coded
image, and which documents it holds. Spark's commit protocol so covers lost executors. The
range partitioning also splits by a hash of the text, so one id that a third of all rows
share is no single task.

Defined results: null and empty texts are the end id alone; rows with equal ids stand next
to each other in the order of a hash of their text; null ids come first; an empty table
gives no files; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import bytewords, id_coder, scratch
from .tokens import load, shared

FILE_IDS = 1 << 23


def write_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS
) -> None:
    """Rows (part, file, n_ids, ids, sizes, image) below ``path``; parts and files in id order."""
    scratch.small_batches(docs.sparkSession)
    vocabulary = max(load(tokenizer_path).get_vocab_size(), end_id + 1)
    end = np.array([end_id], "<u4").tobytes()
    names = ["part", "file", "n_ids", "ids", "sizes", "image"]

    def code(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, kept = [], [], []

        def flush():
            flat = np.frombuffer(b"".join(kept), "<u4")
            values = [[part], [number], [len(flat)], [list(ids)], [list(sizes)], [id_coder.encode(flat, vocabulary)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

        total = 0
        for table in bytewords.gathered(batches, 1, 4 << 20):
            for i, rows in bytewords.slices(table.column(1), 4 << 20):
                for doc, coded in zip(table.column(0).slice(i, len(rows)).to_pylist(), shared(tokenizer_path).encode(rows.to_pylist()), strict=True):
                    ids.append(doc)
                    kept.append(coded + end)
                    sizes.append(len(kept[-1]) // 4)
                    total += sizes[-1]
                    if total >= file_ids:
                        yield flush()
                        ids, sizes, kept, total = [], [], [], 0
                        number += 1
        if ids:
            yield flush()

    key = F.xxhash64(F.col(text_col))
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key.alias("key")).repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    schema = "part int, file int, n_ids long, ids array<long>, sizes array<long>, image binary"
    ordered.select("id", "text").mapInArrow(code, schema).write.option("compression", "uncompressed").parquet(path)


def read_files(spark: SparkSession, path: str, summary=None, schema: T.StructType | None = None) -> DataFrame:
    """(id, start, n_tokens, tokens) of each document; ``start`` counts the ids of all before it.

    ``summary(ids) -> value`` with its one-field ``schema`` replaces ``tokens``, the ids
    themselves, where a digest is enough.
    """
    files = spark.read.parquet(path)
    if summary is None:
        summary, schema = (lambda ids: ids.tolist()), T.StructType([T.StructField("tokens", T.ArrayType(T.LongType()))])
    field = schema.fields[0]
    out = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("file", T.IntegerType()), ("id", T.LongType()), ("before", T.LongType()), ("n_tokens", T.LongType()))] + [field])
    arrow = pa.int64() if isinstance(field.dataType, T.LongType) else pa.list_(pa.int64())

    def read(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, file, ids, sizes, image = (batch.column(c)[row] for c in range(5))
                flat = id_coder.decode(image.as_py())
                ends = np.cumsum(sizes.values.to_numpy())
                begins = ends - sizes.values.to_numpy()
                n = len(ends)
                values = [summary(flat[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, file.as_py(), np.int32)), ids.values, pa.array(begins), pa.array(ends - begins), pa.array(values, arrow)], names=out.names
                )

    docs = files.select("part", "file", "ids", "sizes", "image").mapInArrow(read, out)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition of the writing job
    parts = parts.select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("part_start"))
    before_file = W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(before_file), F.lit(0)).alias("file_start")).join(parts, "part")
    return docs.join(starts, ["part", "file"]).select("id", (F.col("part_start") + F.col("file_start") + F.col("before")).alias("start"), "n_tokens", field.name)
