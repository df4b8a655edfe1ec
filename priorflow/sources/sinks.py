"""Outputs: partitioned tables, reports, content-addressed copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path


def overwrite(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)


def report_csv(df: DataFrame, path: str, order: Sequence[str], last: int | None = None) -> None:
    """One CSV file of a report that people open: its rows meet in one task, so give ``last``
    (keeps the last rows by order) where a table has more than some 10**5 rows."""
    df = df.orderBy(*[F.desc(c) for c in order]).limit(last) if last else df.orderBy(*order)
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def summary_json(df: DataFrame, path: str) -> None:
    """A diagnostic table as JSON, an object for each row, NULLs written out; rows may be many."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def predictions_by_fold(df: DataFrame, keep: Sequence[str], path: str) -> None:
    """Context, target and prediction columns, partitioned by (tour, fold)."""
    df.select("tour", "fold", *keep).write.mode("overwrite").partitionBy("tour", "fold").parquet(path)


def content_addressed(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, sha256, action): skip equal content, store new paths, keep conflicts beside."""
    old = stored.select("path", F.col("sha256").alias("_old"))
    action = F.when(F.col("_old").isNull(), "store").when(F.col("_old") == F.col("sha256"), "skip").otherwise("conflict")
    return incoming.join(old, "path", "left").select("path", "sha256", action.alias("action"))


def save_beside(df: DataFrame, path: str, originals: Sequence[str]) -> None:
    """Write a combined table to a folder of its own; one that holds an original, or lies in one, is an error."""
    inside = lambda a, b: a.rstrip("/") == b.rstrip("/") or a.startswith(b.rstrip("/") + "/")
    if any(inside(path, o) or inside(o, path) for o in originals):
        raise ValueError(f"{path} would overwrite an original")
    df.write.mode("errorifexists").parquet(path)


def store_contents(spark: SparkSession, incoming: DataFrame, folder: str, stamp: str) -> DataFrame:
    """Append what is new of ``incoming`` (path, content) to a store that is never overwritten.

    Equal content is skipped; other content of a path that is there is kept beside it, as
    ``path.conflict-stamp``. Returns what was done: (path, sha256, action, stored_as).
    """
    from ..streaming.ledgers import read_or_empty

    hashed = incoming.select("path", "content", F.sha2("content", 256).alias("sha256"))
    stored = read_or_empty(spark, folder, hashed.withColumn("stored_as", F.col("path")).schema)
    plan = content_addressed(hashed, stored.filter("path = stored_as")).withColumn("stored_as", F.when(F.col("action") == "conflict", F.concat("path", F.lit(f".conflict-{stamp}"))).when(F.col("action") == "store", F.col("path")))
    done = work_path(spark, "store-plan")
    plan.write.parquet(done)
    plan = spark.read.schema(plan.schema).parquet(done)
    hashed.join(plan.filter("stored_as IS NOT NULL").select("path", "stored_as"), "path").write.mode("append").parquet(folder)
    return plan


def markdown_rows(df: DataFrame) -> Column:
    """A row as a line of a Markdown table; NULLs are empty, and what would end a cell is escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))


def markdown_table(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A Markdown table as text files in order: the head in a first file, then ranges of rows.

    Spark sorts and writes; nothing comes to the driver, so a table of any size can be told.
    """
    spark = df.sparkSession
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/part=0")
    df.orderBy(*order).select(markdown_rows(df).alias("value")).write.mode("errorifexists").text(f"{path}/part=1")


def store_record(records: DataFrame, path: str, ident: str) -> None:
    """Records as JSON, each in a folder of its own id; a store that is there already is an error."""
    records.write.mode("errorifexists").partitionBy(ident).json(path)
