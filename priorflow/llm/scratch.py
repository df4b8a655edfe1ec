"""Intermediate tables in the folder that driver and executors share.

Tables are written once and read back, which cuts lineage and survives lost executors.
The base folder is ``spark.checkpoint.dir``; only where that is unset (tests) is a local
folder used.
"""

from __future__ import annotations

import atexit
import contextlib
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Tables written within :func:`passing`, innermost last.
_PASSING: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Base folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/priorflow"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="priorflow-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def new_path(spark: SparkSession, name: str, stays: bool = False) -> str:
    """A path of its own; unless it ``stays``, :func:`passing` removes it at its end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _PASSING and not stays:
        _PASSING[-1].append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Removes the intermediate tables made within it, once nothing reads them any more."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffle_partitions(spark: SparkSession, n: int):
    """Runs what is written within it with ``n`` shuffle partitions."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores added where ``df`` has such a column."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Ready a session for Arrow functions here: the package is there, and one Arrow batch
    has few enough rows that long texts fit a Python worker. The setting stays, as results
    are read later."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that can't import it from their own path."""
    context = spark.sparkContext
    if getattr(context, "_priorflow_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    folder = pathlib.Path(tempfile.mkdtemp(prefix="priorflow-zip-"))
    atexit.register(shutil.rmtree, str(folder), True)
    with zipfile.ZipFile(folder / "priorflow_package.zip", "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(folder / "priorflow_package.zip"))
    context._priorflow_shipped = True
