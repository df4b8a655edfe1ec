"""Session defaults: UTC, ANSI as Spark ships it, adaptive execution on."""

from __future__ import annotations

import atexit
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def get_session(app: str = "priorflow", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; in tests, without one, in a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="priorflow-work-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = "file://" + _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers, once for each session; they may run where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_priorflow_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = pathlib.Path(tempfile.mkdtemp(prefix="priorflow-zip-"))
    atexit.register(shutil.rmtree, str(folder), True)
    with zipfile.ZipFile(folder / "priorflow_package.zip", "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(folder / "priorflow_package.zip"))
    context._priorflow_shipped = True
