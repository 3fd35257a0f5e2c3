"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_OWN_DIR: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset (tests, local mode) is a folder of our own made and
    set, so that ``checkpoint()`` and written tables go to one place."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="turnweave-")
        spark.sparkContext.setCheckpointDir(f"file://{_OWN_DIR[app]}")
    return f"file://{_OWN_DIR[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/turnweave/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back. Survives
    lost executors, unlike a local checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._turnweave_path = path
    return out


def drop_materialised(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_turnweave_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes a shuffle's files only once nothing on the
    driver refers to it, and a driver with free memory may not find that out for a whole query."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within this block a shuffle's files go as soon as the query that wrote them has ended, whatever
    still refers to it: for operators whose every query ends in a table or a figure. Should a plan run
    again, Spark makes them anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@lru_cache(maxsize=8)
def _ship(app: str) -> None:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    out = os.path.join(tempfile.mkdtemp(), "turnweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f"{_ROOT.name}/{f.relative_to(_ROOT)}")
    spark.sparkContext.addPyFile(out)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, unless PYTHONPATH already has it there."""
    if str(_ROOT.parent) not in os.environ.get("PYTHONPATH", "").split(":"):
        _ship(spark.sparkContext.applicationId)
