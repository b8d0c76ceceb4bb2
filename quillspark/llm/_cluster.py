"""Shared-folder staging and session set-up used by the operators here.

A staged table is written once with Spark's committed writer into the folder
that ``spark.checkpoint.dir`` names, and read again.  That cuts lineage: a lost
executor costs only the tasks it ran, and nothing is recomputed differently.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

import quillspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package; Arrow batches are bounded by the session (64 MB by default)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(quillspark.__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that ``spark.checkpoint.dir`` names.

    Where none is set, one machine may use a temporary folder of its own; a cluster may not.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        _folders[app] = f"{base.rstrip('/')}/quillspark-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


_folders: dict[str, str] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is already gone
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def stage_parts(df: DataFrame, name: str, part: str, values: tuple[str, ...]) -> dict[str, DataFrame]:
    """Write ``df`` once, apart by the values of a column, and return each part as read back; they can be freed apart."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(part).parquet(path)
    out = {}
    for v in values:
        out[v] = df.sparkSession.read.schema(df.schema).parquet(path).where(F.col(part) == v).drop(part)
        out[v].staged_path = f"{path}/{part}={v}"
    return out


def free(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        _remove(df.sparkSession, df.staged_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
