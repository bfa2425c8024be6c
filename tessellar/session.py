"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tessellar")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a session without the setting (tests, a laptop) gets a folder of its own.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessellar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def _discard(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session has ended before; the folder's owner clears it
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends at files that outlive executors.

    The files go when the session's process ends, or with ``discard`` as soon as nothing reads them any more.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    atexit.register(_discard, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(back)] = (back, path)
    return back


_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def written_to(df: DataFrame) -> str:
    """The folder behind a materialised frame with its file system's name, for tasks that read it themselves."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN[id(df)][1])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised frame; only when every frame made from it has been written or collected."""
    found = _WRITTEN.pop(id(df), None)
    if found:
        _discard(df.sparkSession, found[1])
