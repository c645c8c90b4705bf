"""Session helpers: table access, the shared folder, and written (lineage-cutting) tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with `conf`; NEWSLOOM_SHARED names the shared folder where the session has none."""
    b = SparkSession.builder.appName("newsloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    b = b.master(master) if master else b
    for k, v in (conf or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    shared = os.environ.get("NEWSLOOM_SHARED")
    if shared and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, else the context's checkpoint folder.

    Where neither is set, a session of one machine gets a temporary folder; on a cluster that is an error, as no executor could read another's files.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not one_machine(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="newsloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def one_machine(master: str) -> bool:
    """Whether driver and executors share one machine's disk (`local[...]`)."""
    return master.split("[")[0] == "local"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage is cut, it survives executor loss, and every later read sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes all written tables: to be called once the results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    try:
        release()
    except Exception:  # the session is gone; the cluster's own clean-up has the rest
        _written.clear()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


atexit.register(_remove_written)
