"""Writing intermediate tables where all executors can read them."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Paths handed out, by application; :func:`cleanup` removes them.
_made: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Let local Python workers import this package; on a cluster ship it with ``--py-files``."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO not in known:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *known])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only in local mode, and only where it is unset."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="starling-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and a lost executor costs one step.

    ``small`` says that rows are few for the work that makes them: they cross a
    shuffle whose partitions the engine sizes, so the work keeps all its tasks and the
    table doesn't become thousands of tiny files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df.hint("rebalance") if small else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Remove what this application wrote to the shared folder; results that read it are void, but for ``keep``'s files."""
    held = [f.rsplit(":", 1)[-1] for f in keep.inputFiles()] if keep is not None else []
    jvm, conf, left = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in _made.pop(spark.sparkContext.applicationId, []):
        name = p.rsplit("/", 1)[-1]
        if any(f"/{name}/" in f for f in held):
            left.append(p)
        else:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    if left:
        _made[spark.sparkContext.applicationId] = left
