"""Tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names.

A job that loses an executor reads such a table again instead of recomputing what led to it.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What the operator that runs in this thread or context has kept so far.
_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only on one machine (tests), where none is set, a temporary one is made and set; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in parts by a column if one is named, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelake/{name}-{uuid.uuid4().hex}"
    if (made := _scope.get()) is not None:
        made.append((spark, path))
    df.write.parquet(path, partitionBy=by)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    return kept


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(kept: DataFrame) -> None:
    """Delete what ``keep`` wrote, once nothing reads it any more."""
    drop(kept.sparkSession, kept._kept_path)


def tidy(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The job's result is kept, and all that it kept on the way is deleted, whether it ends well or not."""

    @functools.wraps(job)
    def run(*args, **options) -> DataFrame:
        made: list[tuple[SparkSession, str]] = []
        outer = _scope.set(made)
        out = None
        try:
            out = job(*args, **options)
            if not hasattr(out, "_kept_path"):
                out = keep(out, job.__name__.strip("_"))
        finally:
            _scope.reset(outer)
            for spark, path in made:
                if out is None or path != out._kept_path:
                    drop(spark, path)
        if (around := _scope.get()) is not None:
            around.append((out.sparkSession, out._kept_path))
        return out

    return run
