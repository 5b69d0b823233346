"""Cut lineage: intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[DataFrame] | None] = ContextVar("_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset, a local session gets a temporary folder (removed at exit) and any other
    session a folder in the warehouse, since both are visible to all of its tasks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, found, True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later failures replay from those files.

    Not ``checkpoint()``, which computes a plan twice (once to count, once to write) and writes rows, not columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, in whatever store its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind ``cut(df)``; only for tables that no later plan reads."""
    drop_path(df.sparkSession, df._cut_path)  # type: ignore[attr-defined]


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end every table that ``cut`` wrote inside it: write what the block computes before it ends."""
    token = _made.set(made := [])
    try:
        yield
    finally:
        _made.reset(token)
        for df in made:
            drop_cut(df)
