"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[DataFrame] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder, return a scan of what was written.

    More frames of the same columns are written after it, one by one.  A write's own shuffle files go as soon as it ends;
    Spark would keep them until the driver's garbage is collected.
    """
    return materialise_each((df, *more))


def materialise_each(parts: Iterable[DataFrame]) -> DataFrame:
    """The same for one frame at least; each is asked for when those before it have been written."""
    path, schema = None, None
    for part in parts:
        spark = part.sparkSession
        path = path or f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
        schema = schema or part.schema
        with _shuffles_dropped(spark):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.kinweave_path = path
    _written.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "kinweave_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        df.kinweave_path = None


def written() -> int:
    """A mark for sweep(): how many intermediate tables have been written so far."""
    return len(_written)


def sweep(since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the intermediate tables written since a mark, but for `keep`.

    For long sessions: call it when the results that read them have been taken.
    """
    for df in _written[since:]:
        if df is not keep:
            discard(df)
    _written[since:] = [df for df in _written[since:] if df is keep]


@atexit.register
def _sweep_at_exit() -> None:
    """Tables still there when the driver's program ends go; results that read them have been taken by then."""
    try:
        sweep()
    except Exception:  # noqa: BLE001  the JVM may have gone first
        return
