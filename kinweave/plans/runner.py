"""Steps that write a table each: resumed where they stopped, tried again when they fail, stopped at a deadline."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.sources.records import exists

Step = Callable[[dict[str, DataFrame]], DataFrame]


def memory(spark: SparkSession) -> dict[str, int]:
    """MB in use by the driver's JVM, what it may use, and the driver program's peak."""
    run = spark._jvm.java.lang.Runtime.getRuntime()
    return {"jvm": (run.totalMemory() - run.freeMemory()) >> 20, "jvm_most": run.maxMemory() >> 20, "python_peak": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10}


def log(spark: SparkSession, message: str, began: float) -> None:
    print(f"[{time.time() - began:8.1f} s, {memory(spark)['jvm']} MB] {message}", flush=True)


def run(spark: SparkSession, steps: list[tuple[str, Step]], folder: str, resume: bool = True, retries: int = 1, deadline: float | None = None) -> dict[str, DataFrame]:
    """Tables of the steps by name; each step gets those before it.

    A step's table is a folder of Parquet files; with resume, one that is complete is not made again, and neither is what
    was complete before a later step failed.  A step that fails is tried `retries` times more, with twice the
    shuffle partitions each time, so that a task needs less memory.  No step begins after `deadline` seconds.
    """
    began, made, fresh = time.time(), {}, False
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, step in steps:
            path = f"{folder.rstrip('/')}/{name}"
            if resume and not fresh and exists(spark, f"{path}/_SUCCESS"):
                log(spark, f"{name}: there already", began)
            else:
                fresh = True  # what follows rests on a new table
                for attempt in range(retries + 1):
                    if deadline is not None and time.time() - began > deadline:
                        raise TimeoutError(f"{name} was not begun: {deadline} s are over")
                    try:
                        step(made).write.mode("overwrite").parquet(path)
                        break
                    except Exception as e:
                        log(spark, f"{name}: {type(e).__name__}, attempt {attempt + 1}", began)
                        if attempt == retries:
                            raise
                        spark.conf.set("spark.sql.shuffle.partitions", str(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2))
                log(spark, f"{name}: done", began)
            made[name] = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    return made
