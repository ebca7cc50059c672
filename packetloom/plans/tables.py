"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session in local mode, as in tests, gets one of our own where that is
    unset; on a cluster each executor would write such a folder to its own disk, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="packetloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run inside have their generated code split into methods that the JVM compiles: HotSpot leaves those
    beyond 8000 bytes to its interpreter, and long expressions in one stage make such. Rows are the same either way."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, label: str, keep: bool = False, split: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back, so that later steps never recompute it. The table stays
    until the scratch() around it ends or the folder's owner removes it; with keep it outlives scratch(). split: for long
    expressions, see small_methods."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packetloom-{label}-{uuid.uuid4().hex}"
    with small_methods(spark) if split else nullcontext():
        df.write.parquet(path)
    if not keep:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of ended jobs removed. Spark removes them once the driver's JVM has collected their
    handles, which without pressure on its memory happens every half an hour only: long after a step of many shuffles."""
    gc.collect()  # frames that Python still holds in cycles keep their handles alive
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was settled inside it without `keep`; results that read from there must be written by then."""
    before = len(_written)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _written[before:]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        del _written[before:]
