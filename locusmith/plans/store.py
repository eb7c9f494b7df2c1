"""Reading tables and cutting lineage in the folder all executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A test table; only the named columns, so that extra ones never reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="locusmith-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, safe against the loss of executors, free of lineage. It is gone when the application ends."""
    path = temporary(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temporary(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    folders = there.getFileSystem(spark._jsc.hadoopConfiguration())
    folders.mkdirs(there)
    folders.deleteOnExit(there)
    folders.delete(there, True)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work in Python that costs far more than a shuffle of its input.

    Only a table of fewer files than cores is dealt out anew; a large one already has more partitions than that and stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="locusmith-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    source = shutil.copytree(package, folder / "code" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", source.parent, package.name))
    _shipped.add(context.applicationId)


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query, with this package on the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
