"""Session helpers: shared scratch space, lineage cuts and code shipping."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in ``spark.checkpoint.dir``;
    only where that is unset and the master is local (tests, a laptop) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_factloom_scratch", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext._factloom_scratch = made
        spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, before work on each row that costs far more than moving it: a
    small file is one task otherwise, however many rows it has."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def discard(df: DataFrame) -> None:
    """Delete the checkpoint that `cut` made of `df`: Spark itself keeps checkpoints for good.
    Only for what nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that functions run in
    Python workers can be imported there."""
    sc = spark.sparkContext
    if getattr(sc, "_factloom_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="factloom-code-"), "factloom_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for top, _, names in os.walk(_PACKAGE_DIR):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(top, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(_PACKAGE_DIR)))
    sc.addPyFile(out)
    sc._factloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
