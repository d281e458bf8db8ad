"""Session factory and the durable cut of long lineages."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("granary")
    conf = CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    }
    spark = builder.config(map=conf | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where it is unset, on one machine (tests), a temporary one.

    On a cluster a machine's own folder would keep only a part of each table, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or os.path.join(tempfile.gettempdir(), "granary-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *cols: str, per_core: int = 3) -> DataFrame:
    """Rows over enough tasks for work that is heavy for each row, by the given columns or round robin.

    The number follows the session's shuffle partitions, and is never under a few tasks a core: small bytes that cost
    much CPU would otherwise be coalesced into a few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * per_core)
    return df.repartition(n, *cols)


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder, removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a parquet table in the shared checkpoint folder: a cut of the lineage that keeps columns apart.

    The table is compressed, can be read in part and outlives any executor; it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            return


def enough_tasks(df: DataFrame) -> DataFrame:
    """The rows as they are read where that gives every core a task; dealt out only where a few files would not.

    Splits of a file without a row group's start hold no rows, so few files count as few tasks, whatever the splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    few = parts < cores or parts <= 4 * cores and 0 < len(df.inputFiles()) < cores
    return spread(df, per_core=1) if few else df
