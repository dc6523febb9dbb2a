"""Session helpers: tables, checkpoints and partitioning."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; only where it is unset and all runs on this machine (tests), make one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palimpsest-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Spark reads it when a DataFrame is made.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """cut(), and the shuffle files that led there are removed."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(CLEANUP, before)


def release(*dfs: DataFrame) -> None:
    """Delete the checkpoint files that frames from cut() or settle(), or unions of such, consist of; nothing may read them later."""
    for df in dfs:
        sc, leaves = df.sparkSession.sparkContext, df._jdf.queryExecution().analyzed().collectLeaves()
        for i in range(leaves.size()):
            path = sc._jvm.org.apache.hadoop.fs.Path(leaves.apply(i).rdd().getCheckpointFile().get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input that has fewer partitions than the session has cores, before CPU-heavy work.

    For scans only: counting the partitions of a plan with a shuffle would run it.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
