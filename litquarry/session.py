"""Session construction and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "litquarry", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller's session is used as it is."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point reliable checkpoints at the shared folder of the cluster and return the folder.

    ``spark.checkpoint.dir`` names that folder. Only a local session may go without it and gets a temporary one; elsewhere a folder
    of one machine would lose the data with it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="litquarry-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, read back column by column. It is removed when the application ends."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = df.sparkSession.sparkContext
    kept = sc._jvm.org.apache.hadoop.fs.Path(path)
    kept.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(kept)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go with the plans that made them, but only when the driver's JVM collects its garbage, which a calm driver may not do for hours."""
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows spread over as many tasks as the session shuffles into, before work that is dear per row and small in bytes; with ``by``, equal values stay together.

    Adaptive execution sizes tasks by bytes; a few megabytes of rows for a slow Python function would end in one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)
