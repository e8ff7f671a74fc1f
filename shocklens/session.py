"""Session builder and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shocklens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Where that is unset a folder of this
    machine is taken in local mode, and a cluster is refused.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shocklens-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; its lineage ends there.

    Any executor can read it again after another one is lost. Spark removes it
    once nothing refers to it if the session has
    spark.cleaner.referenceTracking.cleanCheckpoints, as ``local_session``
    sets; without it the files stay until the folder's owner clears it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
