"""Sessions and the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "siftspark", **conf: str) -> SparkSession:
    """A session with the settings that the operators are tuned for; a running one is reused."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset, on local masters."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siftspark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As checkpointed(), by columns and compressed, for what holds texts. It goes when the process ends."""
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/siftspark-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Shuffle files of plans that are done with stay until the driver collects its garbage: it does so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df dealt over as many tasks as run at once, if it has fewer: a small file with one row group would keep what is
    costly for each row (Python, regular expressions) in one task. Tables of many files stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
