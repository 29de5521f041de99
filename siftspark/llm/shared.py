"""What the operators of this subpackage share: table reading, scratch folders, word rules, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.session import spread, swept  # noqa: F401

#: Words are runs of anything but the ASCII white space characters (a Java pattern).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch. A batch is held whole by a Python worker, so rows with texts come in few.
BATCH_ROWS = 256

_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_KEY, BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once: few rows a batch, and few bytes where Spark can count them.

    Settings are only ever lowered, and stay so: plans that Spark runs later need them, and no plan needs larger batches.
    """
    for key, most in ((ROWS_KEY, BATCH_ROWS), (BYTES_KEY, 16 << 20)):
        with suppress(ValueError):
            if 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
                continue
        spark.conf.set(key, str(most))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another number of rows a batch, for what runs (not only is planned) inside; the setting before comes back."""
    before = spark.conf.get(ROWS_KEY, None)
    spark.conf.set(ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(ROWS_KEY) if before is None else spark.conf.set(ROWS_KEY, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith(("local[", "local ")) and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftspark-"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/siftspark-{uuid.uuid4().hex}-{name}"
    if not any(_made.values()):
        atexit.register(_at_exit, spark)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Deletes the scratch paths made so far; call it once results that read them are written elsewhere."""
    _delete(spark, _made.pop(spark.sparkContext.applicationId, []))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go at its end, and shuffle files of plans that are done with; what is read later must be cut() there."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        _delete(spark, made[before:])
        del made[before:]
        released(spark)


def released(spark: SparkSession) -> None:
    """Shuffle files of plans that are done with go. Listeners hold the last plan until there is a newer one, so a small one runs first."""
    spark.range(0, 1, 1, 1).count()
    swept(spark)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


def _at_exit(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may have ended before
        release_scratch(spark)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and later plans know its size."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), component the least node reachable.

    Large-star and small-star rounds by joins and map-side minima, so no neighbour list is ever gathered and a
    hub's edges are dealt over many tasks. Nodes without edges are not returned. Lineage is cut each round by
    checkpoint(). Edges with a null end and loops are left out; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = cut(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is tied to the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("m < u").select("u", F.col("m").alias("v"))
        ).distinct()
        # small star: u's smaller neighbours and u itself are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        ).distinct()
        after = cut(small)
        # stars only: no centre is itself tied to another node
        still = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = after.groupBy("u").count().where("count > 1").limit(1).count()
        e = after
        if not still and not many:
            break
    else:
        raise RuntimeError("components: no end after max_rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def all_of(conditions: list) -> object:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
