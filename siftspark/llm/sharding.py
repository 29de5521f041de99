"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows uniformly by a seeded hash of all their columns into buckets that fit in memory. Pass two
gathers each bucket, brings its rows into a fixed order, and shuffles them by Spark's own Fisher-Yates `shuffle`.
Bucket after bucket that is one permutation of all rows; position p of n goes to shard p * shards / n, so the shards'
counts differ by one at most and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.shared import fresh, scratch

#: Bytes that a bucket holds on average. A bucket is gathered by one task, so this bounds a task's memory.
BUCKET_BYTES = 8 << 20
#: Most buckets whose starts (16 bytes each) are broadcast; beyond it they are joined as Spark sees fit.
STARTS = 1 << 20
#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def spread(docs: DataFrame, n_shards: int, text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with columns shard (int) and slot (long from 0 in each shard); docs' own columns of these names give way.

    Law `rows`: shard sizes in rows are at most one apart. Any column may be null; equal rows fall in one bucket and
    are told apart by nothing but their slots. An empty table gives an empty result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    b, h, rows = fresh(docs, "bucket", "scatter", "rows")
    total = docs.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).alias("bytes")).first()
    n, n_buckets = total["n"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    hashable = [c if t.dataType.typeName() not in ("map", "variant") else F.to_json(c) for c, t in zip(kept, docs.schema, strict=True)]

    scattered = docs.withColumn(h, F.xxhash64(F.lit(seed), *hashable)).withColumn(b, F.pmod(F.col(h), F.lit(n_buckets)))
    # where each bucket starts: as many rows as there are buckets
    starts = scattered.groupBy(b).agg(F.count("*").alias("_n")).withColumn("_from", F.sum("_n").over(Window.orderBy(b)) - F.col("_n"))
    tasks = max(1, min(n_buckets, 100_000))
    gathered = (
        scattered.repartition(tasks, b)
        .groupBy(b)
        .agg(F.collect_list(F.struct(F.col(h).alias("h"), F.struct(*kept).alias("row"))).alias(rows))
        .sortWithinPartitions(b)
        .select(b, F.shuffle(F.array_sort(rows, lambda x, y: F.when(x["h"] < y["h"], -1).when(x["h"] > y["h"], 1).otherwise(0)), seed).alias(rows))
    )
    placed = gathered.join(F.broadcast(starts) if n_buckets <= STARTS else starts, b).select(F.posexplode(rows).alias("_at", "_row"), "_from").withColumn("_p", F.col("_from") + F.col("_at"))
    # shard s begins at position ceil(s * n / shards)
    shard = F.expr(f"(_p * {n_shards}) div {max(n, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        *[F.col(f"_row.row.`{c}`").alias(c) for c in docs.columns],
        "shard",
        (F.col("_p") - F.expr(f"(cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, n_shards: int, path: str | None = None, **how: object) -> str:
    """Writes the shards as Parquet, one folder each, and returns the path (by default a new one in the shared folder)."""
    path = path or scratch(docs.sparkSession, "shards")
    spread(docs, n_shards, **how).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path
