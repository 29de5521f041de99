"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a seeded hash. A source's target gives whole passes over its blocks and a
rest; the rest is drawn from its blocks in a permuted order, and the block where the target falls is cut between
documents. The numbers of blocks drawn are exact quotas. A tree halves the output shards again and again and splits the
quotas by multivariate-hypergeometric draws until each shard has its own; a shard then takes the next disjoint run of a
source's permuted blocks, and its rows are shuffled locally. A document is taken as often as shards draw it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.shared import fresh, small_batches, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
#: Words of a block, and what a document counts besides its words, so that no block gathers many empty ones.
BLOCK_WORDS, DOC_WORDS = 1 << 16, 16
#: Blocks of a source at most; a larger source has larger blocks. A source's blocks are put in order by one task.
BLOCKS = 1 << 16
#: Sources that one splitting tree handles.
STRATUM = 10_000
SEED = 29


def n_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(t.encode().split()) if t else 0)


def measured(docs: DataFrame, text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs with size (words of the text, null: 0) and mix_key (a seeded hash of id-like columns and text)."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "mix_key")])
    ids = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() in ("long", "integer", "string")]
    return docs.withColumn("size", F.pandas_udf(n_words, "long")(text_col)).withColumn("mix_key", F.xxhash64(F.lit(seed), *ids))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """sources (source, source_size) with sid, weight and target: weights repeat over the sources by code point, null last.

    A target stops at most * source_size; what it leaves over is shared by weight among the others. Sorted by
    cap / weight, the sources before some place stop and the rest share what is left, so one pass finds that place.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "sid")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        sources.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.least(F.lit(float(share)), F.lit(float(most))) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(whole)["level"])
        .withColumn("target", F.when(F.col("level") <= F.col("ratio"), F.coalesce("common", "level") * F.col("weight")).otherwise(F.col("cap")))
        .drop("cap", "ratio", "budget", "level", "common")
    )


def split_quotas(quotas: np.ndarray, n_shards: int, seed: list[int]) -> np.ndarray:
    """(sources, shards + 1): where each shard's run of each source's draws begins, by halving the shards."""
    out = np.zeros((len(quotas), n_shards), dtype=np.int64)

    def halve(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[:, low] = left
            return
        mid = (low + high) // 2
        total = int(left.sum())
        first = np.random.default_rng([*seed, low, high]).multivariate_hypergeometric(left, total * (mid - low) // (high - low), method="marginals")
        halve(low, mid, first)
        halve(mid, high, left - first)

    halve(0, n_shards, np.asarray(quotas, dtype=np.int64))
    return np.concatenate([np.zeros((len(quotas), 1), dtype=np.int64), out.cumsum(axis=1)], axis=1)


def plan(rows: DataFrame, n_shards: int = 16, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES, seed: int = SEED, block_words: int = BLOCK_WORDS, blocks_each: int = BLOCKS) -> DataFrame:
    """rows (from measured()) with source_size, target, taken and shards: array<int>, a shard for each time it is drawn.

    Rows with a null source are a source. Sizes of 0 are never taken. A source's taken words miss its target by half a
    document at most where the cut falls. Equal rows are told apart by nothing; as many of them are taken as must be.
    Columns of rows may have any names; those called as the outputs give way.
    """
    names = [c for c in rows.columns if c.lower() not in ("source_size", "target", "taken", "shards")]
    # the caller's columns travel in one struct, so that no name of theirs can clash
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select("row", F.col(f"row.`{source_col}`").alias("of"), "row.size", "row.mix_key")
    per_source = packed.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    src = (
        targets(per_source, weights, share, most)
        .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("n_blocks", F.least(F.lit(blocks_each), F.greatest(F.lit(1), F.ceil((F.col("source_size") + DOC_WORDS * F.col("n_docs")) / block_words))))
    )
    src = stored(src.select("source", "sid", "source_size", "target", "full", "rest", "n_blocks"), "sources")
    known = packed.join(src, packed["of"].eqNullSafe(src["source"])).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "mix_key"), F.col("n_blocks")))

    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 2), "sid", "block"), "block")
    blocks = (
        known.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("full").alias("full"))
        .withColumn("no", F.row_number().over(order) - 1)
        .withColumn("left", F.col("rest") - (F.sum("words").over(order) - F.col("words")))
    )
    blocks = stored(blocks.select("sid", "block", "full", "no", "left"), "blocks")
    # draws of a source: all its blocks in order once for each full pass, then those up to the cut
    quotas = blocks.groupBy("sid").agg(F.count("*").alias("nb"), F.first("full").alias("full"), F.count_if(F.col("left") > 0).alias("cut"))

    def bounds(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid")
        found = split_quotas((frame["nb"] * frame["full"] + frame["cut"]).to_numpy(), n_shards, [seed, int(frame["stratum"].iloc[0])])
        return pd.DataFrame({"sid": frame["sid"], "nb": frame["nb"], "bounds": list(found)})

    dealt = quotas.withColumn("stratum", F.floor(F.col("sid") / STRATUM)).groupBy("stratum").applyInPandas(bounds, "sid int, nb long, bounds array<long>")
    # a draw belongs to the shard whose run holds it, and is made by that shard only
    owner = lambda d: F.get(F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: (F.element_at("bounds", s + 1) <= d) & (d < F.element_at("bounds", s + 2))), F.lit(0))
    drawn = blocks.join(dealt, "sid").select(
        F.col("sid").alias("s"), F.col("block").alias("b"), "left",
        F.transform(F.sequence(F.lit(0), F.col("full").cast("int")), lambda k: F.struct((k < F.col("full")).alias("whole"), owner(k * F.col("nb") + F.col("no")).alias("shard"))).alias("draws"),
    )
    within = Window.partitionBy("sid", "block").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, 0)
    before_cut = F.col("before") + F.col("size") / 2 <= F.col("left")
    return (
        known.join(drawn, (known["sid"] == drawn["s"]) & (known["block"] == drawn["b"]))
        .withColumn("before", F.sum("size").over(within) - F.col("size"))
        .withColumn("shards", F.transform(F.filter("draws", lambda d: (F.col("size") > 0) & d["shard"].isNotNull() & (d["whole"] | before_cut)), lambda d: d["shard"]))
        .select(*[F.col(f"row.`{c}`").alias(c) for c in names], "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
    )


def draw(planned: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture of what plan() gives: a row for each time a shard draws it, with shard (a column so called gives way);
    each shard's rows in a random order of their own."""
    kept = [F.col(f"`{c}`") for c in planned.columns if c.lower() not in ("shards", "shard", "mix_key")]
    at, key = fresh(planned, "pass_no", "mix_order")
    return (
        planned.select(*kept, F.col("mix_key").alias(key), F.posexplode("shards").alias(at, "shard"))
        .repartition("shard", F.pmod(key, F.lit(16)))
        .sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 3), "shard", at, key))
        .drop(at, key)
    )


def mix(rows: DataFrame, n_shards: int = 16, seed: int = SEED, **how: object) -> DataFrame:
    """plan() and draw(): the columns of rows but size, mix_key and those called as an output of plan(), and shard."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("size", "mix_key", "shard", "source_size", "target", "taken", "shards")]
    return draw(plan(rows, n_shards, seed=seed, **how), seed).select(*kept, "shard")
