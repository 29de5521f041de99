"""Semantic deduplication within clusters of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions import vectors
from siftspark.operators import greedy

#: Rows of a cluster whose products with the rest are taken at once.
ROWS = 2048


def cluster_sizes(n: int) -> int:
    """Clusters for n rows: one per thousand, 1 to 50 000."""
    return min(50_000, max(1, n // 1000))


def kmeans(rows: DataFrame, k: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42, max_iter: int = 20) -> DataFrame:
    """rows with cluster, by k-means on normalised vectors (cosine). k: by cluster_sizes() if not given; 1: cluster 0.

    Rows with null or zero vectors get no cluster (null).
    """
    ok = rows.where(F.col(vector_col).isNotNull() & (vectors.norm(F.col(vector_col)) > 0))
    n = ok.count()
    k = k or cluster_sizes(n)
    if k <= 1 or n <= k:
        return rows.withColumn("cluster", F.when(F.col(vector_col).isNotNull() & (vectors.norm(F.col(vector_col)) > 0), F.lit(0)))
    spread = ok.select(F.col(id_col).alias("_id"), array_to_vector(vectors.normalized(F.col(vector_col))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(spread)
    found = model.transform(spread).select("_id", F.col("prediction").alias("cluster"))
    return rows.join(found, rows[id_col] == found["_id"], "left").drop("_id")


def centroid_similarity(rows: DataFrame, cluster_col: str = "cluster", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """rows with similarity_to_centroid: cosine to the mean of the cluster's normalised vectors. Means are pre-aggregated."""
    parts = rows.where(F.col(vector_col).isNotNull()).select(F.col(cluster_col).alias("_c"), F.posexplode(vectors.normalized(F.col(vector_col))).alias("i", "x"))
    means = parts.groupBy("_c", "i").agg(F.avg("x").alias("m")).groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_mean"))
    return rows.join(means, rows[cluster_col].eqNullSafe(means["_c"]), "left").withColumn("similarity_to_centroid", vectors.cosine(F.col(vector_col), F.col("_mean"))).drop("_c", "_mean")


def rank_in_cluster(rows: DataFrame, distance: Column, cluster_col: str = "cluster", id_col: str = "vec_id", keep_hard: bool = True) -> DataFrame:
    """rows with dist and rank (from 0) in the cluster: farthest first if keep_hard. Ties by id."""
    rows = rows.withColumn("dist", distance)
    order = F.col("dist").desc() if keep_hard else F.col("dist").asc()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(cluster_col).orderBy(order, id_col)) - 1)


def max_to_earlier(rows: DataFrame, cluster_col: str = "cluster", rank_col: str = "rank", id_col: str = "vec_id", vector_col: str = "embedding", which: str = "hard") -> DataFrame:
    """id_col, cluster, m: the largest inner product with an earlier row of the cluster, removed rows too (0 for the first).

    which: `hard` by rank, `easy` by reversed rank, `random` by a hash. By blocks of a cluster's rows, so that a large
    cluster is spread over many tasks and memory stays bounded.
    """
    order = {"hard": F.col(rank_col).cast("double"), "easy": -F.col(rank_col).cast("double"), "random": F.xxhash64(F.col(id_col)).cast("double")}[which]
    base = rows.where(F.col(vector_col).isNotNull()).select(F.col(cluster_col).alias("c"), F.col(id_col).alias("id"), order.alias("o"), F.col(vector_col).cast("array<double>").alias("v"))
    sizes = base.groupBy(F.col("c").alias("of")).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("n"))
    dealt = base.join(sizes, F.col("c").eqNullSafe(F.col("of"))).select("c", "id", "o", "v", "n").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    as_later = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.col("k").alias("p"), j.alias("q"), F.lit(0).alias("side")))
    as_earlier = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(j.alias("p"), F.col("k").alias("q"), F.lit(1).alias("side")))
    both = dealt.select("c", "id", "o", "v", F.explode(F.concat(as_later, as_earlier)).alias("x")).select("c", "id", "o", "v", "x.p", "x.q", "x.side")
    kinds = dict(rows.dtypes)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        later, earlier = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if not len(later) or not len(earlier):
            return pd.DataFrame({"c": later["c"], "id": later["id"], "m": 0.0})
        s = np.stack(later["v"].to_list()) @ np.stack(earlier["v"].to_list()).T
        before = (earlier["o"].to_numpy()[None, :], earlier["id"].to_numpy()[None, :])
        own = (later["o"].to_numpy()[:, None], later["id"].to_numpy()[:, None])
        s[~((before[0] < own[0]) | ((before[0] == own[0]) & (before[1] < own[1])))] = 0.0
        return pd.DataFrame({"c": later["c"], "id": later["id"], "m": np.maximum(s.max(axis=1), 0.0)})

    found = both.groupBy("c", "p", "q").applyInPandas(block, f"c {kinds[cluster_col]}, id {kinds[id_col]}, m double")
    return found.groupBy("c", "id").agg(F.max("m").alias("m")).select(F.col("id").alias(id_col), F.col("c").alias(cluster_col), "m")


def matrix_rule(found: DataFrame, eps: list[float]) -> DataFrame:
    """found (from max_to_earlier) with eps and removed: a row for each eps; removed if m is above 1 - eps."""
    levels = F.explode(F.array(*[F.lit(float(e)) for e in eps])).alias("eps")
    return found.select("*", levels).withColumn("removed", F.col("m") > 1 - F.col("eps"))


def eps_summary(swept: DataFrame) -> DataFrame:
    return swept.groupBy("eps").agg(F.count("*").alias("total_samples"), F.count_if(~F.col("removed")).alias("kept_samples"), F.count_if("removed").alias("removed_samples")).withColumn(
        "kept_percentage", 100.0 * F.col("kept_samples") / F.col("total_samples")
    )


def grouped(rows: DataFrame, eps: float, cluster_col: str = "cluster", size_col: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Greedy within clusters in order of 0.7 * similarity to the centroid + 0.3 * scaled size (without sizes: the
    centroid's part alone), best first, ties by id. A duplicate belongs to the most similar kept row."""
    near = centroid_similarity(rows, cluster_col, id_col, vector_col)
    score = F.col("similarity_to_centroid") if size_col is None else 0.7 * F.col("similarity_to_centroid") + 0.3 * vectors.min_max(F.col(size_col), F.col(cluster_col))
    # a distance of 1 - score, as SQL ranks by: scores that differ in bits which that leaves out are ties
    placed = near.withColumn("_far", 1 - F.coalesce(score, F.lit(0.0)))
    return greedy.resolve(placed, greedy.cosine(1 - eps), id_col, vector_col, F.col("_far"), cluster_col, by="most", onto=rows)


def dynamic(rows: DataFrame, eps: float = 0.15, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42, k: int | None = None) -> DataFrame:
    """k clusters by k-means (about a thousand rows each if not given), then grouped(). A single cluster is all pairs by id order."""
    clustered = rows if k == 1 else kmeans(rows, k, id_col, vector_col, seed)
    if k == 1 or clustered.select("cluster").where("cluster > 0").isEmpty():
        return greedy.resolve(rows, greedy.cosine(1 - eps), id_col, vector_col)
    return grouped(clustered, eps, "cluster", None, id_col, vector_col)


def _nearest(rows: DataFrame, id_kind: str) -> DataFrame:
    """id, o, s: the most similar kept row o of each lost row's cluster c (ties: the smaller), by blocks of bounded size."""
    sizes = rows.groupBy(F.col("c").alias("of"), F.col("kept").alias("side_of")).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("n"))
    both = sizes.where("not side_of").select("of", F.col("n").alias("n_lost")).join(sizes.where("side_of").select(F.col("of").alias("o2"), F.col("n").alias("n_kept")), F.col("of").eqNullSafe(F.col("o2"))).drop("o2")
    dealt = rows.join(both, F.col("c").eqNullSafe(F.col("of"))).withColumn("k", F.pmod(F.xxhash64("id"), F.when(F.col("kept"), F.col("n_kept")).otherwise(F.col("n_lost"))).cast("int"))
    cells = F.when(F.col("kept"), F.transform(F.sequence(F.lit(0), F.col("n_lost") - 1), lambda p: F.struct(p.alias("p"), F.col("k").alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n_kept") - 1), lambda q: F.struct(F.col("k").alias("p"), q.alias("q")))
    )

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        lost, held = frame[~frame["kept"]], frame[frame["kept"]].sort_values("id")
        if not len(lost) or not len(held):
            return pd.DataFrame({"id": [], "o": [], "s": []})
        x, y = (np.stack(f["v"].to_list()) for f in (lost, held))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        s = x @ y.T
        best = s.argmax(axis=1)
        return pd.DataFrame({"id": lost["id"].to_numpy(), "o": held["id"].to_numpy()[best], "s": s[np.arange(len(best)), best]})

    found = dealt.select("c", "id", "kept", "v", F.explode(cells).alias("x")).select("c", "id", "kept", "v", "x.*").groupBy("c", "p", "q").applyInPandas(block, f"id {id_kind}, o {id_kind}, s double")
    return found.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("far"), "o")).alias("p")).select("id", F.col("p.o").alias("o"), (-F.col("p.far")).alias("s"))


def apply_keep_list(rows: DataFrame, keep: DataFrame, cluster_col: str = "cluster", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """rows with kept, original, similarity by a given list of ids (column id): a cluster without any keeps its first row.

    A removed row belongs to the most similar kept row of its cluster, ties to the smaller id. Rows without a vector have
    no original.
    """
    listed = rows.join(keep.select(F.col("id").alias(id_col)).distinct().withColumn("_in", F.lit(True)), id_col, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    any_in = listed.groupBy(F.col(cluster_col).alias("_c")).agg(F.max("_in").alias("_any"), F.min(id_col).alias("_first"))
    marked = listed.join(any_in, listed[cluster_col].eqNullSafe(any_in["_c"])).withColumn("kept", F.when(F.col("_any"), F.col("_in")).otherwise(F.col(id_col) == F.col("_first"))).drop("_c", "_any", "_first", "_in")
    flat = marked.where(F.col(vector_col).isNotNull()).select(F.col(cluster_col).alias("c"), F.col(id_col).alias("id"), "kept", F.col(vector_col).cast("array<double>").alias("v"))
    best = _nearest(flat, dict(rows.dtypes)[id_col])
    return marked.join(best.select(F.col("id").alias(id_col), F.col("o").alias("original"), F.col("s").alias("similarity")), id_col, "left")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/", 1)
