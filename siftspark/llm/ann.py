"""Approximate nearest neighbours by multi-index hashing.

A rotation is learned (principal axes, then iterative quantisation) and the signs of rotated vectors are codes of 64
bits, cut into substrings. Each substring of an index block has its own table from values to rows. A query probes every
value within radius / substrings of its own in each table; by the pigeonhole principle that meets every code within the
Hamming radius. Codes within the radius are reranked by inner products of the original vectors in double precision.
Queries that met fewer than k rows, or whose k best are by their angles so far that as near ones may lie beyond the
radius, are asked again with a wider one, up to all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.shared import small_batches, stored

BITS, SUBSTRINGS = 64, 8
WIDTH = BITS // SUBSTRINGS
#: Vectors that the rotation and the radius are learned from (the least by a hash of their values), and queries among them.
SAMPLE, PROBES, ROUNDS = 8192, 512, 20
#: Share of the sample's true neighbours that the first radius must hold.
HOLD = 0.985
#: A query is settled if the distance to expect from the angle to its k-th best row is within the radius by so many
#: standard deviations.
MARGIN = 1.5
#: Queries of one pass (their vectors are broadcast: a bounded block), rows of an index block, queries searched at once.
PASS, BLOCK, CHUNK = 1 << 14, 1 << 13, 64


@dataclass
class Hasher:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings) of bytes."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1, bitorder="little")

    def directions(self, x: np.ndarray) -> np.ndarray:
        """What the codes are the signs of, at length 1 (0 at the mean)."""
        y = (x - self.mean) @ self.rotation
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), np.finfo(float).tiny)


def learn(x: np.ndarray, k: int, seed: int = 31) -> Hasher:
    """From a sample of vectors (rows). The radius is where HOLD of the sample's own k nearest neighbours lie, or as far
    beyond as the same probes reach."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(axis=0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1]
    if dim >= BITS:
        axes = axes[:, :BITS]
        turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(ROUNDS):
            v = c @ axes
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        rotation = axes @ turn
    else:
        # fewer dimensions than bits: random directions besides
        rotation = np.concatenate([axes, rng.normal(size=(dim, BITS - dim))], axis=1)
    made = Hasher(mean, rotation, BITS)
    if len(x) > 1:
        codes = made.codes(x).view(np.uint64)[:, 0]
        asked = rng.permutation(len(x))[:PROBES]
        far = []
        for q in asked:
            s = x @ x[q]
            s[q] = -np.inf
            near = np.argpartition(-s, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
            far.append(np.bitwise_count(codes[near] ^ codes[q]))
        made.radius = min(BITS, int(np.ceil(np.quantile(np.concatenate(far), HOLD))) | (SUBSTRINGS - 1))
    return made


def wider(radius: int) -> int:
    """The next radius; beyond 24 probing meets nearly every row, so all bits come next."""
    return BITS if radius >= 24 else max(16, 2 * radius) | (SUBSTRINGS - 1)


def probes(radius: int) -> np.ndarray:
    """All values that differ from 0 in up to radius / SUBSTRINGS bits."""
    flips = [sum(1 << i for i in c) for r in range(min(WIDTH, radius // SUBSTRINGS) + 1) for c in combinations(range(WIDTH), r)]
    return np.array(flips, dtype=np.int64)


class Block:
    """Tables of an index block: for each substring, rows by its value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hasher: Hasher, radius: int | None = None):
        self.ids, self.vectors, self.codes = ids, vectors, hasher.codes(vectors)
        self.whole = self.codes.view(np.uint64)[:, 0]
        self.radius = hasher.radius if radius is None else radius
        self.flips = probes(self.radius)
        self.order = np.argsort(self.codes, axis=0, kind="stable")
        self.starts = np.stack([np.searchsorted(self.codes[self.order[:, j], j], np.arange(257)) for j in range(SUBSTRINGS)])

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of all codes within the radius, each once."""
        if len(self.flips) * SUBSTRINGS > 256:
            # the probes would meet more rows than there are
            return np.nonzero(np.bitwise_count(codes.view(np.uint64)[:, :1] ^ self.whole[None, :]) <= self.radius)
        met = np.zeros((len(codes), len(self.ids)), dtype=bool)
        for j in range(SUBSTRINGS):
            values = codes[:, j].astype(np.int64)[:, None] ^ self.flips[None, :]
            first, many = self.starts[j][values].ravel(), (self.starts[j][values + 1] - self.starts[j][values]).ravel()
            at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            query = np.repeat(np.arange(len(codes)), many.reshape(len(codes), -1).sum(axis=1))
            met[query, self.order[at, j]] = True
        query, row = np.nonzero(met)
        near = np.bitwise_count(codes.view(np.uint64)[query, 0] ^ self.whole[row]) <= self.radius
        return query[near], row[near]


class Best:
    """The k best rows of each query so far, by score, then smaller id. bits: the code distance to expect of each."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id, self.bits = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k))

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray, bits: np.ndarray, low: int, high: int) -> None:
        old = np.isfinite(self.score[low:high])
        q = np.concatenate([np.nonzero(old)[0], query])
        s = np.concatenate([self.score[low:high][old], scores])
        i = np.concatenate([self.id[low:high][old], ids])
        b = np.concatenate([self.bits[low:high][old], bits])
        order = np.lexsort((i, -s, q))
        q, s, i, b = q[order], s[order], i[order], b[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        top = rank < self.k
        self.score[low:high], self.id[low:high] = -np.inf, np.iinfo(np.int64).max
        self.score[low + q[top], rank[top]], self.id[low + q[top], rank[top]], self.bits[low + q[top], rank[top]] = s[top], i[top], b[top]

    def rows(self, ids: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        q, r = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"at": at[q], "query_id": ids[q], "vec_id": self.id[q, r], "score": self.score[q, r], "bits": self.bits[q, r]})


def usable(vector: Column) -> Column:
    """Vectors that take part: neither null nor zero, and all components finite."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", per_pass: int = PASS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by inner product among the candidates met; all
    candidates where there are k or fewer.

    Candidates are all rows but those with the query's id. Ties go to the smaller id. Vectors that are not usable(), null
    ids and vectors whose length is not the sample's most frequent take no part; equal rows count once. Queries come in
    passes of per_pass (one bounded block is broadcast at a time); each pass reads the whole index, and so does each
    wider radius for the queries that need it.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    all_rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    # distinct vectors, so that copies do not fill the sample; only those with the least hashes are compared
    hashed = all_rows.select("v", F.xxhash64("v").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last).cast("long")).distinct().orderBy("h", "v").limit(SAMPLE).toPandas()["v"]
    schema = "at long, query_id long, vec_id long, score double, bits double"
    out_columns = ["query_id", "rank", "vec_id", "score"]
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample.map(len).mode()[0])
    hasher = learn(_matrix(sample[sample.map(len) == dim]), k)
    rows = stored(all_rows.where(F.size("v") == dim).groupBy("id", "v").agg(F.max("q").alias("q")), "vectors")
    queries = rows.where("q").select("id", "v")
    n_passes = max(1, -(-queries.count() // per_pass))

    def searching(places: object, ids: object, asked: object, radius: int) -> object:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, own_ids, q = places.value, ids.value, asked.value
            lengths = np.linalg.norm(q, axis=1)
            codes, toward, best = hasher.codes(q), hasher.directions(q), Best(len(q), k)

            def look(parts: list[pd.DataFrame]) -> None:
                frame = pd.concat(parts)
                block = Block(frame["id"].to_numpy(), _matrix(frame["v"]), hasher, radius)
                there = hasher.directions(block.vectors)
                for low in range(0, len(q), CHUNK):
                    high = min(len(q), low + CHUNK)
                    query, row = block.candidates(codes[low:high])
                    other = block.ids[row] != own_ids[low:high][query]
                    query, row = query[other], row[other]
                    if len(row) > (high - low) * 8 * k:
                        # rounded products first; those that may be among the best are told exactly below
                        rough = np.full((high - low, len(block.ids)), -np.inf)
                        rough[query, row] = (q[low:high] @ block.vectors.T)[query, row]
                        bar = best.score[low:high, -1]
                        if rough.shape[1] > k:
                            bar = np.maximum(bar, np.partition(rough, -k, axis=1)[:, -k])
                        slack = 1e-9 * lengths[low:high] * np.linalg.norm(block.vectors, axis=1).max()
                        may = rough[query, row] >= (bar - slack)[query]
                        query, row = query[may], row[may]
                    scores = np.concatenate([np.einsum("ij,ij->i", q[low + query[i : i + 65536]], block.vectors[row[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
                    # only what enters the best needs its angle
                    good = scores >= best.score[low + query, -1]
                    query, row, scores = query[good], row[good], scores[good]
                    bits = np.concatenate([np.einsum("ij,ij->i", toward[low + query[i : i + 65536]], there[row[i : i + 65536]]) for i in range(0, len(row), 65536)] or [np.zeros(0)])
                    bits = np.arccos(np.clip(bits, -1, 1)) * BITS / np.pi
                    best.add(query, block.ids[row], scores, bits, low, high)

            held, n = [], 0
            for frame in frames:
                held.append(frame)
                n += len(frame)
                if n >= BLOCK:
                    look(held)
                    held, n = [], 0
            if n:
                look(held)
            yield best.rows(own_ids, at)

        return run

    def settled(met: DataFrame, radius: int) -> np.ndarray:
        """Places of the queries with k rows, and rows as near as the k-th within the radius."""
        by_score = Window.partitionBy("at").orderBy(F.col("score").desc(), "vec_id")
        best = met.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k)
        seen = best.groupBy("at").agg(F.count("*").alias("n"), F.max("bits").alias("far"))
        seen = seen.withColumn("end", F.col("far") + MARGIN * F.sqrt(F.col("far") * (1 - F.col("far") / BITS)))
        return seen.where((F.col("n") >= k) & (F.col("end") <= radius)).select("at").toPandas()["at"].to_numpy(dtype=np.int64)

    found = []
    index = rows.select("id", "v")
    for i in range(n_passes):
        block = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(n_passes)) == i).toPandas()
        if not len(block):
            continue
        ids, asked = block["id"].to_numpy(), _matrix(block["v"])
        at, radius = np.arange(len(ids)), hasher.radius
        while len(at):
            held = [spark.sparkContext.broadcast(x) for x in (at, ids[at], asked[at])]
            met = stored(index.mapInPandas(searching(*held, radius), schema), "found")
            if radius < BITS:
                done = settled(met, radius)
                met = met.join(F.broadcast(spark.createDataFrame(pd.DataFrame({"at": done}), "at long")), "at", "left_semi")
                at = np.setdiff1d(at, done)
            else:
                at = at[:0]
            found.append(met.select("query_id", "vec_id", "score"))
            radius = wider(radius)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*out_columns)
