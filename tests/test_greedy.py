import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark import queries
from siftspark.functions import sketch, vectors
from siftspark.operators import dedup, greedy, semdedup


@pytest.fixture
def small(monkeypatch):
    """Rounds and tiles that small tables need many of."""
    for name, value in (("ROUND", 40), ("CHUNK", (8, 16)), ("TILE", 5)):
        monkeypatch.setattr(greedy, name, value)


def plain(items, similar, most=False):
    """(kept, owner) of a pass over (id, value) in order, row by row."""
    kept, owner = [], {}
    for i, v in items:
        near = [(k, s) for k, w in kept if (s := similar(w, v)) is not None]
        if near:
            owner[i] = max(near, key=lambda x: x[1])[0] if most else near[0][0]
        else:
            kept.append((i, v))
    return sorted(i for i, _ in kept), owner


def told(df):
    rows = df.select("vec_id", "kept", "original").collect()
    return sorted(r[0] for r in rows if r[1]), {r[0]: r[2] for r in rows if not r[1]}


def cosine(threshold):
    def similar(a, b):
        s = np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
        return s if s >= threshold else None

    return similar


def table(spark, n, width=6, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width)], int(rng.integers(3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


# F12
def test_an_order_that_wobbles_keeps_one_of_many_copies(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(40)], "vec_id long, embedding array<float>, cluster int").repartition(4)
    noise = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    monkeypatch.setattr(semdedup, "centroid_similarity", lambda rows, *_: rows.withColumn("similarity_to_centroid", noise()))
    assert semdedup.grouped(rows, 0.5).where("kept").count() == 1


# F12
def test_groups_in_rounds_equal_a_plain_pass(spark, small):
    rows, frame = table(spark, 150)
    near = {r[0]: r[1] for r in semdedup.centroid_similarity(frame, "label").select("vec_id", "similarity_to_centroid").collect()}
    kept, owner = [], {}
    for g in range(3):
        k, o = plain([(i, np.array(v)) for i, v, c in sorted(rows, key=lambda r: (-near[r[0]], r[0])) if c == g], cosine(0.7), most=True)
        kept, owner = kept + k, owner | o
    assert told(semdedup.grouped(frame, 1 - 0.7, "label")) == (sorted(kept), owner)


# F11
def test_folders_of_copies_with_shifted_keys(spark, tmp_path, small):
    rows, frame = table(spark, 60, width=8)
    frame.unionByName(frame.withColumn("vec_id", F.col("vec_id") + 70)).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.semdedup_folder(spark, str(tmp_path)).collect()
    assert len(got) == 120 and all(not r["kept"] and r["similarity"] == 1.0 for r in got if r["vec_id"] >= 70 and next(x["kept"] for x in got if x["vec_id"] == r["vec_id"] - 70))


# short vectors have the cosine of long ones, and the distance 1 - cosine ties what differs in last bits only
def test_groups_of_scaled_copies_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = [rng.normal(size=8) for _ in range(12)]
    rows = [(7 * (12 * k + i), [float(x) for x in v * scale], 0) for k, scale in enumerate((1.0, 3.0, 1e-7, 0.7, 1e-10)) for i, v in enumerate(base)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    sql = queries.oracle_sql()["semdedup_folder"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(duckdb.sql(sql).fetchall())
    assert sorted(map(tuple, queries.semdedup_folder(spark, str(tmp_path)).collect())) == want


# F10
def test_dynamic_query_is_one_cluster_at_any_size(spark, tmp_path):
    rows, frame = table(spark, 2100, width=12)
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert told(queries.semdedup_dynamic(spark, str(tmp_path))) == plain([(i, np.array(v)) for i, v, _ in rows], cosine(0.3))


def jaccard(threshold):
    def similar(a, b):
        s = len(a & b) / len(a | b) if a | b else 0.0
        return s if s >= threshold and s > 0 else None

    return similar


def places(vector):
    return frozenset(i for i, x in enumerate(vector) if x is not None and x > 0)


# F5
def test_bits_in_rounds_equal_a_plain_pass(spark, small):
    rows, frame = table(spark, 150, width=9)
    rows += [(150, [-1.0] * 9, 0), (151, [-1.0] * 9, 0), (152, [1.0, None, 1.0], 0), (153, [1.0, None, 1.0], 0)]
    frame = spark.createDataFrame(rows, frame.schema)
    assert told(dedup.bits_jaccard(frame, 0.5)) == plain([(i, places(v)) for i, v, _ in rows], jaccard(0.5))


# most pairs share a place, so no pairs may be made
def test_bits_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup.similarity, "jaccard_edges", lambda *_, **__: pytest.fail("pairs are made"))
    _, frame = table(spark, 50, width=9)
    assert dedup.bits_jaccard(frame, 0.5).count() == 50


# different sets with equal sketches are pairs too
def test_bits_lsh_in_rounds_equals_a_plain_pass(spark, small, monkeypatch):
    rows, frame = table(spark, 150, width=9)
    monkeypatch.setattr(dedup, "bits_lsh_pairs", lambda *_, **__: pytest.fail("pairs are made"))
    minima = {r[0]: r[1] for r in frame.select("vec_id", sketch.minhash_of_places(vectors.set_bits(F.col("embedding")), 60)).collect()}

    def similar(a, b):
        shared = sum(minima[a][i : i + 3] == minima[b][i : i + 3] for i in range(0, 60, 3))
        return jaccard(0.5)(places(rows[a][1]), places(rows[b][1])) if shared >= 2 else None

    assert told(dedup.bits_lsh(frame, 0.5, 20, 3)) == plain([(i, i) for i, _, _ in rows], similar)
