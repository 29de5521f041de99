import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark import queries
from siftspark.functions import text
from siftspark.operators import dedup, fold, lookup, resolve, semdedup, similarity, stats


def greedy(n, pairs):
    """The keep set of a pass in order; who each duplicate belongs to."""
    near = {i: {} for i in range(n)}
    for a, b, s in pairs:
        near[a][b] = near[b][a] = s
    kept, owner = [], {}
    for i in range(n):
        before = [k for k in kept if k in near[i]]
        if before:
            owner[i] = before[0]
        else:
            kept.append(i)
    return kept, owner


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def kept_of(df, id_col):
    return sorted(r[0] for r in df.where("kept").select(id_col).collect())


def test_chain_keeps_both_ends(spark):
    rows = frame(spark, [(1,), (2,), (3,)], "id long")
    edges = frame(spark, [(1, 2, 0.9), (2, 3, 0.9)], "a long, b long, similarity double")
    out = resolve.resolve(rows, edges, "id")
    assert kept_of(out, "id") == [1, 3] and out.where("id = 2").first()["original"] == 1


def test_attribution_by_order_and_by_similarity(spark):
    rows = frame(spark, [(1,), (2,), (3,)], "id long")
    edges = frame(spark, [(1, 3, 0.80), (2, 3, 0.95)], "a long, b long, similarity double")
    assert resolve.resolve(rows, edges, "id").where("id = 3").first()["original"] == 1
    assert resolve.resolve(rows, edges, "id", by="most").where("id = 3").first()["original"] == 2


def test_independent_set_equals_a_greedy_pass(spark):
    random.seed(3)
    pairs = [(a, b, 1.0) for a in range(40) for b in range(a + 1, 40) if random.random() < 0.06]
    out = resolve.resolve(spark.range(40), frame(spark, pairs, "a long, b long, similarity double"), "id")
    kept, owner = greedy(40, pairs)
    assert kept_of(out, "id") == kept
    assert {r["id"]: r["original"] for r in out.where("not kept").collect()} == owner


def test_no_edges(spark):
    out = resolve.resolve(spark.range(3), frame(spark, [], "a long, b long, similarity double"), "id")
    assert kept_of(out, "id") == [0, 1, 2]


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
def test_jaccard_keepers_equal_brute_force(spark, threshold):
    random.seed(5)
    sets = [sorted(random.sample("abcdefghijkl", random.randint(0, 8))) for _ in range(60)]
    sets += sets[:6]
    for both_empty in (True, False):
        rows = frame(spark, [(i, s) for i, s in enumerate(sets)], "id long, grams array<string>")
        out = resolve.resolve(rows, similarity.jaccard_edges(rows, threshold, both_empty=both_empty), "id")

        def j(x, y):
            return (1.0 if both_empty else 0.0) if not x and not y else len(set(x) & set(y)) / len(set(x) | set(y))

        kept, owner = greedy(len(sets), [(a, b, 1.0) for a in range(len(sets)) for b in range(a + 1, len(sets)) if j(sets[a], sets[b]) >= threshold])
        assert kept_of(out, "id") == kept
        assert {r["id"]: r["original"] for r in out.where("not kept").collect()} == owner


def test_text_dedup_of_empty_and_equal_texts(spark):
    docs = frame(spark, [(1, "!!!"), (2, "???"), (3, "Same words here"), (4, "same  words, here"), (5, None)], "doc_id long, text string")
    assert kept_of(dedup.jaccard_text(docs, 0.8), "doc_id") == [1, 3]
    assert kept_of(dedup.quick_jaccard(docs, 0.8), "doc_id") == [1, 2, 3, 5]
    assert kept_of(dedup.md5_text(docs), "doc_id") == [1, 3, 5]
    for method in ("md5", "simhash", "minhash_lsh", "ours_lsh", "jaccard"):
        assert 3 in kept_of(dedup.text_pipeline(docs, method), "doc_id")
    with pytest.raises(ValueError):
        dedup.text_pipeline(docs, "other")


def test_ours_lsh_reads_whole_texts(spark, tmp_path):
    start, rest = ([" ".join(f"{c}{i * i % 9973}" for i in range(n)) for c in cs] for cs, n in (("a", 250), ("bcd", 900)))
    # one opening before different texts; one text after different openings
    texts = [f"{start[0]} {rest[0]}", f"{start[0]} {rest[1]}", " ".join(f"e{i}" for i in range(20)) + f" {rest[2] * 4}", " ".join(f"f{i}" for i in range(20)) + f" {rest[2] * 4}"]
    frame(spark, list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r["doc_id"], r["kept"], r["original"]) for r in queries.dedup_ours_lsh(spark, str(tmp_path)).collect()) == [(0, True, None), (1, True, None), (2, True, None), (3, False, 2)]


def test_window_forgets(spark):
    docs = frame(spark, [(1, "alpha beta gamma delta"), (2, "one two three four"), (3, "alpha beta gamma delta")], "doc_id long, text string")
    assert kept_of(dedup.windowed_jaccard(docs, 0.8, window=1), "doc_id") == [1, 2, 3]
    assert kept_of(dedup.windowed_jaccard(docs, 0.8, window=2), "doc_id") == [1, 2]


def test_cross_split_puts_train_first(spark):
    rows = frame(spark, [(1, "the same text in both"), (2, "")], "doc_id long, text string")
    out = dedup.cross_split({"test": rows, "train": rows})
    assert sorted((r["split"], r["doc_id"]) for r in out.where("kept").collect()) == [("test", 2), ("train", 1), ("train", 2)]


def test_chunked_second_pass(spark):
    docs = frame(spark, [(i, "the very same text") for i in range(30)], "doc_id long, text string")
    assert kept_of(dedup.chunked_jaccard(docs), "doc_id") == [0]
    assert dedup.chunk_size(500, 4) == 125 and dedup.chunk_size(5000, 4) == 1250 and dedup.chunk_size(50_000, 4) == 2000


def test_simhash_join_finds_all_pairs(spark):
    random.seed(7)
    bits = [random.getrandbits(64) for _ in range(20)]
    bits += [b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in bits]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    rows = frame(spark, list(enumerate(signed)), "id long, bits long")
    got = {(r["a"], r["b"]) for r in similarity.hamming_edges(rows, 3).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if (bits[a] ^ bits[b]).bit_count() <= 3 and bits[a] != bits[b]} | {(a, b) for a, b in got if bits[a] == bits[b]}


def vectors_of(spark, n=80, dim=6, groups=3, seed=11):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, frame(spark, [(i, x.tolist(), i % groups, int(rng.integers(1, 9))) for i, x in enumerate(v)], "vec_id long, embedding array<double>, cluster int, size int")


def test_cosine_blocks_equal_brute_force(spark, monkeypatch):
    v, rows = vectors_of(spark)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    got = {(r["a"], r["b"]) for r in similarity.cosine_edges(rows, 0.6, "vec_id").collect()}
    assert got == {(a, b) for a in range(80) for b in range(a + 1, 80) if v[a] @ v[b] >= 0.6}
    within = {(r["a"], r["b"]) for r in similarity.cosine_edges(rows, 0.6, "vec_id", group_col="cluster").collect()}
    assert within == {(a, b) for a, b in got if a % 3 == b % 3}


def test_matrix_rule_counts_removed_rows(spark, monkeypatch):
    v, rows = vectors_of(spark)
    monkeypatch.setattr(semdedup, "ROWS", 8)
    ranked = semdedup.rank_in_cluster(semdedup.centroid_similarity(rows), 1 - F.col("similarity_to_centroid"))
    order = {r["vec_id"]: (r["cluster"], r["rank"]) for r in ranked.collect()}
    for which, sign in (("hard", 1), ("easy", -1)):
        got = {r["vec_id"]: r["m"] for r in semdedup.max_to_earlier(ranked, which=which).collect()}
        for i in range(80):
            before = [v[i] @ v[j] for j in range(80) if order[j][0] == order[i][0] and sign * order[j][1] < sign * order[i][1]]
            assert got[i] == pytest.approx(max([0.0, *before]))
    swept = semdedup.matrix_rule(semdedup.max_to_earlier(ranked), [0.3, 0.5])
    told = {r["eps"]: r["kept_samples"] + r["removed_samples"] for r in semdedup.eps_summary(swept).collect()}
    assert told == {0.3: 80, 0.5: 80}


def test_grouped_takes_the_most_similar_keeper(spark):
    v, rows = vectors_of(spark)
    out = semdedup.grouped(rows, 0.5, size_col="size").collect()
    kept = {r["vec_id"] for r in out if r["kept"]}
    for r in out:
        near = [(v[r["vec_id"]] @ v[k], -k) for k in kept if k % 3 == r["vec_id"] % 3 and k != r["vec_id"] and v[r["vec_id"]] @ v[k] >= 0.5]
        if not r["kept"]:
            assert near and r["original"] in kept and r["similarity"] <= max(near)[0] + 1e-9
    assert all(v[a] @ v[b] < 0.5 for a in kept for b in kept if a < b and a % 3 == b % 3)


def test_keep_list(spark):
    v, rows = vectors_of(spark, 12)
    out = {r["vec_id"]: r for r in semdedup.apply_keep_list(rows, frame(spark, [(3,), (6,)], "id long")).collect()}
    assert sorted(i for i, r in out.items() if r["kept"]) == [1, 2, 3, 6]
    assert out[9]["original"] == max((3, 6), key=lambda k: v[9] @ v[k])


def test_bits(spark):
    _, rows = vectors_of(spark, 40, 16)
    sets = {r["vec_id"]: {i for i, x in enumerate(r["embedding"]) if x > 0} for r in rows.collect()}
    out = dedup.bits_jaccard(rows, 0.6)
    kept, _ = greedy(40, [(a, b, 1) for a in range(40) for b in range(a + 1, 40) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])])
    assert kept_of(out, "vec_id") == kept
    for r in dedup.bits_lsh_pairs(rows, 0.6, 20, 2).collect():
        assert len(sets[r["a"]] & sets[r["b"]]) / len(sets[r["a"]] | sets[r["b"]]) >= 0.6 and r["collisions"] >= 2


def test_by_key_keeps_nulls(spark):
    rows = frame(spark, [("a", b"1"), ("b", b"1"), ("c", None), ("d", None)], "path string, content binary")
    assert kept_of(dedup.file_hash(rows), "path") == ["a", "c", "d"]
    with pytest.raises(ValueError):
        dedup.file_hash(rows, algorithm="crc")
    assert kept_of(dedup.audio_pipeline(frame(spark, [("a", "x"), ("b", "x"), ("c", "")], "path string, fingerprint string"), "phash"), "path") == ["a", "c"]


def test_lookups(spark):
    paths = frame(spark, [("A\\b.png",), ("none",)], "path string")
    store = frame(spark, [("a/b.png", 7), ("a/B.png", 3)], "path string, idx long")
    found = {r["path"]: r["idx"] for r in lookup.by_variants(paths, store).collect()}
    assert found == {"A\\b.png": 3, "none": None}
    assert [r["path"] for r in lookup.missing(lookup.by_variants(paths, store)).collect()] == ["none"]
    asked = frame(spark, [("x/audio_012.wav",), ("x/k.wav",), ("zz",)], "path string")
    keys = frame(spark, [("y/k.wav",), ("12",), ("x/other",)], "key string")
    assert {r["path"]: r["match"] for r in lookup.fuzzy(asked, keys).collect()} == {"x/audio_012.wav": "12", "x/k.wav": "y/k.wav", "zz": None}
    told = lookup.accessible(frame(spark, [("a",), ("b",)], "path string"), frame(spark, [("a",)], "path string")).first()
    assert (told["total"], told["missing"], told["ok"]) == (2, 1, False)


def test_statistics(spark):
    rows = frame(spark, [("image", True, 10), ("image", False, 5), ("text", True, 1)], "modality string, kept boolean, size_bytes long")
    told = {r["modality"]: (r["candidates"], r["duplicates"], r["kept_bytes"], r["dedup_rate"]) for r in stats.modality_summary(rows).collect()}
    assert told == {"image": (2, 1, 10, 0.5), "text": (1, 0, 1, 0.0), None: (3, 1, 11, pytest.approx(1 / 3))}
    votes = frame(spark, [(1, "b", 0), (1, "a", 1), (2, "x", 0), (2, "y", 1), (2, "y", 2)], "k int, v string, at int")
    assert {r["k"]: r["winner"] for r in stats.majority(votes, "k", "v", "at").collect()} == {1: "b", 2: "y"}
    per = stats.class_metrics(frame(spark, [(0, 0), (0, 1), (1, 1)], "y int, p int"), "y", "p")
    assert stats.overall_metrics(per).first()["accuracy"] == pytest.approx(2 / 3)
    assert stats.best(frame(spark, [(0.1, 5.0), (0.2, 7.0), (0.3, 7.0)], "t double, f double"), "f", "t").first()[0] == 0.2


def test_fold_is_per_chunk(spark):
    rows = fold.chunk_of(spark.range(10), "id", 4)
    assert [r["chunk"] for r in rows.orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2] * 2


def test_quick_test(spark):
    rows = frame(spark, [(10, 10, 10, 10, 5), (10, 30, 10, 10, 5), (10, 10, 10, 20, 5), (10, 10, 10, 10, 2), (0, 10, 0, 10, 0)], "a int, b int, x int, y int, o int")
    got = [bool(r[0]) for r in rows.select(F.coalesce(text.may_be_similar(*[F.col(c) for c in "abxyo"]), F.lit(False))).collect()]
    assert got == [True, False, False, False, False]


def test_cleaning_modes(spark):
    words = [f"text number {i % 40} with some words that are its own {i % 40} {i % 40}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string")
    kept = lambda df: sorted(r["doc_id"] for r in df.where("kept").collect())
    assert kept(dedup.clean_split(docs, threshold=0.99)) == kept(dedup.clean_split(docs, "parallel", threshold=0.99)) == list(range(40))
    assert kept(dedup.clean_split(docs, "fast", threshold=0.99)) == list(range(60))  # a window of six kept rows sees no copy
    assert kept(dedup.chunked_quick(docs, 0.99, 25, 5)) == list(range(60)) and kept(dedup.chunked_quick(docs, 0.99, 60, 50)) == list(range(40))
    with pytest.raises(ValueError):
        dedup.clean_split(docs, "other")


def test_places_in_order(spark):
    rows = spark.range(0, 997).selectExpr("(id * 7919) % 10007 AS k")
    want = {k: i for i, k in enumerate(sorted(r["k"] for r in rows.collect()))}
    assert {r["k"]: r["place"] for r in fold.numbered(rows, "k").collect()} == want
    assert fold.numbered(rows.limit(0), "k").count() == 0


def test_hamming_pairs_at_any_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    values = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, int(rng.integers(0, 9)), replace=False)) for b in base for _ in range(4)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, bits long")
    distance = lambda a, b: ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count()
    for radius in (0, 2, 7, 10):
        got = {(r["a"], r["b"]) for r in similarity.hamming_edges(rows, radius).collect()}
        assert got == {(a, b) for a in range(160) for b in range(a + 1, 160) if distance(a, b) <= radius}
