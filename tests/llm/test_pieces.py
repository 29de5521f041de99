"""The operators' inner parts against brute force, without Spark."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.llm import ann, bpe, classifier, mixing, rules, shared, simhash, suffixes, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


ODD = [
    "", "  ", "Áè x y z", "<|endoftext|>a<|startoftext|>", "a<|endoftext|", "İstanbul ſ K ǅ", "\x1cab\x1d c\x85d", "日本語 テキスト 123²½", "'s't x's it'LL",
    "é́ ́a", "ß ẞ Σας ΑΣ", "\x00 a\x00b", "😀👍🏽 a😀", "ª º µ ¼", "a" * 5000, "!" * 3000 + "x" * 3000,
]


@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_the_library(own, text):
    want = own.library.encode(text, add_special_tokens=False)
    ids, decoded, n = own.text(text)
    assert (ids, n) == (" ".join(map(str, want.ids)), len(want.ids))
    assert decoded == own.library.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst THE'é\n.!1<|>endoftx́ "), max_size=60))
def test_bpe_equals_the_library_on_random_texts(text):
    c = bpe.codec(PATH)
    assert c.text(text)[0] == " ".join(map(str, c.library.encode(text, add_special_tokens=False).ids))


@pytest.mark.parametrize("leaf", [1, 3, 17, 64])
def test_tree_concatenation_is_exact(own, leaf):
    rng = random.Random(leaf)
    units = ["".join(rng.choice(["a", "b", "in", "the", "ing", "tion", "aaaa", "Ã©"]) for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["a" * 999, "ab" * 300, "*" * 800]
    for unit in units:
        parts = [unit[i : i + leaf] for i in range(0, len(unit), leaf)]
        got = bpe.join_tree([own.encode_part(p, i == len(parts) - 1) for i, p in enumerate(parts)], own.surface, own.encode_part)
        assert got == own.encode_part(unit, True)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one two three", "a b c d", "a b c d e a b c d e", "É Ä z q r s t u", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text or "")


def brute_groups(prints, radius=20):
    """Every pair of wide fingerprints that agrees under a mask, by single bits."""
    ids = list(prints)
    bits = np.array([np.unpackbits(prints[i].view(np.uint8), bitorder="little") for i in ids]).reshape(len(ids), 128).astype(bool)
    under = np.array([np.unpackbits(m.view(np.uint8), bitorder="little") for m in simhash.masks()]).astype(bool)
    group = dict(zip(ids, ids))
    for i in range(len(ids)):
        apart = bits[i] ^ bits[:i]
        for j in np.flatnonzero((apart.sum(1) <= radius) & ~(apart[:, None, :] & under[None]).any(2).all(1)):
            a, b = group[ids[i]], group[ids[j]]
            if a != b:
                group = {k: b if g == a else g for k, g in group.items()}
    return group


def shingle_sets(texts):
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}


def test_near_copies_are_told_by_their_shingles(spark):
    """Chains, copies and pairs on both sides of 0.8: none under it goes, all over it do (this table is small enough for the index to propose all)."""
    rng, texts = random.Random(3), {}
    for g in range(40):
        base = [f"w{g}x{rng.randrange(500)}" for _ in range(rng.choice([40, 200, 900]))]
        for changes in (0, 0, 0.004, 0.01, 0.03, 0.06, 0.3):
            other = list(base)
            for at in rng.sample(range(len(base)), int(changes * len(base))):
                other[at] = f"n{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(other)
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: " ", len(texts) + 3: "a b", len(texts) + 4: "A b"}
    sets, group = shingle_sets(texts), {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: b if g == a else g for k, g in group.items()}
    want = {min(i for i in texts if group[i] == g) for g in set(group.values())}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, node int")
    got = {r["doc_id"] for r in simhash.keep_similar(simhash.with_wide_fingerprints(docs)).collect()}
    assert not want - got and len(got - want) <= 2, (want - got, got - want)
    assert simhash.keep_similar(simhash.with_wide_fingerprints(docs.limit(0))).count() == 0


def on_disk(spark):
    """Bytes of shuffle files, and of scratch tables."""
    local = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    sizes = lambda tops, own: sum(os.path.getsize(f"{d}/{f}") for top in tops for d, _, files in os.walk(top) for f in files if own in f)
    return sizes(local, "shuffle_"), sizes([p.removeprefix("file:") for paths in shared._made.values() for p in paths], ".parquet")


def test_near_copies_leave_little_on_disk(spark):
    """Texts are dealt out once, at the end; what the steps before it made has gone by then."""
    rng = random.Random(5)
    texts = [[f"{rng.getrandbits(40):010x}" for _ in range(1500)] for _ in range(300)]
    docs = [(i, " ".join(words)) for i, words in enumerate([*texts, *(words[:-20] for words in texts[:10])])]
    rows = shared.cut(simhash.with_wide_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")))
    size = sum(len(t) for _, t in docs)
    shared.released(spark)
    before = on_disk(spark)
    kept = simhash.keep_similar(rows)
    steps = on_disk(spark)
    assert steps[0] - before[0] < size / 4 and steps[1] == before[1], (size, before, steps)
    assert {r["doc_id"] for r in kept.collect()} == set(range(300))
    assert on_disk(spark)[0] - steps[0] < 1.5 * size


def test_texts_that_a_join_may_need(spark):
    rows = spark.range(4000).select(F.xxhash64("id").alias("node"), F.col("id").alias("text"))
    assert simhash._among(rows, rows.limit(0)).count() == 0
    for step in (1, 40, 4000):
        nodes = shared.cut(rows.where(F.col("text") % step == 0).select("node"))
        got = {r["text"] for r in simhash._among(rows, nodes).collect()}
        assert set(range(0, 4000, step)) <= got and len(got) < 4000 // step + 4000 // 5


def test_near_copies_do_not_hang_on_the_index(spark):
    """Pairs of 90 shingles each that share 80 (0.8 exactly) or 79: all of the first go, whatever the index proposes."""
    texts, want = [], set()
    for g in range(400):
        new = 10 if g % 4 else 11
        words = [f"g{g}w{i}" for i in range(94)]
        want |= {2 * g} if new == 10 else {2 * g, 2 * g + 1}
        texts += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:-new] + [f"n{g}w{i}" for i in range(new)]))]
    rows = simhash.with_wide_fingerprints(spark.createDataFrame(texts, "doc_id long, text string")).localCheckpoint()
    assert {r["doc_id"] for r in simhash.keep_similar(rows).collect()} == want
    few = rows.where("doc_id < 80")
    for w0 in (F.lit(7).cast("long"), F.xxhash64("doc_id")):  # all fingerprints equal, or none near another
        odd = few.withColumn("fp", F.col("fp").withField("w0", w0).withField("w1", F.hash(w0).cast("long") * 1_000_003))
        assert {r["doc_id"] for r in simhash.keep_similar(odd).collect()} == {i for i in want if i < 80}


def test_prefixes_and_parity_codes_lose_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.unique(np.concatenate([x[: int(n * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        late = np.unique(rng.choice(x, n // 3))
        rank = rng.integers(1, 9, len(late))
        if both and both >= 0.8 * (len(x) + len(y) - both):
            assert np.intersect1d(simhash.prefix(x, late, rank), simhash.prefix(y, late, rank)).size
        codes = [simhash.parity_code(s) for s in (x, y)]
        assert simhash.codes_apart(codes[:1], codes[1:])[0] <= len(x) + len(y) - 2 * both
        assert (simhash.codes_apart(codes, codes) == 0).all()
    # pairs across components of one bucket, of sizes that allow 0.8; made one row at a time they are the same
    rows = np.array([(n, n % 3, 50 + n) for n in range(30)], np.int64)
    pairs = {(a, b) for a in range(30) for b in range(a) if a % 3 != b % 3 and a // 15 == b // 15 and 50 + b >= 0.8 * (50 + a)}
    found = simhash._across(0.8)(np.arange(30) // 15, rows.view(np.uint64))
    assert {(b, a) for f in found for a, b in f.itertuples(index=False)} == pairs


@pytest.mark.parametrize(("crowd", "centre", "centres"), [(16, 256, 3), (0.5, 2, 2), (1, 8, 0)])
def test_families_just_under_the_similarity(spark, monkeypatch, crowd, centre, centres):
    rng, texts = random.Random(5), {}
    for family in range(2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(150):  # four to seven words changed: most pairs of these share half to three quarters of all shingles
            other = list(base)
            for at in rng.sample(range(150), rng.randrange(4, 8)):
                other[at] = f"x{rng.randrange(3)}" if family else f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(other)
            if rng.random() < 0.1:  # and a near copy of its own
                other[rng.randrange(150)] = "y"
                texts[len(texts)] = " ".join(other[: rng.randrange(140, 151)])
    texts |= {len(texts) + i: t for i, t in enumerate(["", "a b c", " ".join(base), *(" ".join(f"z{rng.randrange(400)}" for _ in range(90)) for _ in range(20))])}
    made = []

    def kept(df, name, *more, store=simhash.stored):
        made.append((name, store(df, name, *more)))
        return made[-1][1]

    for name, value in (("CROWD", crowd), ("CENTRE", centre), ("CENTRES", centres), ("stored", kept)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rows = simhash.with_wide_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).cache()
    found = simhash.unproposed(rows, spark.createDataFrame([], "a long, b long")).collect()
    if centre == 256:  # with good centres few pairs are made (14 350 without families)
        assert sum(df.select("a", "b").distinct().count() for name, df in made if name == "prefix-pairs") < 3000
    node = {r["doc_id"]: r["node"] for r in rows.select("doc_id", "fp.node").collect()}
    sets = {node[i]: s for i, s in shingle_sets(texts).items()}
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y)

    def groups(pairs):
        tied = {n: n for n in sets}
        for a, b in pairs:
            if tied[a] != tied[b] and similar(sets[a], sets[b]):
                tied = {k: tied[a] if g == tied[b] else g for k, g in tied.items()}
        return {frozenset(k for k in tied if tied[k] == g) for g in tied.values()}

    want = groups((a, b) for a in sets for b in sets if a < b)
    assert groups((r["a"], r["b"]) for r in found) == want and 100 < len(want) < len(texts) - 20


def test_wide_links_and_similarity(spark):
    masks = np.array([np.unpackbits(m.view(np.uint8)) for m in simhash.masks()])
    assert masks.shape == (96, 128) and (masks.sum(1) == 16).all() and all((masks[i : i + 8].sum(0) == 1).all() for i in range(0, 96, 8))
    assert simhash.radius_of(1) == 0 and simhash.radius_of(0.8) == 20 and simhash.radius_of(0, 64) == 32 and simhash.radius_of(0.8, spreads=3) == 32
    rng, codes = np.random.default_rng(8), []
    for _ in range(12):
        first = rng.integers(0, 2, 128)
        for spread in (0, 0, 1, 5, 7, 12, 20, 30):
            other = first.copy()
            other[rng.choice(128, spread, replace=False)] ^= 1
            codes.append(np.packbits(other.astype(np.uint8), bitorder="little").view(np.uint64))
    prints = dict(enumerate(codes))
    rows = [(i, (int(c.view(np.int64)[0]), int(c.view(np.int64)[1]))) for i, c in prints.items()]
    df = spark.createDataFrame(rows, "doc_id long, fp struct<w0: long, w1: long>")
    group = brute_groups(prints)
    node = {r["doc_id"]: r["node"] for r in df.select("doc_id", simhash.node_of("fp").alias("node")).collect()}
    edges = simhash.similar_links(df, radius=20).collect()
    tied = {n: n for n in node.values()}
    for e in edges:
        a, b = tied[e["a"]], tied[e["b"]]
        tied = {k: b if g == a else g for k, g in tied.items()}
    assert all((tied[node[i]] == tied[node[j]]) == (group[i] == group[j]) for i in prints for j in prints)
    assert all(e["a"] < e["b"] for e in edges) and len({group[i] for i in range(5)}) == 1
    assert simhash.similar_links(df.limit(0)).count() == 0
    # texts: six words of 600 changed are a near copy, half of the words is not
    words = [f"w{i}" for i in rng.integers(0, 10**6, 600)]
    near, far = list(words), list(words)
    near[300:306] = ["x"] * 6
    far[:300] = [f"y{i}" for i in range(300)]
    a, b, c = (simhash.wide_fingerprint(" ".join(w)) for w in (words, near, far))
    assert np.bitwise_count(a ^ b).sum() <= 20 < np.bitwise_count(a ^ c).sum()
    for text in (None, "", " \n "):
        assert not simhash.wide_fingerprint(text).any()
    assert (simhash.wide_fingerprint("A b\tC") == simhash.wide_fingerprint("a B c")).all() and (simhash.wide_fingerprint("a b c d e " * 2) != simhash.wide_fingerprint("a b c d")).any()
    repeated = simhash.wide_fingerprint("a b c d e " * 50)  # repeats of a shingle count once
    assert (repeated == simhash.wide_fingerprint("a b c d e " * 3)).all()


@pytest.mark.parametrize("shape", ["random", "ball", "far"])
def test_gray_index_finds_every_link(shape):
    rng = np.random.default_rng(4)
    if shape == "random":
        codes = rng.integers(0, 1 << 12, 300, dtype=np.uint64)
    elif shape == "ball":
        codes = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(300)], dtype=np.uint64)
    else:
        codes = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    codes = np.unique(codes)
    bucket = (codes & np.uint64(1)).astype(np.int64)
    order = np.lexsort((simhash.gray_rank(codes), bucket))
    bucket, codes = bucket[order], codes[order]
    root = simhash.bucket_links(bucket, codes, 3)
    want = list(range(len(codes)))

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero((np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 3) & (bucket[i + 1 :] == bucket[i])) + i + 1:
            a, b = find(i), find(int(j))
            want[max(a, b)] = min(a, b)
    sets = lambda f: {frozenset(i for i in range(len(codes)) if f(i) == r) for r in {f(i) for i in range(len(codes))}}
    assert sets(find) == sets(lambda i: int(root[i]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40), st.integers(1, 12))
def test_deep_shallow_sorts(strings, shallow):
    assert suffixes.deep_shallow(strings, shallow) == sorted(range(len(strings)), key=lambda i: (strings[i], i))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12).map(lambda b: bytes(x % 2 for x in b)), st.binary(max_size=12).map(lambda b: bytes(x % 2 for x in b))), min_size=2, max_size=25), st.integers(2, 10))
def test_reaches_equal_all_pairs(rows, length):
    lefts, rights = [r[0] for r in rows], [r[1] for r in rows]
    want = []
    for i in range(len(rows)):
        far = [0, 0]
        for j in range(len(rows)):
            left, right = suffixes.common(lefts[i], lefts[j]), suffixes.common(rights[i], rights[j])
            if i != j and left + right >= length:
                far = [max(far[0], left), max(far[1], right)]
        want.append(tuple(far))
    assert suffixes.reaches(lefts, rights, length) == want


def test_anchors_depend_on_content_only():
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 101) for _ in range(130))
    one, two = (bytes(rng.randrange(97, 123) for _ in range(n)) + shared + bytes(rng.randrange(97, 123) for _ in range(n)) for n in (57, 301))
    places = [{int(a) - len(x[: x.find(shared)]) for a in suffixes.anchors(x, 100)[0]} for x in (one, two)]
    inside = [{p for p in s if 0 <= p <= len(shared) - suffixes.GRAM} for s in places]
    for start in range(len(shared) - 100 + 1):
        assert {p for p in inside[0] & inside[1] if start <= p <= start + 100 - suffixes.GRAM}
    for text in (b"", b"a" * 99, b"a" * 100, b"ab" * 900):
        at, h, low, high = suffixes.anchors(text, 100)
        assert len(at) == len(h) and all(any(s <= p <= s + 100 - suffixes.GRAM for p in at) for s in range(len(text) - 99))
        # each window belongs to one anchor that it holds
        assert sorted(p - s for p, a, b in zip(at, low, high) for s in range(a, b + 1)) == list(range(max(0, len(text) - 99)))
        assert all(0 <= a <= b <= 100 - suffixes.GRAM for a, b in zip(low, high))


def test_anchors_go_on_over_pieces(monkeypatch):
    text = bytes(random.Random(4).randrange(97, 123) for _ in range(3000)) + b"x" * 500
    whole = suffixes.anchors(text, 100)
    monkeypatch.setattr(suffixes, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, suffixes.anchors(text, 100)))


def brute_repeated(words):
    c = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({k for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40))
def test_repeated_words(words):
    assert rules.repeated_words(words) == brute_repeated(words)


def test_measures_of_odd_texts():
    assert rules.measures("") == (0, 0, 0, 0, 0)
    assert rules.measures(" \n\n\t") == (0, 0, 0, 0, 0)
    assert rules.measures("é#\né#\n \n \nx y") == (3, 7, 2, 1, 0)


def test_forest_learns_and_is_flat():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = classifier.fit(x[:1500], y[:1500], trees=40, depth=3)
    s = forest.scores(x[1500:])
    assert ((s > 0.5) == y[1500:]).mean() > 0.95 and s.min() >= 0 and s.max() <= 1
    one = forest.base
    for t in range(len(forest.leaf)):  # a plain walk
        node = 0
        while node < forest.feature.shape[1]:
            node = 2 * node + 1 + (x[7, forest.feature[t, node]] > forest.threshold[t, node])
        one += forest.leaf[t, node - forest.feature.shape[1]]
    assert forest.scores(x[7:8])[0] == pytest.approx(1 / (1 + np.exp(-one)))
    assert classifier.fit(np.zeros((0, 5)), np.zeros(0)).scores(x[:2]).tolist() == [0.5, 0.5]
    assert len(set(classifier.fit(x[:9], np.ones(9)).scores(x[:5]))) == 1


def test_features_of_odd_texts():
    for t in (None, "", " ", "\n\n", "é", "x" * 10_000, "a b " * 5000):
        f = classifier.features(t)
        assert f.shape == (len(classifier.FEATURES),) and np.isfinite(f).all()


def test_forest_walks_as_its_trees_say():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 5)), 1)
    forest = classifier.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=7, depth=3)
    inner = forest.feature.shape[1]

    def one(row):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.scores(x), [one(r) for r in x]) and len(forest.leaf) == 7


def test_splitting_tree_draws_as_the_hypergeometric_law():
    # a shard of three gets a third of all draws; of a source's 12 of 36 draws it has k with the hypergeometric chance
    quotas, draws = np.array([12, 24]), 4000
    got = Counter(int(np.diff(mixing.split_quotas(quotas, 3, [s]), axis=1)[0, 1]) for s in range(draws))
    want = {k: math.comb(12, k) * math.comb(24, 12 - k) / math.comb(36, 12) for k in range(13)}
    chi = sum((got[k] - draws * p) ** 2 / (draws * p) for k, p in want.items() if draws * p >= 5)
    assert chi < 30 and abs(sum(k * n for k, n in got.items()) / draws - 4) < 0.1
    several = [np.diff(mixing.split_quotas(np.array([5, 9, 16]), 4, [s]), axis=1) for s in range(2000)]
    assert np.allclose(np.mean(several, axis=0), np.outer([5, 9, 16], [7, 8, 7, 8]) / 30, atol=0.2)


def test_splitting_tree_keeps_quotas():
    q = np.array([10, 0, 7, 1])
    bounds = mixing.split_quotas(q, 6, [1])
    assert (bounds[:, -1] == q).all() and (np.diff(bounds, axis=1) >= 0).all()
    per_shard = np.diff(bounds, axis=1).sum(axis=0)
    assert per_shard.max() - per_shard.min() <= 1 and (bounds == mixing.split_quotas(q, 6, [1])).all()


def test_probing_meets_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 64))
    h = ann.learn(x, 10)
    for radius in (0, 9, 20, 30):
        h.radius = radius
        block = ann.Block(np.arange(500), x, h)
        q, r = block.candidates(block.codes[:40])
        whole = block.codes.view(np.uint64)[:, 0]
        want = {(i, j) for i in range(40) for j in range(500) if int(whole[i] ^ whole[j]).bit_count() <= radius}
        assert set(zip(q.tolist(), r.tolist())) == want and len(q) == len(want)


def test_parse_of_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    assert [b for _, b in warc.parse(record * 2)] == [b"a\r\n\r\n"] * 2
    for bad in (record[:-1], b"junk" + record, record[:20]):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse(bad))
    assert list(warc.parse(b"")) == []
