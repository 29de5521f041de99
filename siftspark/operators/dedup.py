"""Deduplication of text, bit fingerprints, vectors and files. Each returns rows with kept, original and similarity.

Every operator takes an explicit, unique order column: ascending order says which row of a pair comes first. Columns
called kept, original or similarity give way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions import sketch, text, vectors
from siftspark.operators import fold, greedy, similarity, texts
from siftspark.operators.resolve import resolve
from siftspark.session import checkpointed, spread

def _bare(rows: DataFrame) -> DataFrame:
    return rows.drop("kept", "original", "similarity")


def by_key(rows: DataFrame, key: Column, order_col: str, key_col: str | None = None) -> DataFrame:
    """The first row of each key is kept; null keys are all kept. No shuffle of whole groups: minima are pre-aggregated.

    The key is evaluated once, in a thin table; what the key was made of is only carried if the result uses it.
    key_col: the key's name in the result.
    """
    thin = checkpointed(spread(rows).select(F.col(order_col).alias("_at"), key.alias("_key")))
    firsts = thin.where("_key is not null").groupBy(F.col("_key").alias("_of")).agg(F.min("_at").alias("_first"))
    told = thin.join(firsts, F.col("_key") == F.col("_of"), "left").select(
        "_at", *([F.col("_key").alias(key_col)] if key_col else []), (F.col("_first").isNull() | (F.col("_at") == F.col("_first"))).alias("kept"),
        F.when(F.col("_at") != F.col("_first"), F.col("_first")).alias("original"),
    )
    return _bare(rows).join(told, F.col(order_col) == F.col("_at")).withColumn("similarity", F.when(~F.col("kept"), 1.0)).drop("_at")


def md5_text(docs: DataFrame, order_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Exact copies of the normalised text."""
    return by_key(docs, F.md5(text.normalize(F.col(text_col)).cast("binary")), order_col, key_col)


def file_hash(files: DataFrame, order_col: str = "path", content_col: str = "content", algorithm: str = "sha1") -> DataFrame:
    """Exact copies of bytes; unreadable (null) contents are kept. algorithm: md5, sha1, sha224, sha256, sha384, sha512."""
    c = F.col(content_col)
    known = {"md5": lambda: F.md5(c), "sha1": lambda: F.sha1(c)} | {f"sha{n}": (lambda n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)}
    if algorithm not in known:
        raise ValueError(f"unknown hash {algorithm}")
    return by_key(files, known[algorithm](), order_col)


def jaccard_text(docs: DataFrame, threshold: float = 0.8, n: int = 3, order_col: str = "doc_id", text_col: str = "text", dataset_rules: bool = False, both_empty: bool = True) -> DataFrame:
    """Greedy near-duplicates by n-gram Jaccard. dataset_rules: the other normalisation, and no grams for short texts."""
    clean = text.normalize_strip if dataset_rules else text.normalize
    rows = docs.select(F.col(order_col).alias("id"), clean(F.coalesce(F.col(text_col), F.lit(""))).alias("x"))
    return resolve(_bare(docs), texts.edges(rows, threshold, n, not dataset_rules, both_empty), order_col)


def cross_split(splits: dict[str, DataFrame], threshold: float = 0.8, n: int = 3, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over train, then test, then the other splits: a row goes if it is like a kept row of any split.

    Rows come with split; order is (place of the split, order_col). Empty texts are like nothing. Texts are normalised twice.
    """
    names = sorted(splits, key=lambda s: ({"train": 0, "test": 1}.get(s, 2), s))
    rows = reduce(DataFrame.unionByName, [splits[s].select(F.struct(F.lit(i).alias("rank"), F.col(order_col).alias("id")).alias("at"), F.lit(s).alias("split"), F.col(text_col).alias("text")) for i, s in enumerate(names)])
    clean = text.normalize_strip(text.normalize_strip(F.coalesce("text", F.lit(""))))
    done = resolve(rows, texts.edges(rows.select(F.col("at").alias("id"), clean.alias("x")), threshold, n, False, both_empty=False), "at")
    return done.select("split", F.col("at.id").alias(order_col), "text", "kept", F.col("original.rank").alias("original_rank"), F.col("original.id").alias("original"), "similarity")


def _joined(docs: DataFrame, done: DataFrame, order_col: str) -> DataFrame:
    return _bare(docs).join(done, order_col)


def windowed_jaccard(docs: DataFrame, threshold: float = 0.8, window: int = 100, n: int = 3, order_col: str = "doc_id", text_col: str = "text", both_empty: float = 1.0, chunk: Column | None = None) -> DataFrame:
    """Near-duplicates among the last `window` kept rows of a chunk, or of the whole table in order without one (by one task)."""
    grams = spread(docs).withColumn("_grams", text.gram_hashes(text.normalize(F.coalesce(F.col(text_col), F.lit(""))), n))
    return _joined(docs, fold.windowed(grams, fold.jaccard_at_least(threshold, both_empty), "_grams", order_col, window, chunk, prepare=fold.as_set), order_col)


def quick_jaccard(docs: DataFrame, threshold: float = 0.8, sample_size: int = 100, n: int = 3, order_col: str = "doc_id", text_col: str = "text", chunk: Column | None = None) -> DataFrame:
    """As windowed_jaccard(), by the dataset rules; empty texts are like nothing."""
    grams = spread(docs).withColumn("_grams", text.gram_hashes(text.normalize_strip(F.coalesce(F.col(text_col), F.lit(""))), n, False))
    return _joined(docs, fold.windowed(grams, fold.jaccard_at_least(threshold, 0.0), "_grams", order_col, sample_size, chunk, prepare=fold.as_set), order_col)


def chunked_quick(docs: DataFrame, threshold: float = 0.8, chunk_size: int = 5000, sample_size: int = 1000, n: int = 3, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """quick_jaccard() within chunks of so many rows in order; chunks run side by side."""
    rows = fold.chunk_of(docs, order_col, chunk_size)
    return quick_jaccard(rows, threshold, sample_size, n, order_col, text_col, F.col("chunk")).drop("chunk")


def clean_split(docs: DataFrame, mode: str = "standard", threshold: float = 0.8, n: int = 3, workers: int = 1, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A split by mode: standard (all pairs; chunks if workers are given and there are over 1000 rows), fast (a window of a
    tenth of the rows, 1000 at most) or parallel (chunks)."""
    if mode not in ("standard", "fast", "parallel"):
        raise ValueError(f"unknown cleaning mode {mode}")
    total = docs.count()
    if mode == "fast":
        return quick_jaccard(docs, threshold, max(1, min(1000, total // 10)), n, order_col, text_col)
    if mode == "parallel" or (workers > 1 and total > 1000):
        return chunked_jaccard(docs, threshold, max(1, workers), n, order_col, text_col)
    return jaccard_text(docs, threshold, n, order_col, text_col, dataset_rules=True)


def chunk_size(n: int, workers: int) -> int:
    """Rows of a chunk for a table of n rows."""
    if n < 1000:
        return max(100, n // max(2, workers))
    return max(200, n // workers) if n < 10_000 else max(500, min(2000, n // (2 * workers)))


def chunked_jaccard(docs: DataFrame, threshold: float = 0.8, workers: int = 4, n: int = 3, order_col: str = "doc_id", text_col: str = "text", second_pass_below: float = 0.2) -> DataFrame:
    """Near-duplicates within chunks; a second pass over all kept rows only if their share falls below a limit.

    Pairs of sizes beyond a factor of 2 and pairs with an overlap under 0.3 of the smaller set never count.
    """
    total = docs.count()
    rows = fold.chunk_of(docs, order_col, chunk_size(total, workers))

    clean = text.normalize_strip(text.normalize_strip(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.select("chunk", F.col(order_col).alias("o"), clean.alias("x"), F.trim(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    # texts without grams count by their trimmed text
    thin = rows.withColumn("t", F.when(F.length("x") < max(1, n), F.col("t")))
    kind = dict(docs.dtypes)[order_col]
    told = thin.groupBy("chunk").applyInPandas(lambda f: texts.chunk_pass(f, threshold, n), f"o {kind}, kept boolean, original {kind}, similarity double")
    done = checkpointed(_joined(docs, told.withColumnRenamed("o", order_col), order_col))
    left = done.agg(F.count_if("kept").alias("k")).first()["k"]
    if not total or left / total >= second_pass_below:
        return done
    again = jaccard_text(done.where("kept"), threshold, n, order_col, text_col, dataset_rules=True)
    return again.unionByName(done.where("not kept"))


def minhash_lsh(docs: DataFrame, threshold: float = 0.8, num_perm: int = 128, n: int = 3, words: int | None = 0, most: int = 0, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicates that share a band of their MinHash; not verified, so similarity is null.

    words: that many leading words go into the sketch (None: all), most: and that many grams at most (0: all).
    """
    b, r = sketch.area_bands(threshold, num_perm)
    clean = text.normalize(F.coalesce(F.col(text_col), F.lit("")))
    plain = words == 0 and not most and n <= 3
    found = sketch.minhash_of_grams(clean, max(1, n), num_perm) if plain else sketch.minhash(text.char_grams(clean, n, words, most), num_perm)
    rows = checkpointed(spread(docs.select(order_col, text_col)).select(F.col(order_col).alias("id"), found.alias("sketch")))
    edges = similarity.band_edges(rows, b, r).select("a", "b", F.lit(None).cast("double").alias("similarity"))
    return resolve(_bare(docs), edges, order_col)


def simhash_text(docs: DataFrame, radius: int = 10, window: int = 1000, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicates by SimHash among the last `window` kept rows; window of 0 or less: among all, by a join."""
    bits = checkpointed(spread(docs.select(order_col, text_col)).select(F.col(order_col).alias(order_col), sketch.simhash(text.normalize(F.coalesce(F.col(text_col), F.lit("")))).alias("bits")))
    if window > 0:
        return _joined(docs, fold.windowed(bits, fold.hamming_at_most(radius), "bits", order_col, window), order_col)
    edges = similarity.hamming_edges(bits, radius, order_col).withColumn("similarity", F.lit(1.0))
    return resolve(_bare(docs), edges, order_col)


def text_pipeline(docs: DataFrame, method: str = "jaccard", threshold: float = 0.8, n: int = 3, max_candidates: int = 0, window: int = 100, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The text methods by name: jaccard, md5, simhash, minhash_lsh, ours_lsh.

    max_candidates (off by default): above it jaccard gives way to windowed_jaccard(), which misses copies beyond its window.
    """
    how = {
        "md5": lambda: md5_text(docs, order_col, text_col),
        "simhash": lambda: simhash_text(docs, order_col=order_col, text_col=text_col),
        "minhash_lsh": lambda: minhash_lsh(docs, threshold, n=n, order_col=order_col, text_col=text_col),
        "ours_lsh": lambda: minhash_lsh(docs, threshold, n=n, words=200, most=200, order_col=order_col, text_col=text_col),
        "jaccard": lambda: windowed_jaccard(docs, threshold, window, n, order_col, text_col) if max_candidates and docs.count() > max_candidates else jaccard_text(docs, threshold, n, order_col, text_col),
    }
    if method not in how:
        raise ValueError(f"unknown text method {method}")
    return how[method]()


def bits_jaccard(rows: DataFrame, threshold: float = 0.75, order_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Greedy near-duplicates by Jaccard of positive places; vectors without any are like nothing."""
    return greedy.resolve(_bare(rows), greedy.bits(threshold), order_col, vector_col)


def bits_lsh_pairs(rows: DataFrame, threshold: float = 0.75, b: int = 20, r: int = 10, collisions: int = 2, order_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """a, b, collisions, similarity: pairs that share enough bands and are verified. Similar first."""
    places = rows.select(F.col(order_col).alias("id"), vectors.set_bits(F.col(vector_col)).alias("p"))
    cells = checkpointed(places.select("id", "p", sketch.minhash_of_places(F.col("p"), b * r).alias("sketch")))
    pairs = similarity.band_edges(cells, b, r, least_collisions=collisions)
    side = lambda c: cells.select(F.col("id").alias(c), F.col("p").alias(f"p_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("similarity", vectors.bits_jaccard(F.col("p_a"), F.col("p_b"))).where(F.col("similarity") >= threshold).select("a", "b", "collisions", "similarity")


def bits_lsh(rows: DataFrame, threshold: float = 0.75, b: int = 20, r: int = 10, collisions: int = 2, order_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return greedy.resolve(_bare(rows), greedy.bits_lsh(threshold, b, r, collisions), order_col, vector_col)


def cosine(rows: DataFrame, threshold: float = 0.95, strict: bool = False, order_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Greedy near-duplicates by cosine of at least (strict: above) the threshold."""
    return resolve(_bare(rows), similarity.cosine_edges(rows, threshold, order_col, vector_col, strict=strict), order_col)


def audio_pipeline(rows: DataFrame, method: str = "jaccard", threshold: float = 0.75, order_col: str = "path", value_col: str = "fingerprint") -> DataFrame:
    """The audio methods by name over precomputed values: jaccard, lsh (also minhash, hash), md5, phash, mfcc.

    Rows with a null value are kept.
    """
    known = {
        "jaccard": lambda: bits_jaccard(rows, threshold, order_col, value_col),
        "lsh": lambda: bits_lsh(rows, threshold, order_col=order_col, vector_col=value_col),
        "md5": lambda: by_key(rows, F.md5(F.col(value_col).cast("binary")), order_col),
        "phash": lambda: by_key(rows, F.when(F.col(value_col) != "", F.col(value_col)), order_col),
        "mfcc": lambda: cosine(rows, threshold, True, order_col, value_col),
    }
    name = {"minhash": "lsh", "hash": "lsh"}.get(method, method)
    if name not in known:
        raise ValueError(f"unknown audio method {method}")
    return known[name]()


def random_removal(pairs: DataFrame, share: float = 0.5, seed: int = 42) -> DataFrame:
    """b of each pair with a chance of `share`, told by an MD5 of seed and pair, so that reruns agree."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("a").cast("string"), F.col("b").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return pairs.where(place < int(share * (1 << 32))).select("b").distinct()


def dedup_rows(rows: DataFrame, key: Column, order_col: str) -> DataFrame:
    """Distinct by a key, the first by order: paths by their resolved form, for one."""
    w = Window.partitionBy("_key").orderBy(order_col)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")
