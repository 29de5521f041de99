"""Functions under SQL names, for spark.sql() users. What Spark's own functions can say is a SQL function (no Python)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftspark.functions import sketch, text
from siftspark.functions.classify import AUDIO_KEYS, IMAGE_KEYS, TEXT_KEYS

# Bodies in Spark's SQL; the same expressions as in functions/text.py and functions/vectors.py.
_BODIES = {
    "text_normalize(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(lower(t), '(?U)[^\\w\\s\\x{4e00}-\\x{9fff}]', ' '), '(?U)\\s+', ' '), '(?U)^\\s+|\\s+$', '')",
    "jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "if(size(array_union(a, b)) = 0, 1.0D, size(array_intersect(a, b)) / size(array_union(a, b)))",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))",
    "classify_json(t STRING) RETURNS STRING": "CASE WHEN json_object_keys(t) IS NULL THEN NULL "
    + " ".join(f"WHEN arrays_overlap(json_object_keys(t), array({', '.join(repr(k) for k in keys)})) THEN '{kind}'" for kind, keys in (("image", IMAGE_KEYS), ("audio", AUDIO_KEYS), ("text", TEXT_KEYS)))
    + r" WHEN lower(get_json_object(t, '$.url')) RLIKE '\\.(jpe?g|png|gif|bmp|webp)' THEN 'image' ELSE 'text' END",
    "hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers text_normalize, jaccard, cosine, hamming, classify_json (SQL), ngrams, minhash and simhash (Pandas) for
    this session, names after the prefix, and returns them."""
    names = []
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")
        names.append(prefix + head.split("(")[0])

    @F.pandas_udf("array<string>")
    def ngrams(texts: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([text.grams_of(t, max(1, int(k)), True) for t, k in zip(texts, n, strict=True)])

    @F.pandas_udf("array<long>")
    def minhash(tokens: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([sketch.minhash_of(t, int(k)) for t, k in zip(tokens, n, strict=True)])

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return texts.map(sketch.simhash_of)

    for name, function in (("ngrams", ngrams), ("minhash", minhash), ("simhash", simhash)):
        spark.udf.register(prefix + name, function)
        names.append(prefix + name)
    return names
