"""A quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted on the driver from a bounded sample of labelled documents and kept as flat arrays (a complete binary
tree a row), which a worker walks for a whole batch and all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.shared import small_batches, spread

#: Labelled documents that trees are fitted on, at most: the least by a hash of their id. Bounds what the driver gathers.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE = 80, 4, 64, 0.15, 8, 1.0
THRESHOLD = 0.3
#: One row in FOLDS is held out.
FOLDS = 5

_BYTES = [b"\n", b".", b",", b"!", b"?", b"|", b"#", b"*", b"$", b"%", b"&", b"<", b">", b"/", b"@", b":", b"-", b'"', b"'", b"{", b"(", b"="]
_CODES = np.array([x[0] for x in _BYTES])
FEATURES = [
    "log_bytes", "log_words", "word_length", "short_words", "long_words", "upper", "lower", "digits", "spaces", "high_bytes", "entropy",
    "distinct_words", "top_word", "distinct_pairs", "lines", "line_words", "repeated_lines", "capital_words", "marked_words", "shouted_words",
    *(f"byte_{x.decode()}" if x != b"\n" else "byte_newline" for x in _BYTES),
]


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; an empty one has zeros."""
    out = np.zeros(len(FEATURES))
    b = (text or "").encode()
    if not b:
        return out
    n, counts = len(b), np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words = b.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    met: dict[bytes, int] = {}
    for w in words:
        met[w] = met.get(w, 0) + 1
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    out[:20] = (
        np.log1p(n), np.log1p(len(words)), lengths.mean(), (lengths <= 3).sum() / k, (lengths >= 12).sum() / k,
        counts[65:91].sum() / n, counts[97:123].sum() / n, counts[48:58].sum() / n, (counts[32] + counts[9]) / n, counts[128:].sum() / n,
        -(share * np.log2(share)).sum(), len(met) / k, max(met.values(), default=0) / k, len(set(zip(words, words[1:]))) / k,
        len(lines) / k, k / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum([w.istitle() for w in words]) / k, sum([not w[-1:].isalnum() and w[-1] < 128 for w in words]) / k, sum([w.isupper() for w in words]) / k,
    )
    out[20:] = counts[_CODES] / n
    return out


@dataclass
class Forest:
    """feature, threshold: (trees, nodes) of complete trees, children of node i are 2 i + 1 and 2 i + 2; leaf: (trees, leaves)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.base)
        if len(self.leaf):
            trees, rows = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
            inner = self.feature.shape[1]
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total += self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Newton boosting on the logistic loss over binned features. Without rows or with one label: a constant."""
    inner = 2**depth - 1
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    empty = Forest(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total, feature, threshold, leaf = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        tree_f, tree_t, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            at = node - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell, size = at * bins + binned[:, f], width * bins
                gs = np.bincount(cell, g, size).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cell, h, size).reshape(width, bins).cumsum(axis=1)
                ns = np.bincount(cell, minlength=size).reshape(width, bins).cumsum(axis=1)
                gain = gs**2 / (hs + RIDGE) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + RIDGE) - gs[:, -1:] ** 2 / (hs[:, -1:] + RIDGE)
                gain[(ns < LEAST_LEAF) | (ns[:, -1:] - ns < LEAST_LEAF)] = 0
                gain = gain[:, : len(e)]
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                for k in np.flatnonzero(top > best):
                    best[k], tree_f[first + k], tree_t[first + k] = top[k], f, e[cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), tree_f[node]] > tree_t[node])
        at = node - inner
        value = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        total = total + value[at]
        feature.append(tree_f), threshold.append(tree_t), leaf.append(value)
    return Forest(base, np.array(feature), np.array(threshold), np.array(leaf))


def fold(doc_id: object, folds: int = FOLDS) -> object:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _with_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "x": [features(t) for t in frame["text"]]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, folds: int = FOLDS) -> Forest:
    """Fits trees on at most `sample` labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null ids take no part. Of documents that share an id one counts, and
    of label rows that share one their majority (a tie is 1). Without labels the score is 0.5 everywhere.
    """
    small_batches(docs.sparkSession)
    some = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    picked = docs.join(F.broadcast(some.select(F.col("id").alias(f"{id_col}_of_label"))), F.col(id_col) == F.col(f"{id_col}_of_label"), "left_semi")
    seen = _with_features(picked, id_col, text_col).groupBy("id").agg(F.min("x").alias("x"))
    rows = seen.join(F.broadcast(some), "id").orderBy("id").toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    y = (rows["y"].to_numpy(dtype=float) >= 0.5).astype(float) if len(rows) else np.zeros(0)
    return fit(x, y)


def score(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int): 1 if score is at least threshold. Null texts count as empty.

    Only the text is read; columns of docs called score or predicted give way.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.stack([features(t) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    return spread(docs).withColumn("score", scored(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
