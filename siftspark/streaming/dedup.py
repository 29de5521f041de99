"""Streaming forms of exact and windowed deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftspark.functions import text


def exact(stream: DataFrame, text_col: str = "text", time_col: str = "ts", within: str = "1 hour") -> DataFrame:
    """Drops copies of the normalised text that come within the watermark; state is bounded by it."""
    return stream.withColumn("_key", F.md5(text.normalize(F.col(text_col)).cast("binary"))).withWatermark(time_col, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_jaccard(stream: DataFrame, threshold: float = 0.8, window: int = 100, n: int = 3, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source") -> DataFrame:
    """group, id, kept: a row is dropped if it is like one of the last `window` kept rows of its group, over all batches.

    State is the grams of those rows, so it is bounded for each group.
    """
    grams = stream.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), text.ngrams(text.normalize(F.coalesce(F.col(text_col), F.lit(""))), n).alias("grams"))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = [set(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(frames)).sort_values("id")
        out = []
        for i, items in zip(rows["id"], rows["grams"], strict=True):
            own = set(items)
            like = any((len(own & m) / len(own | m) if own or m else 1.0) >= threshold for m in memory)
            out.append((key[0], i, not like))
            if not like:
                memory = [*memory, own][-window:]
        state.update(([sorted(m) for m in memory],))
        yield pd.DataFrame(out, columns=["g", "id", "kept"])

    kinds = dict(grams.dtypes)
    return grams.groupBy("g").applyInPandasWithState(fold, f"g {kinds['g']}, id {kinds['id']}, kept boolean", "memory array<array<string>>", "append", GroupStateTimeout.NoTimeout)
