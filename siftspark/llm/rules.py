"""Quality rules from the frequency of lines across documents.

Lines are normalised (white space and case folded, digits made equal) and hashed. For each host the distinct texts that
hold a line are counted; copies of one text count once, so that a page with many copies does not make its own lines
common. Lines above the limit, a share of the host's texts, are removed, and a document that has lost too much, or fails
the base rules, is rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.shared import fresh, small_batches, spread, stored

#: A line is boilerplate if it is found in more than this share of its host's distinct texts, and in more than so many.
LINE_SHARE, LINE_LEAST = 0.1, 5
#: A document is depleted if boilerplate lines held more than this share of its words ...
DEPLETED_SHARE = 0.5
#: ... or if fewer words than this are left.
LEAST_WORDS = 50
#: Largest share (in hundredths) of words in repeated three-word windows.
REPEATED_PERCENT = 50

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words in n-word windows that are found twice or more, the first find included."""
    if len(words) <= n:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) == len(words):
        return 0
    code = ids[: len(ids) - n + 1]
    for k in range(1, n):
        # each step numbers the windows so far anew, so that codes stay small
        both = code * len(numbers) + ids[k : k + len(code)]
        code = np.unique(both, return_inverse=True)[1] if k < n - 1 and len(numbers) > 1 << 20 else both
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return 0
    covered = np.zeros(len(words), dtype=bool)
    for k in range(n):
        covered[again + k] = True
    return int(covered.sum())


def line_hash(line: bytes) -> int:
    """Of a line with white space and letter case folded and digits made equal; signed 64 bits."""
    folded = b" ".join(line.split()).decode(errors="replace").lower().encode(errors="replace").translate(_DIGITS)
    return int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "big", signed=True)


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    b = text.encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    chars = len(text) - (len(b) - len(b.translate(None, SPACE)))
    return len(words), chars, len(b) - len(b.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _measure(frames: Iterator[pd.DataFrame], at: int) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key", "lines", "line_words"]
    for frame in frames:
        rows = []
        for t in frame.iloc[:, at]:
            text = t or ""
            b = text.encode()
            held: dict[int, int] = {}
            for line in b.split(b"\n"):
                if n := len(line.split()):
                    key = line_hash(line)
                    held[key] = held.get(key, 0) + n
            rows.append((*measures(text), hashlib.blake2b(b, digest_size=16).digest(), np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))))
        out = frame.drop(columns=frame.columns[at])
        for k, name in enumerate(names):
            out[name] = [r[k] for r in rows]
        yield out


def host_of(host_col: str) -> object:
    return F.xxhash64(F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("\0")))


def _measured(docs: DataFrame, host_col: str, text_col: str, names: list[str]) -> DataFrame:
    """docs without the text, with measures, the text's key, its lines' hashes and words, and the host's key: written once."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text_col)
    numbers = ", ".join(f"{n} long" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    told = spread(docs).mapInPandas(lambda x: _measure(x, at), f"{fields}{numbers}, text_key binary, lines array<long>, line_words array<long>")
    return stored(told.withColumn(names[0], host_of(host_col)), "lines")


def _common(rows: DataFrame, host: str, line_share: float, line_least: int) -> DataFrame:
    """host_key, line: lines above their host's limit. rows: from _measured()."""
    # a text counts once for a host, however many copies it has
    texts = rows.select(F.col(host).alias("host_key"), "text_key", "lines").dropDuplicates(["host_key", "text_key"])
    found = texts.select("host_key", F.explode("lines").alias("line")).groupBy("host_key", "line").agg(F.count("*").alias("n")).where(F.col("n") > line_least)
    hosts = texts.groupBy("host_key").agg((F.count("*") * F.lit(line_share)).alias("most"))
    # its size is known once it is stored, so Spark broadcasts it only if it is small
    return stored(found.join(hosts, "host_key").where(F.col("n") > F.col("most")).select("host_key", "line"), "common-lines")


def judge(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", line_share: float = LINE_SHARE, line_least: int = LINE_LEAST,
    depleted_share: float = DEPLETED_SHARE, least_words: int = LEAST_WORDS, repeated_percent: int = REPEATED_PERCENT,
) -> DataFrame:
    """A row for each row of docs: its columns but the text, the five measures, base_failed, words_left and kept.

    Null texts count as empty (and fail). Rows with a null host are one host. Columns of docs that clash with these
    names give way, whatever others are called. The measured table is written once to the shared folder and read for
    both counts.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_key", "lines", "line_words", "base_failed", "words_left", "kept"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made - {text_col.lower(), host_col.lower()}])
    host, gone = fresh(docs, "host_key", "words_lost")
    rows = _measured(docs, host_col, text_col, [host])
    common = _common(rows, host, line_share, line_least)
    lost = (
        rows.select(F.col(host).alias("host_key"), "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
        .select("host_key", "text_key", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w"))
        .join(common, ["host_key", "line"])
        .select("host_key", "text_key", "line", "w").distinct()
        .groupBy("host_key", "text_key").agg(F.sum("w").alias(gone)).withColumnRenamed("host_key", host)
    )
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))
    return (
        rows.drop("lines", "line_words").join(lost, [host, "text_key"], "left")
        .withColumn("base_failed", base)
        .withColumn("words_left", F.col("n_words") - F.coalesce(gone, F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= least_words) & (F.col("words_left") >= (1 - depleted_share) * F.col("n_words")))
        .drop(host, "text_key", gone)
    )


def common_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", line_share: float = LINE_SHARE, line_least: int = LINE_LEAST) -> DataFrame:
    """host_key, line (hashes): the lines that judge() counts as lost and clean() removes."""
    both = docs.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    return _common(_measured(both, "host", "text", ["host_key"]), "host_key", line_share, line_least)


def clean(docs: DataFrame, common: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs without the lines of common (from common_lines()): the texts that judge() counts words_left of.

    Lines without words stay, and so do null texts.
    """
    small_batches(docs.sparkSession)
    key, gone = fresh(docs, "host_key", "gone_lines")
    # a line counts only if over a share of its host's texts hold it, so a host's list is short
    lists = common.groupBy(F.col("host_key").alias(key)).agg(F.collect_set("line").alias(gone))

    @F.pandas_udf("string")
    def without(texts: pd.Series, lines: pd.Series) -> pd.Series:
        def one(text: str | None, gone: object) -> str | None:
            if text is None or gone is None:
                return text
            dropped = set(gone)
            return "\n".join(x for x in text.split("\n") if not x.encode().split() or line_hash(x.encode()) not in dropped)

        return pd.Series([one(t, g) for t, g in zip(texts, lines, strict=True)])

    return docs.withColumn(key, host_of(host_col)).join(lists, key, "left").withColumn(text_col, without(text_col, gone)).select(*[F.col(f"`{c}`") for c in docs.columns])
