"""Text functions: normalisation, n-gram sets, set similarity, small parsers. Columns in, columns out."""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that normalisation drops: neither word characters, nor white space, nor common Han characters.
_NOT_WORD = r"(?U)[^\w\s\x{4e00}-\x{9fff}]"
_SPACES = r"(?U)\s+"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Lower case; other characters become spaces; white space runs become one space; trimmed. Null stays null."""
    return _trim(F.regexp_replace(F.regexp_replace(F.lower(text), _NOT_WORD, " "), _SPACES, " "))


def normalize_strip(text: Column) -> Column:
    """Lower case; white space runs become one space first; then other characters are deleted; trimmed.

    Not idempotent: a deleted character between spaces leaves two of them.
    """
    return _trim(F.regexp_replace(F.regexp_replace(F.lower(text), _SPACES, " "), _NOT_WORD, ""))


def grams_of(text: str | None, n: int, short_text: bool) -> list[str]:
    """What ngrams() gives for one normalised text."""
    if not text:
        return []
    words = text.split()
    chars = (text[i : i + n] for i in range(len(text) - n + 1)) if len(text) >= n else ((text,) if short_text else ())
    joined = (" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return sorted(set(chain(chars, joined)))


def ngrams(normalized: Column, n: int = 3, short_text: bool = True) -> Column:
    """The set of character n-grams and word n-grams (joined by spaces), sorted.

    short_text: a text of under n characters is its own gram (else it has none). Null and empty texts have no grams.
    """
    n = max(1, n)

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: grams_of(t, n, short_text))

    return grams(normalized)


def gram_hashes(normalized: Column, n: int = 3, short_text: bool = True) -> Column:
    """The set of ngrams() as sorted 64-bit hashes: sets are compared and moved as integers."""
    n = max(1, n)

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        # grams repeat within a text and from text to text, so a worker hashes each but once a batch
        known: dict[str, int] = {}

        def one(text: str | None) -> np.ndarray:
            found = grams_of(text, n, short_text)
            for g in found:
                if g not in known:
                    known[g] = int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            return np.sort(np.fromiter((known[g] for g in found), np.int64, len(found)))

        return texts.map(one)

    return hashes(normalized)


def gram_count(normalized: Column, n: int = 3, short_text: bool = True) -> Column:
    """The size of the set of ngrams(), counted where the grams are made."""
    n = max(1, n)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(grams_of(t, n, short_text)))

    return count(normalized)


def json_objects(text: Column) -> Column:
    """array<string>: the JSON objects that stand in a text one after the other, with anything or nothing between them."""

    @F.pandas_udf("array<string>")
    def objects(texts: pd.Series) -> pd.Series:
        reader = json.JSONDecoder()

        def one(t: str | None) -> list[str]:
            out, at = [], (t or "").find("{")
            while at >= 0:
                try:
                    _, stop = reader.raw_decode(t, at)
                    out.append(t[at:stop])
                except ValueError:
                    stop = at + 1
                at = t.find("{", stop)
            return out

        return texts.map(one)

    return objects(text)


def char_grams(text: Column, n: int = 3, words: int | None = 0, most: int = 0) -> Column:
    """Character n-grams of the text without spaces, in order, with repeats; a short text is its own gram.

    words: that many leading words come first (None: all); most: of the grams that many at most (0: all).
    """
    n = max(1, n)

    @F.pandas_udf("array<string>")
    def grams(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            flat = (text or "").replace(" ", "")
            found = [flat[i : i + n] for i in range(len(flat) - n + 1)] if len(flat) >= n else [flat] if flat else []
            return (text or "").split()[:words] + (found[:most] if most else found)

        return texts.map(one)

    return grams(text)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def may_be_similar(len_a: Column, len_b: Column, size_a: Column, size_b: Column, overlap: Column) -> Column:
    """The quick test: lengths within a factor of 2, gram counts within 0.67 to 1.5, overlap 0.3 of the smaller or more."""
    return (
        (len_a > 0) & (len_b > 0) & (size_a > 0) & (size_b > 0)
        & (len_a / len_b).between(0.5, 2.0)
        & (size_a / size_b).between(0.67, 1.5)
        & (overlap >= 0.3 * F.least(size_a, size_b))
    )


def safe_div(a: Column, b: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(b > 0, a / b)


def thousands(c: Column) -> Column:
    return F.coalesce(F.format_number(c, 0), F.lit("-"))


def percent(c: Column) -> Column:
    return F.coalesce(F.format_string("%.2f%%", c * 100.0), F.lit("-"))


def megabytes(c: Column) -> Column:
    return F.coalesce(F.format_string("%.2f MB", c / F.lit(1048576.0)), F.lit("-"))


def first_number(name: Column) -> Column:
    """The first run of digits, null without one."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits != "", digits)


def parse_index(text: Column) -> Column:
    """Integers written as N, N.0 or b'N'; null otherwise."""
    return F.expr("try_cast(null as bigint)") if text is None else F.regexp_extract(text, r"^\s*(?:b')?(-?\d+)(?:\.0)?'?\s*$", 1).try_cast("bigint")


def path_variants(path: Column) -> Column:
    """Ways to write a path, most faithful first: as it is, with / for \\, and both in lower case."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.array_distinct(F.array(path, slashed, F.lower(path), F.lower(slashed)))


def lookup_tokens(path: Column) -> Column:
    """Looser keys of a file name: its stem with and without a leading audio_, its first number as text and as integer."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    bare = F.regexp_replace(stem, r"^audio_", "")
    number = first_number(stem)
    return F.array_distinct(F.array_compact(F.array(stem, bare, F.concat(F.lit("audio_"), bare), number, F.regexp_replace(number, r"^0+(?=\d)", ""))))
