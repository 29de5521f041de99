"""Classification of files by suffix, magic bytes, JSON keys and printable bytes."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff")
AUDIO_SUFFIXES = (".wav", ".mp3", ".aac", ".flac", ".ogg", ".m4a", ".wma")
TEXT_SUFFIXES = (".txt", ".csv", ".md", ".xml", ".yaml", ".yml", ".ini", ".log", ".tsv")
STRICT_IMAGE, STRICT_AUDIO = (".png", ".jpg", ".jpeg"), (".wav",)
IMAGE_KEYS = ("image", "image_url", "img", "picture", "thumbnail")
AUDIO_KEYS = ("audio", "audio_url", "audio_path", "wav", "mp3")
TEXT_KEYS = ("text", "content", "title", "sentence", "article")
HEADER_BYTES, PRINTABLE_SHARE, LIST_ITEMS = 4096, 0.85, 10
#: Bytes that do not count as printable in Latin-1 text.
UNPRINTABLE = (*range(0x00, 0x09), *range(0x0E, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0), 0xAD)
_UNPRINTABLE = bytes(UNPRINTABLE)


def suffix(path: Column) -> Column:
    """The lower-cased last suffix of a path's name, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]*)$", 1))


def is_image_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"\.(jpe?g|png|gif|bmp|webp)"), F.lit(False))


def mostly_printable(content: Column) -> Column:
    """Whether 85 % of the header's bytes or more are printable; false if there are none."""

    @F.pandas_udf("boolean")
    def test(headers: pd.Series) -> pd.Series:
        return headers.map(lambda h: bool(h) and len(bytes(h).translate(None, _UNPRINTABLE)) / len(h) >= PRINTABLE_SHARE)

    return test(F.substring(content, 1, HEADER_BYTES))


def magic(content: Column) -> Column:
    """image, audio or text by the first bytes, else null. JPEG has no entry."""
    head = F.substring(content, 1, HEADER_BYTES)
    hexed = F.hex(head)
    begins = lambda *h: hexed.rlike("^(" + "|".join(h) + ")")
    latin = F.decode(head, "ISO-8859-1")
    left = F.regexp_extract(latin, r"^[ \t\n\r\x0B\f]*(.)", 1)
    return (
        F.when(begins("89504E470D0A1A0A", "474946383761", "474946383961"), "image")
        .when(begins("52494646.{8}57415645", "494433", "664C6143"), "audio")
        .when(F.contains(latin, F.lit("metadata:image")) | F.contains(F.lower(latin), F.lit("<svg")), "image")
        .when(left.isin("{", "["), "text")
    )


def _of_dict(value: dict) -> str:
    for kind, keys in (("image", IMAGE_KEYS), ("audio", AUDIO_KEYS), ("text", TEXT_KEYS)):
        if any(k in value for k in keys):
            return kind
    url = value.get("url")
    return "image" if isinstance(url, str) and any(x in url.lower() for x in (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")) else "text"


def json_label_of(value: object) -> str:
    """The label of parsed JSON. A list votes with its first ten items; ties go to the label met first."""
    if isinstance(value, dict):
        return _of_dict(value)
    if not isinstance(value, list):
        return "text"
    votes: Counter = Counter()
    for item in value[:LIST_ITEMS]:
        if isinstance(item, dict):
            for kind, keys in (("image", IMAGE_KEYS), ("audio", AUDIO_KEYS), ("text", TEXT_KEYS)):
                votes[kind] += any(k in item for k in keys)
            if isinstance(item.get("url"), str) and _of_dict({"url": item["url"]}) == "image":
                votes["image"] += 1
        elif isinstance(item, str) and item.strip():
            votes["text"] += 1
        votes = Counter({k: v for k, v in votes.items() if v})
    return max(votes, key=votes.__getitem__) if votes else "text"


def json_label(content: Column) -> Column:
    """image, audio or text for bytes that parse as JSON, else null. Bytes that are not UTF-8 are skipped."""

    @F.pandas_udf("string")
    def label(contents: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            try:
                return json_label_of(json.loads(bytes(data or b"").decode("utf-8", "ignore")))
            except (ValueError, RecursionError):
                return None

        return contents.map(one)

    return label(content)


def json_object_label(text: Column) -> Column:
    """The label of JSON objects in a string column, in SQL; null where the text is no object."""
    keys = F.json_object_keys(text)
    has = lambda names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    return F.when(keys.isNull(), None).when(has(IMAGE_KEYS), "image").when(has(AUDIO_KEYS), "audio").when(has(TEXT_KEYS), "text").when(is_image_url(F.get_json_object(text, "$.url")), "image").otherwise("text")


def category(path: Column, length: Column, content: Column, strict_sniff: bool = False) -> Column:
    """image, audio, text, unknown or error by content.

    .png, .jpg, .jpeg and .wav are believed unread unless strict_sniff. A null length is an error; empty files are unknown.
    """
    s, m, j = suffix(path), magic(content), json_label(content)
    printable = mostly_printable(content)
    as_json = F.coalesce(j, F.lit("text"))
    by_suffix = (
        F.when(s == ".json", F.coalesce(j, m, F.when(printable, "text"), F.lit("unknown")))
        .when(s.isin(*IMAGE_SUFFIXES), F.when(m == "text", as_json).otherwise(F.coalesce(m, F.lit("image"))))
        .when(
            s.isin(*AUDIO_SUFFIXES),
            F.when(m.isin("audio", "image"), m)
            .when(m == "text", F.coalesce(j, F.when(printable, "text"), F.lit("unknown")))
            .when(printable, as_json).otherwise("audio"),
        )
        .when(s.isin(*TEXT_SUFFIXES), F.when(m.isin("image", "audio"), m).when(printable, "text").otherwise(as_json))
        .otherwise(F.when(m == "text", as_json).when(m.isNotNull(), m).when(printable, as_json).otherwise("unknown"))
    )
    sized = F.when(length.isNull(), "error").when(length == 0, "unknown").otherwise(by_suffix)
    if strict_sniff:
        return sized
    return F.when(s.isin(*STRICT_IMAGE), "image").when(s.isin(*STRICT_AUDIO), "audio").otherwise(sized)


def strict_category(path: Column, content_category: Column) -> Column:
    """Images keep their label only as .png, .jpg or .jpeg, audio only as .wav; others become unknown."""
    s = suffix(path)
    return (
        F.when((content_category == "image") & ~s.isin(*STRICT_IMAGE), "unknown")
        .when((content_category == "audio") & ~s.isin(*STRICT_AUDIO), "unknown")
        .otherwise(content_category)
    )
