"""BPE encoding and decoding with tree concatenation.

A text splits into chunks at ASCII white space, and a chunk into units at the tokenizer's own boundaries; no merge
crosses them. A long text is cut into leaves of a fixed length, wherever that falls, which are encoded in parallel (rows
of their own, dealt over the cluster). At a join only a window around the cut is encoded again, from the end of the left
part to the start of the right one. It grows until its first part is the one that stood there on the left and its last
the one that stood there on the right. In a run of ordinary text the parts are chunks; in a unit longer than a leaf
(text that nothing splits) they are tokens: every adjacent pair of tokens is then one that some exact encoding contains,
and a token sequence whose adjacent pairs all are is the exact encoding of its string. All joins of a text are rows too
and made side by side, each from the ends of its leaves; a join whose ends were too short to agree is made up the tree.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.shared import fresh, small_batches, spread, stored

#: Longest unit that is encoded whole, in characters of the byte-level alphabet.
LEAF = 2048
#: Texts above LONG characters are cut into leaves of TEXT_LEAF or more.
LONG, TEXT_LEAF = 32_768, 16_384
#: Tokens on each side of a cut that are first encoded again.
WINDOW = 8
#: Parts (chunks or tokens) of a leaf's end that a join sees at most.
CHUNK_ENDS, TOKEN_ENDS = 4, 64
#: Chunks and units that a worker remembers. Of a full memory one older generation is kept, so a worker's memory is bounded.
REMEMBER = 100_000
#: Longest chunk that is remembered.
SHORT = 48
#: Below this code point every character is its own NFC form.
PLAIN = "ɐ"

#: The alternatives that the vocabulary's own pattern lists, in its order.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


SPACES = regex.compile(r"[\x20\x09-\x0D]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def join_parts(left: list, right: list, surface: Callable, encode: Callable, window: int = WINDOW) -> list:
    """The exact encoding of two neighbouring strings from theirs.

    surface(tokens) is their text; encode(text, at_end) encodes one, at_end: it reaches the end of the right part.
    """
    k = window
    while left and right:
        i, j = max(0, len(left) - k), min(len(right), k)
        mid = encode(surface(left[i:]) + surface(right[:j]), j == len(right))
        if (i == 0 or mid[0] == left[i]) and (j == len(right) or mid[-1] == right[j - 1]):
            return left[:i] + mid + right[j:]
        k *= 2
    return left or right


def join_tree(parts: list[list], surface: Callable, encode: Callable, last: bool = True) -> list:
    """Joins the parts pair by pair, level by level. last: the last part reaches the end of the unit."""
    while len(parts) > 1:
        top = len(parts) - 1
        parts = [
            join_parts(parts[i], parts[i + 1], surface, lambda s, e, at=i + 1: encode(s, e and last and at == top)) if i < top else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0] if parts else []


class Codec:
    """A vocabulary file of the tokenizers library with units that end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        own = told["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in own["merges"]]
        self.suffix = own.get("end_of_word_suffix") or ""
        self.final = models.BPE(vocab=own["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.inner = models.BPE(vocab=own["vocab"], merges=merges)
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.special = special
        self.names = {i: t for t, i in own["vocab"].items()} | {i: t for t, i in special.items()}
        self.ends = {i for t, i in own["vocab"].items() if self.suffix and t.endswith(self.suffix)}
        self.letters = "".join(byte_letters()[b] for b in range(256))
        self.units = regex.compile(UNITS)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.chunks = Memory(REMEMBER)
        self.known = Memory(REMEMBER)

    # one unit ------------------------------------------------------------------------------------------------

    def surface(self, ids: list[int]) -> str:
        cut = len(self.suffix)
        return "".join(self.names[i][:-cut] if i in self.ends else self.names[i] for i in ids)

    def encode_part(self, part: str, at_end: bool) -> list[int]:
        return [t.id for t in (self.final if at_end else self.inner).tokenize(part)] if part else []

    def unit(self, unit: str) -> list[int]:
        """unit: a string of the byte-level alphabet."""
        if len(unit) <= LEAF:
            return self.encode_part(unit, True)
        parts = [unit[i : i + LEAF] for i in range(0, len(unit), LEAF)]
        return join_tree([self.encode_part(p, i == len(parts) - 1) for i, p in enumerate(parts)], self.surface, self.encode_part)

    # a chunk: no ASCII white space in it --------------------------------------------------------------------

    def split(self, chunk: str) -> list[int | str]:
        """Special tokens as ids and units as strings of the byte-level alphabet."""
        if self.marks is None or "<|" not in chunk:
            return self._units(chunk)
        out, at = [], 0
        for m in self.marks.finditer(chunk):
            out += [*self._units(chunk[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._units(chunk[at:])

    def _units(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():
            return self.units.findall(chunk.lower())
        if chunk < PLAIN and max(chunk) < PLAIN:
            return [unit.encode().decode("latin-1").translate(self.letters) for unit in self.units.findall(chunk.lower())]
        return [unit for unit, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def said_of(self, unit: str) -> tuple[str, str, int]:
        """A unit's ids and tokens, each joined by spaces, and their number."""
        if len(unit) <= LEAF:
            tokens = self.final.tokenize(unit)
            said = " ".join([str(t.id) for t in tokens]), " ".join([t.value for t in tokens]), len(tokens)
        else:
            ids = self.unit(unit)
            said = " ".join(map(str, ids)), self.decode(ids), len(ids)
        return self.known.put(unit, said) if len(unit) <= SHORT else said

    def _learn(self, chunk: bytes) -> tuple[str, str, int]:
        get, said_of = self.known.__getitem__, self.said_of
        parts = [(str(u), self.names[u], 1) if isinstance(u, int) else get(u) or said_of(u) for u in self.split(chunk.decode())]
        said = parts[0] if len(parts) == 1 else (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts]))
        return self.chunks.put(chunk, said) if len(chunk) <= SHORT else said

    def chunk(self, chunk: str) -> list[int]:
        ids = self._learn(chunk.encode())[0]
        return [int(i) for i in ids.split(" ")] if ids else []

    # a text ---------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces, special ones too."""
        return " ".join([self.names[i] for i in ids])

    def text(self, text: str) -> tuple[str, str, int]:
        """Ids joined by spaces, the decoded text, and the number of ids."""
        get, learn = self.chunks.__getitem__, self._learn
        found = [get(c) or learn(c) for c in text.encode().split()]
        numbers = [f[2] for f in found]
        if not all(numbers):
            found = [f for f in found if f[2]]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum(numbers)


class Memory(dict):
    """What was met lately: two generations of bounded size; get() looks in both."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key: object) -> object:
        return self.old.get(key)

    def put(self, key: object, value: object) -> object:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def row_of(ids: str, decoded: str, n: int) -> tuple:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded


FIELDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "string", "decoded": "string"}


def encode(
    docs: DataFrame, path: str, text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), leaf: int = LEAF, with_text: bool = True,
    long: int = LONG, text_leaf: int = TEXT_LEAF,
) -> DataFrame:
    """docs with the outputs as further columns: one row for each row of docs, columns of docs untouched. Without
    with_text the text goes, and is not carried back from the workers.

    outputs: of n_tokens (long), ids (decimal ids joined by spaces), decoded (text), ids_sha256 and decoded_sha256
    (lower-case hex). A column of docs with an output's name gives way to it. Null and empty texts have no tokens.
    Texts of over `long` characters are encoded by leaves: each distinct one is cut, leaves and joins go wherever there
    is room, and what they give is put together by text. Shorter texts are encoded by one worker, units over LEAF
    characters in them up a tree of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # chunks of ordinary text are under leaf / 4 characters, so half a text leaf holds enough of them for its joins
    text_leaf = max(text_leaf, 2 * leaf)
    docs = spread(docs.drop(*[c for c in docs.columns if c.lower() in outputs]))
    columns = docs.columns
    carried = [f for f in docs.schema if with_text or f.name != text_col]
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), *(f"{c} {FIELDS[c]}" for c in outputs)])
    at, wanted = columns.index(text_col), [list(FIELDS).index(c) for c in outputs]

    def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in frames:
            rows = [row_of(*own.text(t or "")) for t in frame.iloc[:, at]]
            if not with_text:
                frame = frame.drop(columns=frame.columns[at])
            for c, k in zip(outputs, wanted, strict=True):
                frame[c] = [r[k] for r in rows]
            yield frame

    is_long = F.coalesce(F.length(F.col(text_col)) > long, F.lit(False))
    short = docs.where(~is_long).mapInPandas(plain, out_schema)

    (key,) = fresh(docs, "text_key")
    far = docs.where(is_long).withColumn(key, F.sha2(F.col(text_col), 256))
    texts = far.select(F.col(key).alias("k"), F.col(text_col).alias("t")).dropDuplicates(["k"])
    cuts = stored(texts.mapInPandas(_cut(path, leaf, text_leaf), "k string, piece long, leaf long, kind int, last boolean, s string"), "bpe-leaves")
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    leaves = stored(cuts.repartition(n_tasks, "k", "piece", "leaf").mapInPandas(_leaf(path), f"k string, piece long, leaf long, kind int, {SAID}, head string, tail string"), "bpe-tokens")
    right = leaves.where("leaf > 0").select("k", "piece", (F.col("leaf") - 1).alias("leaf"), F.col("head").alias("right"))
    joins = leaves.where("tail is not null").select("k", "piece", "leaf", "kind", F.col("tail").alias("left")).join(right, ["k", "piece", "leaf"]).mapInPandas(_join(path), f"k string, piece long, leaf long, kind int, {SAID}, drop_left int, drop_right int")
    none = F.lit(None).cast("int")
    rows = leaves.drop("head", "tail").withColumns({"drop_left": none, "drop_right": none}).unionByName(joins)
    whole = rows.groupBy("k").applyInPandas(_assemble(path), "k string, " + ", ".join(f"{c} {FIELDS[c]}" for c in FIELDS))
    joined = far.join(whole.select(F.col("k").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in outputs]), key).select(
        *[F.col(f"`{f.name}`") for f in carried], *[F.col(f"{key}_{c}").alias(c) for c in outputs]
    )
    return short.unionByName(joined)


#: Kinds of leaf rows: of ordinary text, a special token, of a long unit; and of their joins.
TEXT, SPECIAL, UNIT, JOIN = 0, 1, 2, 10
#: Ids and tokens joined by spaces, and their number.
SAID = "ids string, decoded string, n_tokens long"


def even_cuts(text: str, size: int) -> list[str]:
    """Parts of size characters; a rest of under half a part stays with the last one."""
    n = max(1, (len(text) + size // 2) // size)
    return [text[i * size : (i + 1) * size if i < n - 1 else len(text)] for i in range(n)]


def _cut(path: str, leaf: int, text_leaf: int) -> Callable:
    """Pieces of a text: runs of ordinary chunks, cut anywhere; special tokens as ids; long units."""
    columns = ["k", "piece", "leaf", "kind", "last", "s"]
    longer = regex.compile(rf"[^\x20\x09-\x0D]{{{max(1, leaf // 4)},}}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)

        def pieces(text: str) -> Iterator[tuple[int, list[str]]]:
            at = 0
            for m in longer.finditer(text):
                if calm := " ".join(SPACES.split(text[at : m.start()])).strip(" "):
                    yield TEXT, even_cuts(calm, text_leaf)
                for unit in own.split(m[0]):
                    yield (SPECIAL, [str(unit)]) if isinstance(unit, int) else (UNIT, even_cuts(unit, leaf))
                at = m.end()
            if calm := " ".join(SPACES.split(text[at:])).strip(" "):
                yield TEXT, even_cuts(calm, text_leaf)

        for frame in frames:
            for k, text in zip(frame["k"], frame["t"], strict=True):
                rows, piece = [], -1
                for piece, (kind, parts) in enumerate(pieces(text)):
                    rows += [(k, piece, i, kind, i == len(parts) - 1, s) for i, s in enumerate(parts)]
                    if len(rows) >= 1024:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                # a text without tokens still has a row
                rows.append((k, piece + 1, 0, TEXT, True, ""))
                yield pd.DataFrame(rows, columns=columns)

    return run


def _leaf(path: str) -> Callable:
    """A leaf of text gives what lies between its ends and the ends' text; one of a unit all its tokens, and its ends' ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)

        def told(leaf: int, kind: int, last: bool, s: str) -> tuple:
            if kind != TEXT:
                ids = [int(s)] if kind == SPECIAL else own.encode_part(s, last)
                most = min(TOKEN_ENDS, len(ids) // 2)
                ends = [" ".join(map(str, ids[low:high])) if kind == UNIT else None for low, high in ((0, most), (len(ids) - most, len(ids)))]
                return " ".join(map(str, ids)), own.decode(ids), len(ids), ends[0], None if last else ends[1]
            chunks = s.split(" ")
            # ends must not meet, or two joins would change the same chunks
            most = min(CHUNK_ENDS, len(chunks) // 2)
            low, high = most if leaf else 0, len(chunks) if last else len(chunks) - most
            return *own.text(" ".join(chunks[low:high])), " ".join(chunks[:most]), None if last else " ".join(chunks[len(chunks) - most :])

        for frame in frames:
            rows = [told(*x) for x in zip(frame["leaf"], frame["kind"], frame["last"], frame["s"], strict=True)]
            frame = frame.drop(columns=["s", "last"])
            for i, c in enumerate(("ids", "decoded", "n_tokens", "head", "tail")):
                frame[c] = [r[i] for r in rows]
            yield frame

    return run


def _join(path: str) -> Callable:
    """What stands at each cut. For text that is what lies between the leaves' middles. For a unit it is what replaces so
    many tokens at the end of the left leaf and the start of the right one; null where the ends did not agree."""

    def of_unit(own: Codec, left: list[int], right: list[int]) -> tuple:
        k = WINDOW
        while left and right:
            i, j = max(0, len(left) - k), min(len(right), k)
            mid = own.encode_part(own.surface(left[i:]) + own.surface(right[:j]), False)
            if mid[0] == left[i] and mid[-1] == right[j - 1]:
                return " ".join(map(str, mid)), None, len(mid), len(left) - i, j
            if i == 0 and j == len(right):
                break
            k *= 2
        return (None,) * 5

    def of_text(own: Codec, left: str, right: str) -> tuple:
        a, b, k = left.split(" "), right.split(" "), 1
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            window = (" ".join(a[i:]) + " ".join(b[:j])).split(" ")
            # outermost chunks that the cut did not touch stand as they stood
            if len(window) > 1 and window[0] == a[i] and window[-1] == b[j - 1]:
                return *own.text(" ".join([*a[:i], *window, *b[j:]])), None, None
            if i == 0 and j == len(b):
                raise ValueError("a leaf of ordinary text has too few chunks to join")
            k *= 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        numbers = lambda s: [int(x) for x in s.split(" ")] if s else []
        for frame in frames:
            rows = [of_text(own, a, b) if kind == TEXT else of_unit(own, numbers(a), numbers(b)) for kind, a, b in zip(frame["kind"], frame["left"], frame["right"], strict=True)]
            out = frame[["k", "piece", "leaf"]].assign(kind=frame["kind"] + JOIN)
            for i, c in enumerate(("ids", "decoded")):
                out[c] = [r[i] for r in rows]
            for i, c in enumerate(("n_tokens", "drop_left", "drop_right")):
                out[c] = pd.array([r[i + 2] for r in rows], dtype="Int64")
            yield out

    return run


def _assemble(path: str) -> Callable:
    """A text's tokens from its leaves and joins. Only here the whole row stands, as it will in the result."""

    def of_unit(own: Codec, piece: pd.DataFrame) -> tuple:
        cuts, leaves = piece[piece["kind"] != UNIT], piece[piece["kind"] == UNIT]
        parts = [[int(t) for t in x.split(" ")] for x in leaves["ids"]]
        if cuts["drop_left"].isna().any():
            # ends that did not agree: wider windows, over the whole leaves
            out = join_tree(parts, own.surface, own.encode_part)
        else:
            for at, left, right, mid in zip(cuts["leaf"], cuts["drop_left"], cuts["drop_right"], cuts["ids"], strict=True):
                del parts[at][len(parts[at]) - int(left) :]
                parts[at + 1] = [*map(int, mid.split(" ")), *parts[at + 1][int(right) :]]
            out = [t for p in parts for t in p]
        return " ".join(map(str, out)), own.decode(out), len(out)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own, found = codec(path), []
        # a leaf of text comes before the join behind it
        frame = frame.sort_values(["piece", "leaf", "kind"])
        long_units = set(frame.loc[frame["kind"] == UNIT, "piece"])
        done = set()
        for piece, ids, decoded, n in zip(frame["piece"], frame["ids"], frame["decoded"], frame["n_tokens"], strict=True):
            if piece not in long_units:
                found.append((ids, decoded, n))
            elif piece not in done:
                done.add(piece)
                found.append(of_unit(own, frame[frame["piece"] == piece]))
        found = [x for x in found if x[2]]
        row = row_of(" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), int(sum(x[2] for x in found)))
        return pd.DataFrame([(frame["k"].iloc[0], *row)], columns=["k", *FIELDS])

    return run


def decode(rows: DataFrame, path: str, ids_col: str = "ids", output: str = "decoded") -> DataFrame:
    """rows with the text that the ids (decimal, joined by spaces) decode to; null ids decode to the empty text."""
    small_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = codec(path)
        return ids.map(lambda x: own.decode([int(i) for i in x.split(" ")]) if x else "")

    return rows.withColumn(output, text(F.col(ids_col)))
