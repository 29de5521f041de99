"""Removal of repeated byte strings by a sparse suffix array with deep-shallow sorting.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Anchors are chosen by content, the
least of the hashes of GRAM bytes in each window, so every string of `length` bytes holds one and equal strings hold
the same. Only anchors whose hash is found twice can matter. For the anchors of one hash the suffixes to their right
(and the reversed prefixes to their left) are ordered by multikey quicksort down to a shallow depth; groups that still
agree go to blind tries. Neighbours in these orders have the longest common extensions: merging from the deepest common
suffix up, each anchor meets the best partner for every depth, and the farthest reach of the partners whose left and
right extensions make up `length` bytes is what goes around it.

A window belongs to the anchor that is its least, so an anchor only needs the bytes of its own windows around it.

A hash with very many anchors is not ordered by one task. Its windows are dealt into ranges of STEP starts, and anchors
into groups that agree on what all windows of a range share. Anchors that agree on all bytes of the range are one class,
counted by a shuffle; a class of two goes as a whole. Of the others one stands for its class: groups with few classes
are ordered as above. In a group with very many the range is cut into its single windows: each is a class of its own
then, fully sorted, and goes if two classes hold it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.shared import BATCH_ROWS, batch_rows, fresh, small_batches, spread, stored

LENGTH = 400
#: Bytes that an anchor's hash covers.
GRAM = 32
#: Depth in bytes where multikey quicksort hands over to blind tries.
SHALLOW = 48
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 19
#: Anchors that one task orders together; larger groups are dealt into narrower ones.
GROUP_LIMIT = 1024
#: Window starts of a range when a hash has too many anchors.
STEP = 64


# ---- anchors -----------------------------------------------------------------------------------------------------


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    w = b.astype(np.uint64)
    for n in (1, 2, 4):
        w = (w[:-n] << np.uint64(8 * n)) | w[n:]
    n = len(b) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(b: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Places and hashes of the anchors: in each window of `length` bytes the last of the least hashes; and how far before
    its anchor a window starts that belongs to it, at least and at most."""
    if len(b) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, span = [], length - GRAM + 1
    for start in range(0, len(b) - length + 1, PIECE):
        part = np.frombuffer(b, np.uint8, min(PIECE + length - 1, len(b) - start), start)
        h = gram_hashes(part)
        # the low bits tell the place, so that the last of equal hashes is the least
        key = (h & ~np.uint64(0xFFFFF)) | (np.uint64(0xFFFFF) - np.arange(len(h), dtype=np.uint64))
        n = len(key) - span + 1
        padded = np.full(-(-len(key) // span) * span, np.iinfo(np.uint64).max)
        padded[: len(key)] = key
        rows = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        place = (np.uint64(0xFFFFF) - (least & np.uint64(0xFFFFF))).astype(np.int64)
        # windows of one anchor stand side by side
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at = place[first]
        found.append((at + start, h[at], at - np.append(first[1:], n) + 1, at - first))
    at, h, low, high = map(np.concatenate, zip(*found))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # an anchor may go on in the next piece
    return at[first], h[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


# ---- deep-shallow sorting ----------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """A trie of branching depths and branching bytes only; strings are compared once for each insertion."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, ("leaf", [first])

    def insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while node[0] != "leaf":  # blindly down; any leaf below serves
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        other = self.strings[node[1][0]]
        shared = common(s, other)
        if shared == len(s) == len(other):
            node[1].append(i)
            return
        key = lambda x: x[shared] if shared < len(x) else -1
        above, branch, node = None, None, self.root
        while node[0] != "leaf" and node[0] < shared:
            above, branch = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][branch]
        if node[0] == shared:
            node[1][key(s)] = ("leaf", [i])
            return
        made = (shared, {key(other): node, key(s): ("leaf", [i])})
        if above is None:
            self.root = made
        else:
            above[1][branch] = made

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] == "leaf":
                out += node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Places of the strings in lexicographic order; equal strings in the order given.

    Multikey quicksort on eight bytes at a time, three-way, then blind tries for groups that agree to the shallow depth.
    """
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(strings, group[0])
            for i in group[1:]:
                trie.insert(i)
            out += trie.ordered()
        else:
            keys = {i: strings[i][depth : depth + 8] for i in group}
            pivot = keys[group[len(group) // 2]]
            less, same, more = [i for i in group if keys[i] < pivot], [i for i in group if keys[i] == pivot], [i for i in group if keys[i] > pivot]
            if more:
                stack.append((more, depth))
            if len(pivot) < 8 and same:  # all of them end here
                stack += [([i], depth) for i in reversed(same)]
            elif same:
                stack.append((same, depth + 8))
            if less:
                stack.append((less, depth))
    return out


# ---- reaches -----------------------------------------------------------------------------------------------------


def reaches(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """For each anchor of a group how far to its left and right bytes go; (0, 0) if none do.

    lefts: the reversed bytes before each anchor; rights: the bytes from it on.
    """
    m = len(lefts)
    far = [[0, 0] for _ in range(m)]

    def meet(x: int, y: int, r: int) -> None:
        left = common(lefts[x], lefts[y])
        if left + r >= length:
            for i in (x, y):
                far[i][0], far[i][1] = max(far[i][0], left), max(far[i][1], r)

    if m == 2:
        meet(0, 1, common(rights[0], rights[1]))
        return [tuple(f) for f in far]
    by_right, by_left = deep_shallow(rights), deep_shallow(lefts)
    rank = [0] * m
    for k, i in enumerate(by_left):
        rank[i] = k
    deep = [common(rights[a], rights[b]) for a, b in zip(by_right, by_right[1:])]
    sets = {k: [rank[i]] for k, i in enumerate(by_right)}
    home = list(range(m))

    def find(k: int) -> int:
        while home[k] != k:
            home[k] = home[home[k]]
            k = home[k]
        return k

    for k in sorted(range(m - 1), key=lambda k: -deep[k]):
        a, b, r = find(k), find(k + 1), deep[k]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big, small = sets[a], sets.pop(b)
        home[b] = a
        if len(small) * 8 > len(big):  # both alike: merge them, then meet where they touch
            mine = set(small)
            big = sorted(big + small)
            for x, y in zip(big, big[1:]):
                if (x in mine) != (y in mine):
                    meet(by_left[x], by_left[y], r)
        else:
            for z in small:
                p = bisect_left(big, z)
                if p:
                    meet(by_left[z], by_left[big[p - 1]], r)
                if p < len(big):
                    meet(by_left[z], by_left[big[p]], r)
                big.insert(p, z)
        sets[a] = big
    return [tuple(f) for f in far]


# ---- the corpus --------------------------------------------------------------------------------------------------


def _places(length: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, text in zip(frame["k"], frame["text"], strict=True):
                at, h, low, high = anchors((text or "").encode(), length)
                for i in range(0, len(at), 1 << 16):
                    j = i + (1 << 16)
                    yield pd.DataFrame({"k": k, "at": at[i:j], "h": h[i:j].view(np.int64), "low": low[i:j].astype(np.int32), "high": high[i:j].astype(np.int32)})

    return _batched(run)


def _batched(run: Callable, rows: int = 1 << 14) -> Callable:
    """Joins small frames."""

    def outer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in run(frames):
            held.append(frame)
            n += len(frame)
            if n >= rows:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    return outer


def _contexts(length: int) -> Callable:
    """Bytes of the windows of each anchor. In one text, anchors with the same surroundings are each other's partners: all
    but the first are told as pairs of a left and right reach straight away."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, text, places, hashes, lows, highs in zip(*(frame[c] for c in ("k", "text", "places", "hashes", "lows", "highs")), strict=True):
                b, met, rows = text.encode(), {}, []
                for at, h, low, high in zip(places, hashes, lows, highs, strict=True):
                    around = (high, b[at - high : at - low + length])
                    if around in met:
                        rows += [(k, p, 0, None, high, length - low) for p in (at, met[around])]
                    else:
                        met[around] = at
                        rows.append((k, at, h, around[1], high, 0))
                    if len(rows) >= 2048:
                        yield pd.DataFrame(rows, columns=["k", "at", "h", "around", "back", "ahead"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["k", "at", "h", "around", "back", "ahead"])

    return _batched(run, 4096)


def _removed(length: int) -> Callable:
    """Spans that go around the anchors of each hash. Rows come sorted by hash."""

    def spans(rows: list[tuple]) -> list[tuple]:
        rows = list({r[:2]: r for r in rows}.values())
        if len(rows) < 2:
            return []
        found = reaches([r[2][: r[3]][::-1] for r in rows], [r[2][r[3] :] for r in rows], length)
        return [(k, at - left, at + right) for (k, at, _, _), (left, right) in zip(rows, found, strict=True) if right]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of, out = [], None, []
        for frame in frames:
            for k, at, h, around, back in zip(frame["k"], frame["at"], frame["h"], frame["around"], frame["back"], strict=True):
                if h != of:
                    out += spans(held)
                    held, of = [], h
                    if len(out) >= 4096:
                        yield pd.DataFrame(out, columns=["k", "low", "high"])
                        out = []
                held.append((k, at, bytes(around), back))
        out += spans(held)
        yield pd.DataFrame(out, columns=["k", "low", "high"])

    return run


def _ranges(length: int, step: int) -> Callable:
    """A row for each range of windows of an anchor: the hashes of its group (what all windows of the range share) and
    class (the bytes of those windows that are the anchor's), and from where to where they start before it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, at, around, back in zip(frame["k"], frame["at"], frame["around"], frame["back"], strict=True):
                least = back + length - len(around)
                for p in range(least // step, back // step + 1):
                    low, high, name = max(least, p * step), min(back, p * step + step - 1), p.to_bytes(4, "big")
                    shared = around[back - p * step : back + max(GRAM, length - p * step - step + 1)]
                    own = around[back - high : back + length - low]
                    group = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=name).digest(), "big", signed=True)
                    rows.append((group, hashlib.blake2b(own, digest_size=16, salt=name + low.to_bytes(4, "big") + high.to_bytes(4, "big")).digest(), k, at, low, high))
            yield pd.DataFrame(rows, columns=["g", "c", "k", "at", "low", "high"])

    return _batched(run)


def _of_classes(length: int, windows: bool) -> Callable:
    """Rows of those anchors that stand for their classes: the bytes of the class, or each of its windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for around, back, classes in zip(frame["around"], frame["back"], frame["classes"], strict=True):
                for x in classes:
                    g, c, low, high = x["g"], bytes(x["c"]), x["low"], x["high"]
                    if windows:
                        rows += [(hashlib.blake2b(around[back - s : back - s + length], digest_size=16, salt=s.to_bytes(4, "big")).digest(), c, s) for s in range(low, high + 1)]
                    else:
                        rows.append((c, 0, g, around[back - high : back + length - low], high))
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=["w", "c", "s"] if windows else ["k", "at", "h", "around", "back"])
                    rows = []
            yield pd.DataFrame(rows, columns=["w", "c", "s"] if windows else ["k", "at", "h", "around", "back"])

    return run


def _keep(length: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text, spans in zip(frame["k"], frame["text"], frame["spans"], strict=True):
                b, runs = text.encode(), merged((s["low"], s["high"]) for s in spans)
                kept, at = [], 0
                for low, high in runs:
                    kept.append(b[at:low])
                    at = high
                kept.append(b[at:])
                left = b"".join(kept)
                rows.append((k, len(b) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left, [x for r in runs for x in r]))
            yield pd.DataFrame(rows, columns=["k", "n_removed", "n_spans", "kept_sha256", "kept", "runs"])

    return run


def merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def _ordered(rows: DataFrame, length: int, n_tasks: int) -> DataFrame:
    """k, low, high: what goes around the anchors, each hash h ordered by one task."""
    dealt = rows.select("k", "at", "h", "around", "back").repartition(n_tasks, "h").sortWithinPartitions("h")
    return dealt.mapInPandas(_removed(length), "k binary, low long, high long")


def _of_hot(rows: DataFrame, length: int, group_limit: int, n_tasks: int) -> DataFrame:
    """As _ordered(), of hashes with too many anchors for a task: by ranges of windows, and one anchor for each class."""
    hot = stored(rows.select("k", "at", "around", "back"), "hot-contexts")
    ranges = stored(hot.mapInPandas(_ranges(length, STEP), "g long, c binary, k binary, at long, low int, high int"), "hot-ranges")
    place = F.xxhash64("k", "at")
    classes = ranges.groupBy("g", "c").agg(F.min(F.struct("k", "at")).alias("r"), F.min(place).alias("one"), F.max(place).alias("other"), F.first("low").alias("low"), F.first("high").alias("high"))
    classes = stored(classes.select("g", "c", "r.*", "low", "high", (F.col("one") < F.col("other")).alias("twice")), "hot-classes")
    sizes = stored(classes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "hot-sizes")
    # an anchor stands for several classes; they go to its bytes as one row
    of = lambda some: hot.join(classes.join(some, "g").groupBy("k", "at").agg(F.collect_list(F.struct("g", "c", "low", "high")).alias("classes")), ["k", "at"])
    few = of(sizes.where(F.col("n") <= group_limit)).mapInPandas(_of_classes(length, False), "k binary, at long, h long, around binary, back int")
    reach = _ordered(few, length, n_tasks).select(F.col("k").alias("c"), (-F.col("low")).alias("left"), F.col("high").alias("right"))
    single = stored(of(sizes.where(F.col("n") > group_limit)).mapInPandas(_of_classes(length, True), "w binary, c binary, s int"), "hot-windows")
    again = single.groupBy("w").agg(F.min("c").alias("one"), F.max("c").alias("other")).where("one < other").select("w")
    whole = classes.where("twice").select("c", F.col("high").cast("long").alias("left"), (length - F.col("low")).cast("long").alias("right"))
    part = single.join(again, "w").select("c", F.col("s").cast("long").alias("left"), (length - F.col("s")).cast("long").alias("right"))
    # windows of a class overlap, so they are one reach
    reach = stored(reach.unionByName(whole).unionByName(part).groupBy("c").agg(F.max("left").alias("left"), F.max("right").alias("right")), "hot-reach")
    return ranges.join(reach, "c").select("k", (F.col("at") - F.col("left")).alias("low"), (F.col("at") + F.col("right")).alias("high"))


def repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, with_kept: bool = True, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """docs without the text, with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay)
    and runs (low, high, low, high ...: what goes, in bytes).

    Null texts count as empty. Equal texts of at least `length` bytes go whole; of those one goes on as a partner for
    others, so copies cost nothing more. Texts under `length` bytes stay. Columns that clash give way.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    small_batches(spark)
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "runs")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    key, size, digest, copied = fresh(docs, "text_key", "text_bytes", "text_sha256", "copied")
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # 16 bytes of the SHA-256 are key enough, and half as much to move
    keyed = docs.withColumn(text_col, text).withColumn(digest, F.sha2(text, 256)).withColumn(key, F.unhex(F.substring(digest, 1, 32))).withColumn(size, F.octet_length(text).cast("long"))
    long_ones = keyed.where(F.octet_length(text_col) >= length).select(F.col(key).alias("k"), F.col(text_col).alias("text"), F.col(id_col).alias("i"))
    copies = stored(long_ones.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first")), "copies")

    at = stored(spread(long_ones.select("k", "text")).mapInPandas(_places(length), "k binary, at long, h long, low int, high int"), "anchors")
    # a hash is repeated if it stands at two places; the places of copies are the same, so no distinct is needed
    place = F.xxhash64("k", "at")
    groups = stored(at.groupBy("h").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one < other").select("h"), "repeated")
    places = at.join(groups, "h").groupBy("k").agg(F.array_sort(F.collect_set(F.struct("at", "h", F.col("low"), F.col("high")))).alias("p"))
    # the id is a join key too, so a text with very many copies is dealt over many tasks
    first = places.join(copies.select("k", "first"), "k").select(F.col("k").alias("fk"), "first", "p")
    picked = long_ones.join(first, (F.col("k") == F.col("fk")) & F.col("i").eqNullSafe(F.col("first"))).select("k", "text", *[F.col(f"p.{c}").alias(n) for c, n in (("at", "places"), ("h", "hashes"), ("low", "lows"), ("high", "highs"))])
    # texts with repeated anchors, one of each copy; a row that repeats with its id stays twice here, and counts once below
    suspects = stored(picked, "suspects")
    around = stored(suspects.mapInPandas(_contexts(length), "k binary, at long, h long, around binary, back long, ahead long"), "contexts")
    told = around.where("around is null").select("k", (F.col("at") - F.col("back")).alias("low"), (F.col("at") + F.col("ahead")).alias("high"))
    open_ones = around.where("around is not null")
    # few hashes have so many anchors, so this table is small
    many = stored(open_ones.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("h"), "hot-hashes")
    with batch_rows(spark, 16 * BATCH_ROWS):
        found = stored(_ordered(open_ones.join(many, "h", "left_anti"), length, n_tasks), "spans")
        if not many.isEmpty():
            found = found.unionByName(_of_hot(open_ones.join(many, "h", "left_semi"), length, group_limit, n_tasks))
    spans = found.unionByName(told).groupBy("k").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    outputs = ("n_removed", "n_spans", "kept_sha256", *(("kept", "runs") if with_kept else ()))
    kinds = {"n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary", "runs": "array<long>"}
    done = suspects.select("k", "text").join(spans, "k").mapInPandas(_keep(length), "k binary, " + ", ".join(f"{c} {t}" for c, t in kinds.items())).select("k", *outputs).dropDuplicates(["k"])
    # copies go whole; what no span touched stays whole
    twice = copies.where("n > 1").select("k", F.lit(True).alias(copied))
    # a table of its own, so that Spark can split the rows of a text with very many copies
    known = stored(done.join(twice, "k", "full_outer"), "removed")
    n = F.col(size)
    empty = F.sha2(F.lit(""), 256)
    gone = F.coalesce(F.col(copied), F.lit(False))
    out = keyed.join(known.withColumnRenamed("k", key), key, "left")
    values = {
        "n_removed": F.when(gone, n).otherwise(F.coalesce("n_removed", F.lit(0))),
        "n_spans": F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"),
        "kept_sha256": F.when(gone, empty).otherwise(F.coalesce("kept_sha256", F.col(digest))),
    }
    if with_kept:
        values["kept"] = F.when(gone, F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.col(text_col).cast("binary")))
        values["runs"] = F.when(gone, F.array(F.lit(0).cast("long"), n)).otherwise(F.coalesce("runs", F.array().cast("array<long>")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], n.alias("n_bytes"), *[v.alias(c) for c, v in values.items()])
