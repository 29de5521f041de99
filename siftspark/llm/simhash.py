"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within `radius` bits agree on at least one of radius + 1 bit blocks, so each distinct fingerprint goes to
as many buckets, one for each block's value. In a bucket fingerprints are sorted by Gray rank. Runs of them become leaf
nodes, runs of nodes become upper nodes; a node keeps the bits that all below it share, less those its parent keeps.
A search adds up the differences to the nodes' bits on its way down and leaves whole groups as soon as the sum exceeds
the radius. A group whose free bits cannot exceed it is linked without a look inside.

Near copies by shingle similarity (`keep_similar`) take the same index over fingerprints of 128 bits, whose differing
bits follow the angle between shingle sets: at a Jaccard similarity s they are 128 acos(2s / (1 + s)) / pi on average.
That is far more bits than blocks can be cut for, so buckets are masks: twelve seeded permutations of the bits, each cut into
eight masks of 16. Pairs of at most 7 differing bits meet for certain, those of 20 with a chance of over 0.99, of 26 of 0.86.
The index only proposes: each bucket gives a forest, nearest pairs first, and links of it count if the shingle sets
themselves, compared exactly, are similar enough. What the index and its forests leave out follows exactly (`unproposed`):
sets of similarity s share a shingle among the first n - ceil(s n) + 1 of their n shingles in any one order, so texts that
do are paired if no link connects them yet, and their sets are compared too. Components are those of all pairs.

Large groups of texts that share most shingles, but too few to be linked, would meet in all their pairs that way. Where a
shingle's texts make too many pairs they are a family, told apart by how they differ from its centre c, the shingles that most of
them hold: sets x and y differ as x ^ c and y ^ c do. With s the similarity, r = (1 - s) / (1 + s) and the excess of x
|x ^ c| - r |x|, they are similar if and only if x ^ c and y ^ c share at least half the sum of their excesses. So all
of no excess together hang on the text of the least one, and others share an early one of their differences, rare ones
first. Plain sets are the differences from an empty centre, and a family in which too many meet again gets new centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import acos, ceil, pi, sqrt
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.shared import batch_rows, components, cut, fresh, passing, released, small_batches, spread, stored

RADIUS, SHINGLE, BITS = 4, 4, 64
#: Of near copies by shingle similarity: words of a shingle, similarity, bits, permutations of them, bits of a mask.
WORDS, SIMILARITY, WIDE, PERMUTATIONS, MASK = 5, 0.8, 128, 12, 16
#: Pairs up to three standard deviations over the mean at SIMILARITY are proposed; forests grow in so many steps of the radius.
SPREADS, STEPS = 3.0, 5
#: Of the exact pairs: bits of a set's parity code at most, every so many-th set (of so many in all) that is counted for the order,
#: shingles that the order puts last, and pairs that are made at a time. None of them bears on the result.
PARITY, SAMPLED, SAMPLE, FREQUENT, PAIRS = 1 << 15, 16, 1 << 15, 100_000, 1 << 20
#: Pairs a row over which the texts of one shingle are a family, members of a family that give its centre (about twice that at most),
#: how often families get centres before what is left is paired, family members that a join broadcasts, and edges between or within
#: families that the driver puts together (more are left to `components`). Nor do these.
CROWD, CENTRE, CENTRES, BROADCAST, GATHERED = 32, 256, 3, 1 << 16, 1 << 17
#: Bits that tell which texts a join may need: so many a node and at most in all (beyond, more texts go to the join than it needs).
SLOTS, MOST_SLOTS = 8, 1 << 24
#: Fan-out of the index, and queries that are searched at once.
FAN, QUERIES = 8, 1 << 14
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = 1 << 15


def _shingles(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text joined by spaces, and where its shingles begin and stop in that."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return b" ".join(words), starts[: len(stops)].tolist(), stops.tolist()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits (unsigned): bit set if it is set in over half the hashes of the text's word shingles."""
    whole, begins, stops = _shingles(text, shingle)
    n = len(begins)
    if not n:
        return 0
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, _STEP):
        h = np.array([digest(whole[a:b], 42) for a, b in zip(begins[i : i + _STEP], stops[i : i + _STEP], strict=True)], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _digests(text: str | None, shingle: int) -> np.ndarray:
    """128-bit hashes of the text's different word shingles, as rows of bytes."""
    whole, begins, stops = _shingles(text, shingle)
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join({digest(whole[a:b]) for a, b in zip(begins, stops, strict=True)}), np.uint8).reshape(-1, WIDE // 8)


def _majority(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(2, np.uint64)
    ones = sum(np.unpackbits(h[i : i + _STEP], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), _STEP))
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def wide_fingerprint(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """128 bits in two words: bit set if it is set in over half the hashes of the text's different word shingles."""
    return _majority(_digests(text, shingle))


def shingle_hashes(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """64-bit hashes of the text's different word shingles, ascending."""
    whole, begins, stops = _shingles(text, shingle)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(whole[a:b]) for a, b in zip(begins, stops, strict=True)), np.uint64, len(begins)))


def parity_code(hashes: np.ndarray) -> bytes:
    """Bit i is set if an odd number of the hashes end in i. Codes differ in at most as many bits as sets in members.

    As many bits as there are hashes, up to a power of two and at most PARITY; the halves of a code, combined, are the shorter one.
    """
    bits = min(PARITY, max(64, 1 << (len(hashes) - 1).bit_length())) if len(hashes) else 64
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def codes_apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Bits in which parity codes differ, the longer of two cut down to the shorter."""
    out, sizes = np.zeros(len(x), np.int64), np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    for both in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == both).all(axis=1))
        one, other = (np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1) for side in (x, y))
        while one.shape[1] != other.shape[1]:
            one, other = (one, other) if one.shape[1] > other.shape[1] else (other, one)
            half = one.shape[1] // 2
            one = one[:, :half] ^ one[:, half:]
        out[at] = np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)
    return out


def prefix(hashes: np.ndarray, late: np.ndarray, rank: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The hashes of a set (ascending) that every set of that similarity or more shares one with, among its own.

    The order is by rank, which is that of `late` (ascending) or 0, then by hash.
    """
    n = len(hashes)
    if n and len(late):
        at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
        hashes = hashes[np.argsort(np.where(late[at] == hashes, rank[at], 0), kind="stable")]
    return hashes[: n - ceil(similarity * n - 1e-6) + 1]


def radius_of(similarity: float, bits: int = WIDE, spreads: float = 0.0) -> int:
    """Bits in which texts of that Jaccard similarity differ on average, and so many standard deviations more, rounded up."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + spreads * sqrt(bits * p * (1 - p)))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places in Gray order: the number whose Gray code each is."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def gray_ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of codes of two words: Gray order runs backwards in the second one where the first has an odd number of bits."""
    odd = (np.bitwise_count(codes[:, 0]) & 1).astype(bool)
    second = gray_rank(codes[:, 1])
    return gray_rank(codes[:, 0]), np.where(odd, ~second, second)


def _count(codes: np.ndarray) -> np.ndarray:
    """Set bits of each code, of one word or a row of words."""
    bits = np.bitwise_count(codes)
    return bits if bits.ndim == 1 else reduce(add, bits.T)


def _under(child: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bitwise_and.reduceat(child, starts), np.bitwise_or.reduceat(child, starts)


class GrayIndex:
    """Over many buckets at once: bucket (ascending), codes sorted by Gray rank within each. Nodes never span buckets.

    A code is a number, or a row of numbers for more than 64 bits.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        self.codes = codes
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(codes) else np.zeros(0, np.int64)
        self.roots_of = np.cumsum(np.concatenate([[True], bucket[1:] != bucket[:-1]])) - 1 if len(codes) else np.zeros(0, np.int64)
        # levels from the codes up: starts of the children of each node, and which bits all below share
        self.levels: list[dict] = []
        groups, low, high = self.roots_of, codes, codes
        while True:
            within = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
            starts = np.flatnonzero(within % FAN == 0)
            (low, _), (_, high) = _under(low, starts), _under(high, starts)
            self.levels.append({"starts": starts, "stops": np.append(starts[1:], len(groups)), "pattern": low, "shared": ~(low ^ high)})
            groups = groups[starts]
            first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            if len(first) == len(groups):
                break
        # a node's own bits are those its parent does not have
        above = np.zeros((len(groups), *codes.shape[1:]), np.uint64)
        for level in reversed(self.levels):
            level["own"] = level["shared"] & ~above
            level["free"] = BITS * (codes.size // max(1, len(codes))) - _count(level["shared"]).astype(np.int64)
            above = np.repeat(level["shared"], level["stops"] - level["starts"], axis=0)
        self.leaf_own = ~above

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, code) of places within the radius; of a group that is all within it, its first code only."""
        for k in range(0, len(queries), QUERIES):
            q = queries[k : k + QUERIES]
            node, gone = self.roots_of[q], np.zeros(len(q), dtype=np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                level, code = self.levels[depth], self.codes[q]
                gone = gone + _count((code ^ level["pattern"][node]) & level["own"][node])
                near = gone <= radius
                q, node, gone = q[near], node[near], gone[near]
                sure = (gone + level["free"][node] <= radius) & (level["free"][node] <= radius)
                if sure.any():
                    at = node[sure]
                    for lower in range(depth, -1, -1):
                        at = self.levels[lower]["starts"][at]
                    yield q[sure], at
                    q, node, gone = q[~sure], node[~sure], gone[~sure]
                many = level["stops"][node] - level["starts"][node]
                base = np.repeat(level["starts"][node] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else many, many)
                q, gone = np.repeat(q, many), np.repeat(gone, many)
                node = base + np.arange(len(q))
            gone = gone + _count((self.codes[q] ^ self.codes[node]) & self.leaf_own[node])
            near = (gone <= radius) & (q != node)
            yield q[near], node[near]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Joins the sets of a and b; label[i] is a member of i's set, in the end its root. Gives the pairs that joined two sets."""
    made = []
    while len(a):
        ra, rb = label[a], label[b]
        while (label[ra] != ra).any():
            ra = label[ra]
        while (label[rb] != rb).any():
            rb = label[rb]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        np.minimum.at(label, high, low)
        won = np.flatnonzero(label[high] == low)
        won = won[np.unique(high[won], return_index=True)[1]]
        made.append((a[won], b[won]))
    return made


def bucket_links(bucket: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each code a code of its set: sets are what links within the radius in one bucket connect. Sorted input."""
    label = np.arange(len(codes))
    if len(codes) > 1:
        index = GrayIndex(bucket, codes)
        # every code asks, so all codes of a tight group are tied to its first
        alone = np.bincount(index.roots_of)[index.roots_of] > 1
        for a, b in index.links(np.flatnonzero(alone), radius):
            _merge(label, a, b)
        while (label[label] != label).any():
            label = label[label]
    return label


def bucket_forest(bucket: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within the radius in one bucket that connect all such pairs, at most one a code. Sorted input.

    The radius grows in steps, so that the forest holds near pairs before far ones.
    """
    made = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(codes) > 1:
        index, label = GrayIndex(bucket, codes), np.arange(len(codes))
        ask = np.flatnonzero(np.bincount(index.roots_of)[index.roots_of] > 1)
        for step in sorted({ceil(radius * k / STEPS) for k in range(1, STEPS + 1)}):
            for a, b in index.links(ask, step):
                made += _merge(label, a, b)
    return np.concatenate([a for a, _ in made]), np.concatenate([b for _, b in made])


def _edges(radius: int) -> Callable[[np.ndarray, np.ndarray], Iterator[pd.DataFrame]]:
    def edges(bucket: np.ndarray, codes: np.ndarray) -> Iterator[pd.DataFrame]:
        root = bucket_links(bucket, codes, radius)
        own = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"a": codes[own].view(np.int64), "b": codes[root[own]].view(np.int64)})

    return edges


def _wide_edges(radius: int) -> Callable[[np.ndarray, np.ndarray], Iterator[pd.DataFrame]]:
    def edges(bucket: np.ndarray, codes: np.ndarray) -> Iterator[pd.DataFrame]:
        same = bucket[1:] == bucket[:-1]
        shared = np.append(same, False) | np.append(False, same)
        bucket, codes = bucket[shared], codes[shared]
        order = np.lexsort((*gray_ranks(codes)[::-1], bucket))
        bucket, codes = bucket[order], codes[order]
        one, other = bucket_forest(bucket, codes, radius)
        a, b = codes[one].view(np.int64), codes[other].view(np.int64)
        yield pd.DataFrame({"a0": a[:, 0], "a1": a[:, 1], "b0": b[:, 0], "b1": b[:, 1]})

    return edges


def _ratio(similarity: float) -> float:
    """Of the sizes of two sets in sum, the part in which sets of that similarity differ."""
    return (1 - similarity) / (1 + similarity)


def _elsewhere(values: np.ndarray, new: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least value of each row's bucket outside its component (inf if none). new, other: where buckets and components begin."""
    groups = np.flatnonzero(other)
    least, firsts, at = np.minimum.reduceat(values, groups), np.flatnonzero(new[groups]), np.cumsum(new[groups]) - 1
    lowest = np.minimum.reduceat(least, firsts)[at]
    is_lowest = least == lowest
    alone = is_lowest & (np.add.reduceat(is_lowest.astype(np.int64), firsts)[at] == 1)
    second = np.minimum.reduceat(np.where(is_lowest, np.inf, least), firsts)[at]
    return np.repeat(np.where(alone, second, lowest), np.diff(np.append(groups, len(values))))


def _across(similarity: float, crowd: float | None = None) -> Callable[[np.ndarray, np.ndarray], Iterator[pd.DataFrame]]:
    """Pairs of nodes of one bucket whose components differ and whose sizes allow the similarity; some come repeatedly.

    Rows are (node, component, size) or also (apart, place): members of the node's difference from its centre and which of them
    the bucket is. Pairs that share too few from there on are left out. With crowd, pairs have a column crowded: where a
    bucket would make more than crowd pairs a row, its rows are tied to one of them instead (crowded is true).
    """

    def pairs(bucket: np.ndarray, codes: np.ndarray) -> Iterator[pd.DataFrame]:
        def framed(x: np.ndarray, y: np.ndarray, crowded: bool) -> pd.DataFrame:
            frame = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()
            return frame if crowd is None else frame.assign(crowded=crowded)

        codes = codes[order := np.lexsort((codes[:, 1], bucket))]
        bucket, codes = bucket[order], codes.view(np.int64)
        placed = codes.shape[1] > 3
        # sets share at most what is left of them from the place on, and half their excesses must be
        excess = codes[:, 3] - _ratio(similarity) * codes[:, 2] if placed else np.zeros(len(codes))
        most = 2 * (codes[:, 3] - codes[:, 4]) - excess + 1e-6 if placed else np.full(len(codes), np.inf)
        while True:
            new = np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]
            other = new | np.append(True, codes[1:, 1] != codes[:-1, 1])[: len(bucket)]
            if not len(bucket):
                return
            stay = (_elsewhere(excess, new, other) <= most) & (-_elsewhere(-most, new, other) >= excess) if placed else np.full(len(bucket), True)
            if stay.all():
                break
            bucket, codes, excess, most = bucket[stay], codes[stay], excess[stay], most[stay]
        # a row meets the rows of its bucket that come after its component
        stop, after = (np.append(np.flatnonzero(first)[1:], len(bucket))[np.cumsum(first) - 1] for first in (new, other))
        many = stop - after
        if crowd is not None:
            begin, at = np.flatnonzero(new), np.cumsum(new) - 1
            crowded = (np.add.reduceat(many, begin) > crowd * np.diff(np.append(begin, len(bucket))))[at]
            if crowded.any():
                least = np.minimum.reduceat(codes[:, 0], begin)[at]
                yield framed(least[crowded], codes[crowded, 0], True)
                many = np.where(crowded, 0, many)
        node, size = codes[:, 0], codes[:, 2]
        total, i = np.cumsum(many), 0
        while i < len(node):
            j = max(i + 1, int(np.searchsorted(total, total[i] - many[i] + PAIRS, side="right")))
            m = many[i:j]
            one = np.repeat(np.arange(i, j), m)
            two = np.arange(len(one)) + np.repeat(after[i:j] - (np.cumsum(m) - m), m)
            near = np.minimum(size[one], size[two]) >= similarity * np.maximum(size[one], size[two]) - 1e-6
            near &= (excess[one] <= most[two]) & (excess[two] <= most[one])
            x, y = node[one[near]], node[two[near]]
            if len(x):
                yield framed(x, y, False)
            i = j

    return pairs


def _sets(edges: Callable[[np.ndarray, np.ndarray], Iterator[pd.DataFrame]], words: tuple[str, ...] = ("fp",)) -> object:
    """Edges of one task's buckets, taken in runs of whole buckets. Rows come sorted by bucket (and Gray rank, if one word)."""

    def codes_of(frame: pd.DataFrame) -> np.ndarray:
        if len(words) == 1:
            return frame[words[0]].to_numpy().view(np.uint64)
        return np.stack([frame[w].to_numpy().view(np.uint64) for w in words], axis=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_b, held_c, n = [], [], 0
        for frame in frames:
            held_b.append(frame["bucket"].to_numpy())
            held_c.append(codes_of(frame))
            n += len(frame)
            if n >= 1 << 17:
                bucket, codes = np.concatenate(held_b), np.concatenate(held_c)
                stop = int(np.searchsorted(bucket, bucket[-1], side="left"))
                if stop:
                    yield from edges(bucket[:stop], codes[:stop])
                held_b, held_c, n = [bucket[stop:]], [codes[stop:]], 0
        if held_b:
            yield from edges(np.concatenate(held_b), np.concatenate(held_c))

    return run


def links(fingerprints: DataFrame, fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect just what pairs within the radius connect.

    Each bucket gives a forest, not all its pairs. Gray rank is taken in SQL, so Spark sorts.
    """
    spark = fingerprints.sparkSession
    blocks = radius + 1
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    offsets = [sum(widths[:i]) for i in range(blocks)]
    fp = F.col("fp")
    bucket = F.array(*[F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << w) - 1)) * blocks + i for i, (o, w) in enumerate(zip(offsets, widths, strict=True))])
    rows = fingerprints.select(F.col(fp_col).alias("fp")).distinct().select(F.explode(bucket).alias("bucket"), "fp")
    g = "fp"
    for i, s in enumerate((1, 2, 4, 8, 16, 32)):
        rows = rows.withColumn(f"g{i}", F.col(g).bitwiseXOR(F.shiftrightunsigned(F.col(g), s)))
        g = f"g{i}"
    # signed order of the rank with its top bit flipped is the unsigned order
    rows = rows.select("bucket", "fp", F.col(g).bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n_tasks, "bucket").sortWithinPartitions("bucket", "rank").select("bucket", "fp")
    with batch_rows(spark, 1 << 16):
        return stored(dealt.mapInPandas(_sets(_edges(radius)), "a long, b long"), "links")


def masks() -> np.ndarray:
    """Two words a mask: seeded permutations of the bits, each cut into masks."""
    rng, out = np.random.default_rng(7), []
    for _ in range(PERMUTATIONS):
        for block in rng.permutation(WIDE).reshape(-1, MASK):
            bits = np.zeros(WIDE, np.uint8)
            bits[block] = 1
            out.append(np.packbits(bits, bitorder="little").view(np.int64))
    return np.array(out)


def similar_links(fingerprints: DataFrame, fp_col: str = "fp", radius: int | None = None) -> DataFrame:
    """Edges (a < b) between `node_of` distinct wide fingerprints that pairs within the radius in a bucket connect.

    A bucket is a mask and what a fingerprint has under it, hashed; each gives a forest, not all its pairs.
    """
    spark, radius = fingerprints.sparkSession, radius_of(SIMILARITY, spreads=SPREADS) if radius is None else radius
    under = [F.xxhash64(F.col("w0").bitwiseAND(F.lit(int(m0))), F.col("w1").bitwiseAND(F.lit(int(m1))), F.lit(i)) for i, (m0, m1) in enumerate(masks())]
    rows = fingerprints.select(F.col(fp_col)["w0"].alias("w0"), F.col(fp_col)["w1"].alias("w1")).distinct()
    rows = rows.select(F.explode(F.array(*under)).alias("bucket"), "w0", "w1")
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
    with batch_rows(spark, 1 << 16):
        pairs = stored(dealt.mapInPandas(_sets(_wide_edges(radius), ("w0", "w1")), "a0 long, a1 long, b0 long, b1 long"), "similar-links")
    a, b = F.xxhash64("a0", "a1"), F.xxhash64("b0", "b1")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows whose node is one of nodes, and some others: those of a node that shares its low bits with one (an eighth at most).

    A join of texts by node moves all of them; few bits for each node tell most of the others before. nodes should be cut.
    """
    slots = min(MOST_SLOTS, max(64, 1 << (SLOTS * nodes.count() - 1).bit_length()))
    low = lambda: F.col("node").bitwiseAND(F.lit(slots - 1))
    word, bit = F.shiftright(low(), 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))")
    words = nodes.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("word", F.shiftright(low(), 6)).join(F.broadcast(words), "word")
    return found.where(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def verified(edges: DataFrame, rows: DataFrame, id_col: str, text_col: str, node_col: str, similarity: float = SIMILARITY, shingle: int = WORDS, names: DataFrame | None = None) -> DataFrame:
    """Those edges (a, b) whose texts' sets of shingles have that Jaccard similarity, exactly (shingles by 64-bit hash).

    A node's text is that of its least row (null ids last). Only texts of nodes with edges are read into sets.
    With names (key, node) edges are between keys, and those returned between their nodes.
    """

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: shingle_hashes(text, shingle).view(np.int64))

    small_batches(rows.sparkSession)
    keys = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    keys = keys.withColumn("node", F.col("key")) if names is None else cut(keys.join(names, "key"))
    nodes = cut(keys.select("node").distinct())
    least = F.min_by(F.coalesce("text", F.lit("")), F.struct(F.col("id").isNull(), F.col("id"), F.xxhash64("text")))
    own = rows.select(F.col(node_col).alias("node"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # no semi-join: the optimizer would push it under _among
    texts = _among(own, nodes).join(nodes, "node").groupBy("node").agg(least.alias("text"))
    sets = stored(texts.select("node", hashes("text").alias("shingles")), "shingles")
    keyed = sets if names is None else sets.join(keys, "node")
    ends = [keyed.select(F.col("node" if names is None else "key").alias(k), F.col("node").alias(f"{k}_node"), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y"))]
    pairs = edges.join(ends[0], "a").join(ends[1], "b")
    both, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return cut(pairs.where(both >= similarity * (total - both) - 1e-9).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many sets hold, ascending, and in how many of a sample of the sets. texts: node, text."""

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"hash": np.concatenate([np.zeros(0, np.uint64), *(shingle_hashes(t, shingle) for t in frame["text"])]).view(np.int64)})

    every = max(SAMPLED, texts.count() // SAMPLE)
    some = texts.where(F.pmod("node", F.lit(every)) == 0).dropDuplicates(["node"]).select("text")
    found = some.mapInPandas(hashes, "hash long").groupBy("hash").count().where("count > 1").orderBy(F.desc("count"), "hash").limit(FREQUENT).collect()
    late, rank = np.array([r["hash"] for r in found], np.int64).view(np.uint64), np.array([r["count"] for r in found], np.int64)
    order = np.argsort(late)
    return late[order], rank[order]


def _meeting(dealt: DataFrame, n_tasks: int) -> DataFrame:
    """Rows (bucket, node, ...) of buckets of two nodes or more, each once."""
    same = Window.partitionBy("bucket")
    dealt = dealt.repartition(n_tasks, "bucket").withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same))
    return stored(dealt.where("low < high").drop("low", "high").distinct(), "shared-shingles")


def difference(hashes: np.ndarray, seen: np.ndarray, count: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set (ascending) and its family's centre do not share, what is rare in the family first, and in how many members it is so.

    Of `many` members that were looked at, `count` hold each hash of `seen` (ascending, all that two hold); the centre is what
    over half of them hold.
    """
    centre = 2 * count > many
    apart = np.setxor1d(hashes, seen[centre], assume_unique=True)
    known = np.zeros(len(apart), np.int64)
    if len(seen):
        at = np.minimum(np.searchsorted(seen, apart), len(seen) - 1)
        known = np.where(seen[at] == apart, np.where(centre, many - count, count)[at], 0)
    order = np.argsort(known, kind="stable")
    return apart[order], known[order]


def _gathered(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """As components(edges); few edges are put together on the driver."""
    edges = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct())
    if edges.count() > GATHERED:
        return components(edges)
    ends = np.array([tuple(r) for r in edges.collect()], np.int64).reshape(-1, 2)
    nodes, places = np.unique(ends, return_inverse=True)
    label, places = np.arange(len(nodes)), places.reshape(-1, 2)
    _merge(label, places[:, 0], places[:, 1])
    while (label[label] != label).any():
        label = label[label]
    return edges.sparkSession.createDataFrame(list(zip(nodes.tolist(), nodes[label].tolist(), strict=True)), "node long, component long")


def _from_centres(texts: DataFrame, families: DataFrame, n_tasks: int, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, node, apart, place) of families' early differences, and pairs (a, b) that are similar by their excess.

    families: node, component. texts: node, text.
    """

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: shingle_hashes(text, shingle).view(np.int64))

    def counts(members: pd.DataFrame) -> pd.DataFrame:
        seen, count = np.unique(np.concatenate([np.asarray(h, np.int64) for h in members["shingles"]]).view(np.uint64), return_counts=True)
        seen, count = seen[count > 1], count[count > 1]
        return pd.DataFrame([(members["family"].iloc[0], len(members), seen.view(np.int64), count)], columns=["family", "many", "seen", "count"])

    def differences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, family, every, own, many, seen, count in frame.itertuples(index=False):
                seen, count = (np.array([] if x is None else x, np.int64) for x in (seen, count))
                apart, known = difference(np.asarray(own, np.int64).view(np.uint64), seen.view(np.uint64), count, 0 if many is None or many != many else int(many))
                # where all members were looked at, what one of them only has meets nothing
                place = np.flatnonzero(known > 1) if every == 1 else np.arange(len(apart))
                out.append((node, family, len(own), len(apart), place, apart[place].view(np.int64)))
            yield pd.DataFrame(out, columns=["node", "family", "size", "apart", "place", "hash"])

    families = cut(families.withColumnRenamed("component", "family"))
    sizes = families.groupBy("family").agg(F.expr(f"greatest(1, count(*) div {CENTRE})").alias("every"))
    known = families.join(sizes, "family")
    if families.count() <= BROADCAST:
        known = F.broadcast(known)
    else:
        texts = _among(texts, families)
    sets = stored(texts.join(known, "node").dropDuplicates(["node"]).select("node", "family", "every", hashes("text").alias("shingles")), "families")
    counted = sets.where(F.pmod(F.xxhash64("node"), "every") == 0).select("family", "shingles")
    centres = counted.groupBy("family").applyInPandas(counts, "family long, many long, seen array<long>, count array<long>")
    placed = sets.join(centres, "family", "left").select("node", "family", "every", "shingles", "many", "seen", "count")
    placed = stored(placed.mapInPandas(differences, "node long, family long, size long, apart long, place array<long>, hash array<long>"), "differences")
    ratio = _ratio(similarity)
    placed = placed.withColumn("excess", F.col("apart") - ratio * F.col("size"))
    hubs = placed.groupBy("family").agg(F.min(F.struct("excess", "node")).alias("hub"))
    placed = placed.join(hubs.select("family", F.col("hub.excess").alias("least"), F.col("hub.node").alias("hub")), "family")
    # half the excesses must be shared: those on the hub meet others only, and no set that is similar is much nearer to the centre
    tied = F.col("excess") + F.col("least") <= 1e-9
    other = F.greatest(F.when(tied, -F.col("least")).otherwise(F.col("least")), F.col("excess") - 2 * ratio / similarity * F.col("size"))
    early = F.filter(F.arrays_zip("place", "hash"), lambda d: d["place"] <= F.col("apart") - (F.col("excess") + other) / 2 + 1e-6)
    rows = placed.select("node", "family", "apart", F.inline(early)).select(F.xxhash64("family", "hash").alias("bucket"), "node", "apart", "place")
    stars = cut(placed.where(tied & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    return _meeting(rows, n_tasks), stars


def _joined(about: DataFrame, edges: DataFrame) -> DataFrame:
    """about (node, component, size) with the components that the edges join made one."""
    for end in ("a", "b"):
        edges = edges.join(about.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end)
    one = _gathered(edges, "of_a", "of_b").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return cut(about.join(one, "component", "left").select("node", F.coalesce("whole", "component").alias("component"), "size"))


def unproposed(rows: DataFrame, edges: DataFrame, text_col: str = "text", fp_col: str = "fp", similarity: float = SIMILARITY, shingle: int = WORDS) -> DataFrame:
    """Pairs (a, b) of nodes that, with `edges`, connect all that pairs of that similarity connect; others are among them.

    Sets share a hash of their prefixes, whatever the order of hashes is; frequent ones (of a sample) come last, so that few
    sets meet. Where many do, they are told apart by their differences from the centre of a family, which holds all of them. Pairs
    whose parity codes differ in more bits than the sets may in members are left out.
    """
    spark = rows.sparkSession
    small_batches(spark)
    fp = F.col(fp_col)
    texts = rows.select(fp["node"].alias("node"), F.col(text_col).alias("text")).where(fp["size"] > 0)
    late, rank = _frequent(texts, shingle)
    released(spark)

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            frame = frame.drop_duplicates("node")
            frame = frame[~frame["node"].isin(seen)]
            seen.update(frame["node"].tolist())
            hashes = [prefix(shingle_hashes(t, shingle), late, rank, similarity) for t in frame["text"]]
            if hashes:
                many = [len(h) for h in hashes]
                yield pd.DataFrame({"bucket": np.concatenate(hashes).view(np.int64), "node": np.repeat(frame["node"].to_numpy(), many), "place": np.concatenate([np.arange(m) for m in many])})

    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    about = rows.select(fp["node"].alias("node"), fp["size"].cast("long").alias("size")).dropDuplicates(["node"])
    about = cut(about.join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "size"))
    shared = _meeting(texts.mapInPandas(prefixes, "bucket long, node long, place long"), n_tasks)
    released(spark)
    found, words = [], ("node", "component", "size", "apart", "place")
    for left in range(CENTRES, -1, -1):
        placed = shared.join(about, "node")
        placed = placed if "apart" in shared.columns else placed.withColumn("apart", F.col("size"))
        placed = placed.select("bucket", *words).repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
        with batch_rows(spark, 1 << 16):
            met = stored(placed.mapInPandas(_sets(_across(similarity, CROWD if left else float("inf")), words), "a long, b long, crowded boolean"), "prefix-pairs")
        found.append(met.where("not crowded").select("a", "b"))
        crowded = met.where("crowded").select("a", "b")
        if crowded.isEmpty():
            break
        shared, stars = _from_centres(texts, _gathered(crowded), n_tasks, similarity, shingle)
        found.append(stars)
        about = _joined(about, stars)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    codes = rows.select(fp["node"].alias("node"), fp["size"].alias("size"), fp["parity"].alias("code")).dropDuplicates(["node"])

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, y: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(codes_apart(x.tolist(), y.tolist()) <= total.to_numpy() * _ratio(similarity) + 1e-6)

    met = pairs.join(codes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("code").alias("x")), "a")
    met = met.join(codes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("code").alias("y")), "b")
    return cut(met.where(possible("x", "y", F.col("m") + F.col("n"))).select("a", "b"))


def node_of(fp_col: str) -> F.Column:
    """A wide fingerprint as one number, for joins; two share one by a chance of 2^-64."""
    return F.xxhash64(F.col(fp_col)["w0"], F.col(fp_col)["w1"])


def with_fingerprints(docs: DataFrame, text_col: str = "text", fp_col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with fp (long: the 64 bits, signed); a column so called gives way. Null and empty texts have 0."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return spread(docs).withColumn(fp_col, fp(F.col(text_col)))


def with_wide_fingerprints(docs: DataFrame, text_col: str = "text", fp_col: str = "fp", shingle: int = WORDS) -> DataFrame:
    """docs with fp; a column so called gives way. Null and empty texts have zeros.

    fp is a struct: w0 and w1 (long, the bits), and of the set of different shingles node (long: its hash), size (int) and
    parity (its `parity_code`).
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("w0 long, w1 long, node long, size int, parity binary")
    def fp(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            h = _digests(text, shingle)
            w0, w1 = _majority(h).view(np.int64).tolist()
            words = np.sort(h.view(np.uint64)[:, 0])
            out.append((w0, w1, np.uint64(xxhash.xxh3_64_intdigest(words.tobytes())).astype(np.int64), len(words), parity_code(words)))
        return pd.DataFrame(out, columns=["w0", "w1", "node", "size", "parity"])

    return spread(docs).withColumn(fp_col, fp(F.col(text_col)))


def _named(rows: DataFrame, id_col: str, fp_col: str, edges: DataFrame) -> DataFrame:
    """node (a distinct fingerprint), least (its least id), component (the least fingerprint reachable)."""
    distinct = rows.groupBy(F.col(fp_col).alias("node")).agg(F.min(id_col).alias("least"))
    tied = components(edges)
    return distinct.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))


def classes(rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """rows (with fingerprints) with component_id: the least id reachable over links, the row's own among them.

    Null ids count for nobody's component; a component of null ids only has null. rows should be stored, not computed:
    they are read three times. A column of rows called component_id gives way.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() == "component_id"])
    (node,) = fresh(rows, "node")
    named = _named(rows, id_col, fp_col, links(rows, fp_col, radius))
    firsts = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut(named.join(firsts, "component").select(F.col("node").alias(node), "component_id"))
    return rows.join(known, rows[fp_col] == known[node], "left").drop(node)


def _one(rows: DataFrame, id_col: str, fp_col: str, edges: DataFrame) -> DataFrame:
    # rows are dealt once, as the join and what drops repeated ones have the same keys; a component's row has a node of its own,
    # so the hash of its id only tells that node's rows apart
    (key,) = fresh(rows, "id_key")
    chosen = _named(rows, id_col, fp_col, edges).groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("c"))
    chosen = chosen.select(F.col("c.node").alias(fp_col), F.xxhash64("c.least").alias(key))
    return rows.withColumn(key, F.xxhash64(id_col)).join(chosen, [fp_col, key], "left_semi").dropDuplicates([fp_col, key]).select(*rows.columns)


def keep_one(rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fp", radius: int = RADIUS) -> DataFrame:
    """One row of each component: that with the least id, null ids last; of rows that share id and fingerprint any one."""
    return _one(rows, id_col, fp_col, links(rows, fp_col, radius))


def keep_similar(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_col: str = "fp", similarity: float = SIMILARITY) -> DataFrame:
    """As keep_one, of what near copies by shingle similarity connect; rows (stored ones) are `with_wide_fingerprints`.

    Rows of equal shingle sets are one node, and empty and null texts are one. The fingerprint column becomes one number.
    """
    spark = rows.sparkSession
    named = rows.withColumn(fp_col, F.col(fp_col)["node"])
    with passing(spark):
        nodes = rows.select(F.col(fp_col)["node"].alias("node"), node_of(fp_col).alias("print")).distinct()
        firsts = nodes.groupBy("print").agg(F.min("node").alias("first"))
        found = similar_links(rows, fp_col, radius_of(similarity, spreads=SPREADS))
        # a fingerprint's links are those of its least node, to which its others are tied
        twins = nodes.join(firsts, "print").where("node != first")
        names = firsts.select(F.col("print").alias("key"), F.col("first").alias("node")).unionByName(twins.select(F.col("node").alias("key"), "node"))
        proposed = cut(found.unionByName(twins.select(F.col("print").alias("a"), F.col("node").alias("b"))))
    # each step's tables and shuffle files go before the next one makes its own
    with passing(spark):
        edges = verified(proposed, named, id_col, text_col, fp_col, similarity, names=names)
    with passing(spark):
        pairs = unproposed(rows, edges, text_col, fp_col, similarity)
    with passing(spark):
        edges = edges.unionByName(verified(pairs, named, id_col, text_col, fp_col, similarity))
    return _one(named, id_col, fp_col, edges)
