"""Texts whose sets of k-word shingles have a Jaccard similarity of 0.8 or more, by SimHash and multi-index hashing.

A wide SimHash fingerprint of every set is cut into segments.  A set is filed
under its own value of each segment and under the Hamming ball of radius 2 over
the segment's least certain bits, those whose sums are nearest to zero: of two
similar sets these are the bits that differ.  What meets under a value is
compared by 96 bits of the fingerprint and by size, then by the complete
fingerprints; a pair that remains is verified on both whole sets, so the links
are exact and only those that never meet can be missed.

The width of a segment follows the number of rows, so that the rows under a
value do not grow with the corpus, and the number of segments follows the
width: a pair at 0.8 meets nowhere with a chance of MISS, one at 0.9 with less
than MISS ** 2.

Within a value the first set is compared with all, then the first of those that
are far from it, and so on: a family costs a pair for each member, not all its
pairs.  Where that leaves members of a value in different components, these are
compared if they share one of their rarest shingles, as any pair at 0.8 does, so
texts that only have a common passage in common are not compared in pairs.  Of a
value so many rows are held as are far from each other, however many meet there.

Edge cases: a text with fewer words than a shingle is one shingle; wordless and
null texts have no set and are in no group; equal rows are one node.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, component_labels, discard, materialised, text_slices
from .simhash import LOWER

#: Least certain bits of a segment, over which its ball is laid; chance that a pair at 0.8 is missed.
UNCERTAIN, MISS = 3, 1e-3
#: Share of the bits that differ at a similarity of 0.8, and how many deviations above it a distance may be.
DIFFERING, DIFFERING_FEW, FEW, DEVIATIONS = 0.153, 0.195, 24, 3.5
#: Words of 64 bits of a complete fingerprint, at least: so many tell 0.7 from 0.8.
WORDS = 24
#: Bits of the first 96 that may differ.
NEAR_96 = 29
#: Groups of a value up to this size are looked through for rows near no other.
SMALL = 16
#: Rows of one value that are taken in at once, and tasks that one set's comparisons are dealt to.
HELD, SALTS = 1 << 18, 1024
#: Shingles that a task puts together at once.
LOT = 1 << 20
#: Sets whose shingles are counted in one pass, and the most passes: only the shingles of one pass are on disk at once.
PER_PASS, PASSES = 1 << 14, 4
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
FLIPS = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [1, 0, 1], [0, 1, 1]], np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, each made of its words' hashes in order."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(len(words), k), np.uint64)
    for i in range(min(len(words), k)):
        h = mixed(h + own[i : i + n])
    return np.unique(h)


def layout(rows: int) -> tuple[int, int]:
    """Width and number of the segments for so many rows.

    Measured over pairs at 0.8: one of width 16 is met by a third of the pairs
    and each further bit takes 13 % off.
    """
    width = min(max(16, math.ceil(math.log2(max(rows, 2)))), 32)
    return width, math.ceil(math.log(MISS) / math.log(1 - 0.334 * 0.87 ** (width - 16)))


def sums(own: np.ndarray, words: int) -> np.ndarray:
    """For each of 64 * words bits, how many more hashes have it set than not."""
    h, places = own, []
    for w in range(words):
        places.append(h.view(np.uint8).reshape(-1, 8) + (256 * (8 * w + np.arange(8)))[None, :])
        h = mixed(h + np.uint64(0x9E3779B97F4A7C15))
    bytes_ = np.bincount(np.concatenate(places, axis=1).ravel(), minlength=2048 * words).reshape(-1, 256)
    return 2 * (bytes_ @ BITS).ravel() - len(own)


def fingerprinted(df: DataFrame, node_col: str, text_col: str, k: int, width: int, segments: int) -> DataFrame:
    """``node, size, weak`` and the words ``f0..`` of a fingerprint for every text with a word; weak: the uncertain bits of each segment."""
    words = max(WORDS, -(-segments * width // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                seen, nodes, sizes, weak, prints = set(), [], [], [], []
                for node, text in zip(part.column("_node").to_pylist(), as_bytes(part.column("_text")), strict=True):
                    if node in seen:
                        continue
                    seen.add(node)
                    own = shingle_set(text, k)
                    if len(own):
                        s = sums(own, words)
                        nodes.append(node)
                        sizes.append(len(own))
                        weak.append(np.argsort(np.abs(s[: segments * width]).reshape(segments, width), axis=1, kind="stable")[:, :UNCERTAIN].astype(np.uint8).tobytes())
                        prints.append(np.packbits(s > 0, bitorder="little").view("<i8"))
                table = np.array(prints, np.int64).reshape(-1, words)
                columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(weak, pa.binary()), *(pa.array(np.ascontiguousarray(table[:, w])) for w in range(words))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "weak", *(f"f{w}" for w in range(words))])

    schema = "node long, size int, weak binary, " + ", ".join(f"f{w} long" for w in range(words))
    rows = df.select(F.col(node_col).alias("_node"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in rows.columns[1:]))


def filed(prints: DataFrame, width: int, segments: int) -> DataFrame:
    """``key, node, tail, print``: a row for every value of every segment under which a set is filed."""
    words, power = len(prints.columns) - 3, 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                table = np.stack([part.column(3 + w).to_numpy() for w in range(words)], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(table).view(np.uint8), axis=1, bitorder="little")[:, : segments * width]
                own = bits.reshape(n, segments, width).astype(np.int64) @ power
                weak = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(n, segments, UNCERTAIN).astype(np.int64)
                keys = (own[:, :, None] ^ ((1 << weak) @ FLIPS.T)) | (np.arange(segments, dtype=np.int64)[None, :, None] << width)
                each = segments * len(FLIPS)
                tail = part.column(1).to_numpy().astype(np.int64) << 32 | table[:, min(1, words - 1)] & 0xFFFFFFFF
                node, tail, first = (np.repeat(x, each) for x in (part.column(0).to_numpy(), tail, table[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node), pa.array(tail), pa.array(first)], names=["key", "node", "tail", "print"])

    return prints.mapInArrow(run, "key long, node long, tail long, print long")


def may_link(tail_a: np.ndarray, tail_b: np.ndarray, print_a: np.ndarray, print_b: np.ndarray) -> np.ndarray:
    """tail: the size above 32 more bits of the fingerprint."""
    size_a, size_b = tail_a >> 32, tail_b >> 32
    fits = 5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)
    more = np.bitwise_count((tail_a ^ tail_b) & 0xFFFFFFFF)
    return fits & (np.bitwise_count((print_a ^ print_b).view(np.uint64)) + more <= NEAR_96)


def starred(key: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: the place of the leader that each row is near to (-1 for none), and whether a row leads.

    The first row of a key leads; of those not near to it the first leads next.
    ``near`` tells it of the places of two rows.
    """
    leader, leads, left = np.full(len(key), -1), np.zeros(len(key), bool), np.arange(len(key))
    while len(left):
        opens = np.r_[True, key[left][1:] != key[left][:-1]]
        leads[left[opens]] = True
        head = left[opens][np.cumsum(opens) - 1][~opens]
        left = left[~opens]
        found = near(left, head)
        leader[left[found]] = head[found]
        left = left[~found]
    return leader, leads


def near_some(key: np.ndarray, tail: np.ndarray, print_: np.ndarray) -> np.ndarray:
    """Whether a row may be linked to another of its key; rows of keys of more than SMALL count as such."""
    found, n = np.zeros(len(key), bool), len(key)
    for d in range(1, min(SMALL, n)):
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        near = same[may_link(tail[same], tail[same + d], print_[same], print_[same + d])]
        found[near] = found[near + d] = True
    if n > SMALL:
        wide = np.flatnonzero(key[SMALL:] == key[:-SMALL])
        big = np.isin(key, key[wide])
        found |= big
    return found


def met(rows: DataFrame) -> DataFrame:
    """``key, node, tail, print, first`` of the rows that may be linked to another of their key; first: the node of a row's leader."""

    def solve(held: list[np.ndarray], lead: int) -> Iterator[pa.RecordBatch]:
        """lead: so many rows at the front are leaders of the same key that were given out before."""
        key, node, tail, print_ = held
        leader, _ = starred(key, lambda i, j: may_link(tail[i], tail[j], print_[i], print_[j]))
        keep = near_some(key, tail, print_) | (leader >= 0)
        keep[:lead] = False
        first = pa.array(node[np.maximum(leader, 0)][keep], mask=(leader < 0)[keep])
        yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in held), first], names=["key", "node", "tail", "print", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = lead = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            if cut or held and held[-1][0][-1] != now[0][0]:
                whole = [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)]
                if len(whole[0]):
                    yield from solve(whole, lead)
                held, count, lead = [], 0, 0
            held.append([x[cut:] for x in now])
            count += len(now[0]) - cut
            if count - lead > HELD:  # a hot key: of what was seen of it, only the leaders are needed for what follows
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield from solve(whole, lead)
                _, leads = starred(whole[0], lambda i, j: may_link(whole[2][i], whole[2][j], whole[3][i], whole[3][j]))
                held = [[x[leads] for x in whole]]
                count = lead = int(leads.sum())
        if held:
            yield from solve([np.concatenate(x) for x in zip(*held, strict=True)], lead)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, tail long, print long, first long")


def pressed(df: DataFrame, node_col: str, text_col: str) -> DataFrame:
    """``node, body``: the text compressed, once for each node of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                distinct = dict(zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(distinct), pa.int64()), pa.array([zip_.compress(t) for t in distinct.values()], pa.binary())], names=["node", "body"])

    return df.select(F.col(node_col).alias("_node"), F.col(text_col).alias("_text")).mapInArrow(run, "node long, body binary")


def in_class(bodies: DataFrame, k: int, turn: int, passes: int, counted: bool) -> DataFrame:
    """``shingle, node`` of the shingles whose hash is ``turn`` modulo ``passes``; counted: ``shingle, n`` for each lot of texts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            nodes, bodies = batch.column(0).to_numpy(), batch.column(1)
            start = total = 0
            sets: list[np.ndarray] = []
            for i in range(len(nodes)):
                own = shingle_set(unzip.decompress(bodies[i].as_py()), k)
                sets.append(own[own % np.uint64(passes) == turn].view(np.int64))
                total += len(sets[-1])
                if total >= LOT or i == len(nodes) - 1:
                    every = np.concatenate(sets)
                    other = np.repeat(nodes[start : i + 1], [len(x) for x in sets])
                    if counted:
                        every, other = np.unique(every, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(other, pa.int64())], names=["shingle", "n" if counted else "node"])
                    start, total, sets = i + 1, 0, []

    return bodies.mapInArrow(run, "shingle long, n long" if counted else "shingle long, node long")


def rare_first(bodies: DataFrame, prints: DataFrame, k: int, passes: int) -> DataFrame:
    """``shingle, node, size``: of every set the shingles that it has to share one of with any set at 0.8.

    Two such sets of n and m shingles share 0.8 of the larger at least, so under
    any one order of all shingles their first n // 5 + 1 have one in common.
    The order is by the number of sets that hold a shingle, the rarest first: a
    passage that many texts share is no reason to compare them.

    Shingles of one set only are counted but not written: they come first, and
    their number is what the set's size leaves.  All shingles are counted, by
    classes of their hashes, of which one at a time is shuffled.

    bodies: each node once; prints: with the ``size`` of every set.
    """
    shared = []
    for turn in range(passes):
        often = materialised(in_class(bodies, k, turn, passes, True).groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), tidy=True)
        shared.append(materialised(in_class(bodies, k, turn, passes, False).join(often, "shingle").select("node", "shingle", "n"), tidy=True))
        discard(often)
    ordered = reduce(DataFrame.unionByName, shared).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s")).join(prints.select("node", "size"), "node")
    unique = F.col("size") - F.size("s")
    first = F.slice("s", 1, F.greatest(F.floor(F.col("size") / 5).cast("int") + 1 - unique, F.lit(0)))
    rare = materialised(ordered.select("node", "size", F.explode(first).alias("x")).select("x.shingle", "node", "size"), tidy=True)
    for table in shared:
        discard(table)
    return rare


def far_limit(bits: int, few: bool = False) -> int:
    """Complete distances above it are not those of sets at 0.8; few: of sets of under FEW shingles, whose sums are often nil."""
    share = DIFFERING_FEW if few else DIFFERING
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def by_shingle(rows: DataFrame, prints: DataFrame, every: bool, turn: int = 0) -> DataFrame:
    """``a, b`` under one shingle that may be linked and are of different roots: with its leader only, or ``every`` pair.

    Leaders are others in each turn.

    rows: ``shingle, root, node, size``; a pair has to be near by all words of the fingerprints in ``prints``.
    """
    words = len(prints.columns) - 3
    limit, few = far_limit(64 * words), far_limit(64 * words, True)

    def solve(root: np.ndarray, node: np.ndarray, size: np.ndarray, *prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One shingle, sorted by root if every pair is wanted."""
        print_ = np.stack(prints, axis=1).view(np.uint64)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            fits = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
            return fits & (np.bitwise_count(print_[i] ^ print_[j]).sum(axis=1) <= np.where(np.minimum(size[i], size[j]) < FEW, few, limit))

        def out(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            i, j = i[root[i] != root[j]], j[root[i] != root[j]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

        if not every:
            leader, _ = starred(np.zeros(len(node), np.int64), near)
            yield out(np.flatnonzero(leader >= 0), leader[leader >= 0])
            return
        cuts = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        count = np.diff(np.r_[cuts, len(root)])
        most = int(count.argmax())
        largest = np.arange(cuts[most], cuts[most] + count[most])
        order = np.r_[largest, np.delete(np.arange(len(root)), largest)]
        for i in range(len(largest), len(root)):  # each outside of the largest root, with all before it
            before = order[:i][root[order[:i]] != root[order[i]]]
            before = before[near(before, np.full(len(before), order[i]))]
            if len(before):
                yield out(before, np.full(len(before), order[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cuts = np.r_[0, np.flatnonzero(now[0][1:] != now[0][:-1]) + 1, len(now[0])] if len(now[0]) else []
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1][0][-1] != now[0][at]:
                    yield from solve(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:]))
                    held = []
                held.append([x[at:end] for x in now])
        if held:
            yield from solve(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:]))

    several = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    # the wide fingerprints only go to rows that are left
    rows = rows.join(several, "shingle").join(prints.drop("size", "weak"), "node").select("shingle", "root", "node", "size", *(f"f{w}" for w in range(words)))
    # with a different leader under each shingle, each round connects much of a family
    order = ("root", "node") if every else (F.xxhash64("shingle", "node", F.lit(turn)),)
    return rows.repartition("shingle").sortWithinPartitions("shingle", *order).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, prints: DataFrame, df: DataFrame, node_col: str, text_col: str, k: int) -> DataFrame:
    """The pairs ``a, b`` whose complete fingerprints are near and whose whole sets have a similarity of 0.8 or more."""
    words = len(prints.columns) - 3
    near = materialised(pairs.distinct(), tidy=True)
    for side in "ab":
        near = near.join(prints.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), *(F.col(f"f{w}").alias(f"{side}{w}") for w in range(words))), side)
    differ = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in range(words)), F.lit(0))
    near = materialised(near.where(differ <= F.when(F.least("a_size", "b_size") < FEW, far_limit(64 * words, True)).otherwise(far_limit(64 * words))).select("a", "b"), tidy=True)
    # a set is compared with its partners by as many tasks as it has partners, up to SALTS
    salted = near.select("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"), F.col("b").alias("node"))
    jobs = salted.unionByName(salted.select("a", "salt", F.col("a").alias("node")).distinct())
    needed = jobs.select(F.col("node").alias("_in")).distinct()

    texts = df.select(F.col(node_col).alias("_node"), F.col(text_col).alias("_text")).join(needed, F.col("_node") == F.col("_in"), "left_semi")
    bodies = pressed(texts, "_node", "_text").groupBy("node").agg(F.first("body").alias("body"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, at, own = zstandard.ZstdDecompressor(), None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, node, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = shingle_set(unzip.decompress(body.as_py()), k)
                if node == a:
                    at, own = a, s
                elif a == at:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if 9 * common >= 4 * (len(own) + len(s)):  # common / (total - common) >= 0.8
                        left.append(a)
                        right.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    ready = jobs.join(bodies, "node").select("a", "salt", "node", "body").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("node") != F.col("a"))
    return materialised(ready.mapInArrow(compare, "a long, b long"), tidy=True)


def similar_groups(df: DataFrame, node_col: str, text_col: str = "text", k: int = 5) -> DataFrame:
    """``node, root`` for every node linked to another, with the smallest node of its group; ``node_col`` stands for the text."""
    width, segments = layout(df.count())
    prints = materialised(fingerprinted(df, node_col, text_col, k, width, segments), tidy=True)
    seen = materialised(met(filed(prints, width, segments)), tidy=True)
    # the smallest leader of each set: in a family it is mostly the same one
    stars = seen.where("first is not null").groupBy("node").agg(F.min("first").alias("first"))
    links = verified(stars.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")), prints, df, node_col, text_col, k)
    labels = materialised(component_labels(links, tidy=True), tidy=True)
    # what meets and is not yet connected is compared where it shares a rare shingle
    rooted = materialised(seen.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), tidy=True)
    discard(seen)
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = materialised(rooted.join(split, "key").select(F.col("node").alias("_in")).distinct(), tidy=True)
    discard(rooted)
    # texts are compressed, and copies dropped, before they are dealt out
    bodies = pressed(df, node_col, text_col).groupBy("node").agg(F.first("body").alias("body"))
    bodies = materialised(bodies.join(open_, F.col("node") == F.col("_in"), "left_semi"), tidy=True)
    rare = rare_first(bodies, prints, k, min(PASSES, 1 + open_.count() // PER_PASS))
    discard(bodies)
    for turn, every in enumerate((False, False, True)):
        # written out: a plan that joins itself under renamed columns gave wrong roots
        now = materialised(rare.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), tidy=True)
        more = verified(by_shingle(now, prints, every, turn), prints, df, node_col, text_col, k)
        discard(now)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = materialised(component_labels(links, tidy=True), tidy=True)
    return labels.where("node <> root")
