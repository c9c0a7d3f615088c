"""SimHash near-duplicates by multi-index hashing.

``fingerprints`` lower-cases A-Z, takes runs of non-white-space as words and
hashes every k-word shingle, repeats included, by XXH64; bit i of the 64-bit
fingerprint is 1 if it is set in over half of the hashes.

``near_links`` finds all pairs of distinct fingerprints within 3 bits.  The
fingerprint is cut into two segments; two within the radius agree up to one
bit in one segment at least.  Every fingerprint is
filed under its own segment values and looks up the Hamming ball round them;
what meets under a value is verified on all 64 bits.  A pair needs to be looked
up from one side only, so a ball holds just the values that set further bits.
Of a group that meets, only a spanning forest of its links leaves the task, so
rows grow with the group and not with its square, and no link between
different components of the result is lost.

Copies are collapsed to one fingerprint before anything is joined.  The final
join back to the rows is one that AQE splits when a fingerprint is hot.

Edge cases: a text with fewer words than a shingle is one shingle; null or
wordless texts have fingerprint zero, linked like any other; a null id is
never a component's id unless all its members' are null; repeated rows keep
their multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, component_labels, map_slices, materialised

SEED = 42
#: Groups above this size are cut before they are verified.
WHOLE_GROUP = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes, k: int) -> list[bytes]:
    w = text.translate(LOWER).split()  # splits at U+0020 and U+0009..U+000D
    if len(w) <= k:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def fingerprint(text: bytes, k: int, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits; the first word is the plain SimHash, further ones remix each shingle's hash."""
    parts = shingles(text, k)
    ones, n = np.zeros((words, 64), np.int64), len(parts)
    for at in range(0, n, 1 << 16):
        block = parts[at : at + (1 << 16)]
        h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in block), "<u8", len(block))
        for w in range(words):
            if w:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            ones[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(df: DataFrame, text_col: str = "text", k: int = 3, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """All columns of ``df`` and a signed long for each 64 bits of fingerprint (columns of those names are replaced)."""
    own = [c for c in df.columns if c not in (*names, "_text")]
    schema = df.select(*own, *(F.lit(0).cast("long").alias(n) for n in names)).schema

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, k, len(names)) for t in as_bytes(part.column("_text"))], np.uint64).reshape(-1, len(names)).view(np.int64)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.array(fps[:, i]) for i in range(len(names)))], names=[*own, *names])

    return map_slices(df.select(*own, F.col(text_col).alias("_text")), "_text", schema, work)


def ball_masks(bits: int, radius: int) -> list[int]:
    """Every set of 1..radius of the bits."""
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def _spanning(node: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one group; fps: a row of words for each node."""
    rest = np.arange(len(node))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]).sum(axis=1) <= radius
            if near.any():
                reached = rest[near].tolist()
                rest = rest[~near]
                queue.extend(reached)
                for y in reached:
                    yield int(node[x]), int(node[y])


def _forest(node: np.ndarray, fps: np.ndarray, rest: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """``_spanning`` for a group of any size; rest: 32 bits of each of which two within the radius differ in ``radius`` at most.

    A large group is cut by each of radius + 1 parts of the rest, one of which
    any two within the radius have in common.
    """
    if len(node) <= WHOLE_GROUP:
        yield from _spanning(node, fps, radius)
        return
    width = 32 // (radius + 1)
    for part in range(radius + 1):
        value = (rest >> np.uint64(part * width)) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(some) > 1:
                yield from _spanning(node[some], fps[some], radius)


def near_links(fps: DataFrame, node_col: str, fp_cols: tuple[str, ...], radius: int = 3, width: int = 32, inner: int = 1) -> DataFrame:
    """Links ``a, b`` between nodes within ``radius`` bits, enough to connect all that are linked.

    Every word of the fingerprint gives ``64 // width`` segments; two nodes meet
    where a segment differs by ``inner`` bits at most.  With one word, width 32
    and inner 1 that is every pair within 3 bits.
    """
    masks, words = np.array(ball_masks(width, inner), np.uint64), len(fp_cols)
    low, names = np.uint64((1 << width) - 1), [f"w{i}" for i in range(words)]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node_all = batch.column(0).to_numpy()
            fp_all = [batch.column(1 + w).to_numpy().view(np.uint64) for w in range(words)]
            for at in range(0, len(node_all), 4096):
                node = node_all[at : at + 4096]
                fp = [x[at : at + 4096] for x in fp_all]
                for s in range(words * (64 // width)):
                    own = (fp[s // (64 // width)] >> np.uint64(s % (64 // width) * width)) & low
                    tag = np.uint64(s) << np.uint64(width)
                    everyone = np.arange(len(node))
                    keys, who = [own | tag], [everyone]
                    for m in masks:
                        # two that differ by a mask: the one whose lowest differing bit is 0 looks the other up
                        side = everyone[(own & (m & (~m + np.uint64(1)))) == 0]
                        keys.append((own[side] ^ m) | tag)
                        who.append(side)
                    i = np.concatenate(who)
                    probe = np.arange(len(i)) >= len(node)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(probe), pa.array(node[i]), *(pa.array(x[i].view(np.int64)) for x in fp)], names=["key", "probe", "node", *names])

    def links(key: np.ndarray, probe: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        filed = ~probe[start] if len(start) else np.empty(0, bool)  # sorted: what is filed comes first
        two = start[filed & (size == 2)]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1) <= radius
        left, right = [node[two[near]]], [node[two[near] + 1]]
        for at, n in zip(start[filed & (size > 2)].tolist(), size[filed & (size > 2)].tolist(), strict=True):
            own = slice(at, at + n)
            if words == 1 and width == 32:
                rest = fp[own, 0] >> np.uint64(0 if int(key[at]) >> width else 32)  # the other segment
                pairs = list(_forest(node[own], fp[own], rest & low, radius))
            else:
                pairs = list(_spanning(node[own], fp[own], radius))
            left.append(np.array([p[0] for p in pairs], np.int64))
            right.append(np.array([p[1] for p in pairs], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, probe, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            now = (key, probe, node, np.stack([batch.column(3 + w).to_numpy().view(np.uint64) for w in range(words)], axis=1))
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut or held and held[-1][0][-1] != key[0]:
                yield links(*(np.concatenate(x) for x in zip(*held, tuple(x[:cut] for x in now), strict=True)))
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    schema = "key long, probe boolean, node long, " + ", ".join(f"{n} long" for n in names)
    filed = fps.select(F.col(node_col).cast("long").alias("node"), *(F.col(c).cast("long").alias(n) for c, n in zip(fp_cols, names, strict=True))).mapInArrow(file, schema)
    return filed.repartition("key").sortWithinPartitions("key", "probe").mapInArrow(meet, "a long, b long")


def fingerprint_components(rows: DataFrame, id_col: str, links: DataFrame, fp_col: str = "fp") -> DataFrame:
    """``fp, component`` for every distinct fingerprint: the smallest id reachable over equal fingerprints and links."""
    least = rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"))
    label = component_labels(links).withColumnRenamed("node", "fp")
    least = least.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    top = least.groupBy("root").agg(F.min("least").alias("component"))
    return least.join(top, "root").select("fp", "component")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """``id, fingerprint`` (16 hex digits) and ``component_id`` for every row."""
    rows = materialised(fingerprints(df.select(F.col(id_col), F.col(text_col).alias("_t")), "_t", k).select(id_col, "fp"))
    links = near_links(rows.select("fp").distinct(), "fp", ("fp",), radius=radius)
    labels = fingerprint_components(rows, id_col, links)
    return rows.join(labels, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
