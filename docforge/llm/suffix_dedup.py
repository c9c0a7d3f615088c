"""Removal of long repeated strings by suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else in the corpus goes.  How the work is split so that no task holds more
than a bounded part of the suffixes:

1. In every window of ``WINDOW`` starts the ``PROBE``-byte string with the
   least hash is an *anchor*.  A string of ``length`` bytes holds all the probes
   of its own window, so equal strings have the same anchor at the same offset.
   Texts are read once; each anchor leaves a row with the hash of its probe,
   the hash of its context (all bytes of the strings that chose it) and its
   place.  Copies within a slice are counted, not repeated.
2. Rows are dealt by probe hash, those of hot probes by all columns.  A probe seen once holds no repeat.  Where all
   occurrences have one context, all its strings repeat.
3. The distinct contexts of other probes are fetched from their texts.  For a
   class of them, suffixes in blocks of ``BLOCK`` bytes, counted from the anchor,
   are sorted by the grouping construction of ``suffix_array``.  Strings whose
   blocks are a common prefix of neighbours in this order, at one place from the
   anchor, repeat if the bytes at their ends are equal too.  Blocks and ends are
   compared as bytes.  A class with more than ``CLASS_LIMIT`` distinct contexts
   is split: its strings are counted one by one through a shuffle, by 64-bit hash.
4. What repeats goes back to the texts by their content hash, and each text is
   cut once.

Strings are judged on the input.  Places are of one context if both probe and
context agree by 64-bit hash; shuffled texts are compressed.

Edge cases: null and empty texts have zero bytes and lose none; texts shorter
than ``length`` lose none; overlapping occurrences within a text count; equal
rows are copies of each other; a text of any length is read in parts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialised, text_slices
from .suffix_array import suffix_array

LENGTH = 200
#: Window of starts and bytes of a probe; WINDOW + PROBE - 1 <= LENGTH.
WINDOW, PROBE = 141, 60
BLOCK = 20
#: Starts of a text that are hashed at once, and bytes of joined texts.
PART = 1 << 20
#: Distinct contexts of one probe that a task sorts; contexts of a run of suffix sorting.
CLASS_LIMIT, SORT_RUN = 8_000, 5_000
#: A probe of more than one row in HOT_PARTS is hot.
HOT_PARTS = 1000
FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * PART + 4 * LENGTH
    up, down = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Prefixes:
    """Hashes of any substrings of one buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers()
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, window: int = WINDOW, probe: int = PROBE) -> tuple[np.ndarray, ...]:
    """Anchor place, first and last start, probe hash and context hash; starts: ascending starts of whole strings."""
    if not len(starts):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = Prefixes(data)
    h = hashes.every(probe)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, last, at = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], at[new]
    context = mix(hashes.of(first, last - first + length) + ((at - first) << 8 | (last - first)).astype(np.uint64))
    return at, first, last, h[at], context


def text_anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first start, strings, offset of the anchor, probe hash, context hash), part by part."""

    def part(group: list[tuple[int, int, bytes, int]]) -> tuple[np.ndarray, ...]:
        """group: text number, place in it, bytes, starts among them."""
        begin = np.cumsum([0] + [len(b) for _, _, b, _ in group])
        data = np.frombuffer(b"".join(b for _, _, b, _ in group), np.uint8)
        starts = np.concatenate([np.arange(s, s + n) for s, (_, _, _, n) in zip(begin, group, strict=False)])
        at, first, last, probe, context = anchors(data, starts, length)
        which = np.searchsorted(begin, first, "right") - 1
        number, offset = (np.array([g[i] for g in group], np.int64) for i in (0, 1))
        return number[which], first - begin[which] + offset[which], last - first, at - first, probe, context

    group, total = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PART):
            n = min(PART, len(text) - length + 1 - at)
            if group and total + n > PART:
                yield part(group)
                group, total = [], 0
            group.append((i, at, text[at : at + n + length - 1], n))
            total += n + length - 1
    if group:
        yield part(group)


def block_order(blocks: np.ndarray, begin: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of sequences of blocks: (suffixes in order, blocks that each has in common with the next).

    blocks: BLOCK bytes a row, sequence after sequence; begin: first row of each.
    A zero parts each sequence from the next, so the suffix of row r of sequence
    s is at r + s; common blocks are counted up to ``deepest`` and never past it.
    """
    symbols = np.unique(np.ascontiguousarray(blocks).view(f"V{BLOCK}").ravel(), return_inverse=True)[1] + 1
    row = np.arange(len(blocks))
    flat = np.zeros(len(blocks) + len(begin) + deepest, np.int64)
    flat[row + np.searchsorted(begin, row, "right") - 1] = symbols
    order = np.array(suffix_array(flat[: len(blocks) + len(begin)]), np.int64)
    common, going = np.zeros(len(order), np.int64), np.ones(len(order) - 1, bool)
    for depth in range(deepest):
        here = flat[order + depth]
        going = going & (here[1:] == here[:-1]) & (here[1:] > 0)
        common[:-1] += going
    return order, common


def repeats_in(many: np.ndarray, offset: np.ndarray, strings: np.ndarray, contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Which strings of each context repeat, as a mask over its starts; contexts of whole classes.

    Contexts are cut into blocks from the anchor on, forwards and backwards.  A
    string is the whole blocks in it and less than a block at either end.  Its
    blocks begin a suffix, and strings with the same ones are neighbours in the
    suffix order; among these the bytes at the ends are compared.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.cumsum([0] + [len(c) for c in contexts])[:-1]
    before, after = offset // BLOCK, (strings + length - offset) // BLOCK
    begin = np.cumsum(before + after) - (before + after)
    row = np.repeat(np.arange(len(contexts)), before + after)
    first = (at + offset - before * BLOCK)[row] + (np.arange(len(row)) - begin[row]) * BLOCK
    order, common = block_order(data[first[:, None] + np.arange(BLOCK)], begin, length // BLOCK)

    count = strings + 1
    row = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    distance = offset[row] - start
    hit = many[row] > 1
    back = distance // BLOCK
    whole = back + (length - distance) // BLOCK
    suffix = begin[row] + row + before[row] - back
    run = np.empty(len(row), np.int64)  # strings of one number of blocks have the same ones where their run is the same
    for size in np.unique(whole):
        runs = np.empty(len(order), np.int64)
        runs[order] = np.cumsum(np.r_[0, common[:-1] < size])
        run[whole == size] = runs[suffix[whole == size]]
    key = run * 2 * length + distance
    key_of, crowd = np.unique(key, return_inverse=True, return_counts=True)[1:]
    open_ = np.flatnonzero(crowd[key_of] > 1)
    left = at[row[open_]] + start[open_]
    ends = np.zeros((len(open_), 2 * BLOCK), np.uint8)
    for e in range(BLOCK):  # bytes before the first and after the last whole block
        has = distance[open_] % BLOCK > e
        ends[has, e] = data[left[has] + e]
        has = (length - distance[open_]) % BLOCK > e
        ends[has, BLOCK + e] = data[left[has] + length - 1 - e]
    words = np.ascontiguousarray(ends).view(np.uint64)
    value = mix(key[open_].astype(np.uint64))
    for w in range(words.shape[1]):
        value = mix(value ^ words[:, w])
    ordered = np.argsort(value)
    a, b = ordered[1:], ordered[:-1]
    equal = value[a] == value[b]
    same = equal & (key[open_[a]] == key[open_[b]]) & (words[a] == words[b]).all(axis=1)
    hit[open_[a[same]]] = True
    hit[open_[b[same]]] = True
    if (equal & ~same).any():  # different strings of one hash may part equal ones
        mixed = np.flatnonzero(np.isin(value, value[a[equal & ~same]]))
        told = [(int(key[open_[i]]), ends[i].tobytes()) for i in mixed]
        seen = Counter(told)
        hit[open_[[i for i, t in zip(mixed, told, strict=True) if seen[t] > 1]]] = True
    return np.split(hit, np.cumsum(count)[:-1])


def mask_runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every run of true."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def packed(first: Column, strings: Column, offset: Column) -> Column:
    return first * 65536 + strings * 256 + offset


def _compressed(df: DataFrame, text_col: str) -> DataFrame:
    """``text_key, body``: texts of at least one string, one of equal texts in a slice, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                distinct = dict(zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(distinct), pa.int64()), pa.array([press.compress(t) for t in distinct.values()], pa.binary())], names=["text_key", "body"])

    return df.select("text_key", F.col(text_col).alias("_text")).mapInArrow(run, "text_key long, body binary")


def _repeated_probes(found: DataFrame) -> DataFrame:
    """``found`` without probes that occur once; equal rows as one with ``n`` added up, and ``mixed``: the probe has several contexts.

    Rows are dealt by probe in one exchange.  Probes that hold more than one row
    in HOT_PARTS are fewer than HOT_PARTS, so they are named in the plan; their
    rows are dealt by all columns and stay where they are from then on.
    """
    most = found.count() / HOT_PARTS
    bucket = F.pmod("probe", F.lit(64 * HOT_PARTS))

    def above(rows: DataFrame, key: Column) -> list[int]:
        return [r[0] for r in rows.groupBy(key.alias("key")).agg(F.count("*").alias("c")).where(F.col("c") > most).select("key").collect()]

    is_hot = F.col("probe").isin(above(found.where(bucket.isin(above(found, bucket))), F.col("probe")))

    def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = rows.groupBy("probe", "context", "text_key", "place").agg(F.sum("n").alias("n"))
        probes = rows.groupBy("probe").agg(F.sum("n").alias("total"), (F.min("context") != F.max("context")).alias("mixed")).where("total > 1")
        return rows, probes.select("probe", "mixed")

    hot, known = dealt(found.where(is_hot))
    known = known.collect()
    hot = hot.where(F.col("probe").isin([r.probe for r in known])).withColumn("mixed", F.col("probe").isin([r.probe for r in known if r.mixed]))
    cold, probes = dealt(found.where(~is_hot).repartition("probe"))
    return materialised(cold.join(probes, "probe").unionByName(hot))


def repeated_ranges(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``text_key, ranges``: for the content hash of a text, the (first, last) starts of its repeated strings."""
    texts = df.select(text_key(text_col).alias("text_key"), F.col(text_col).alias("_t")).where(F.octet_length("_t") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                keys = part.column(0).to_pylist()
                many = Counter(keys)
                distinct = dict(zip(keys, as_bytes(part.column(1)), strict=True))
                key, copies = np.array(list(distinct), np.int64), np.array([many[k] for k in distinct], np.int64)
                for i, first, strings, offset, probe, context in text_anchors(list(distinct.values()), length):
                    columns = [probe.view(np.int64), context.view(np.int64), key[i], first * 65536 + strings * 256 + offset, copies[i]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["probe", "context", "text_key", "place", "n"])

    found = texts.select("text_key", F.col("_t").alias("_text")).mapInArrow(find, "probe long, context long, text_key long, place long, n long")
    seen = _repeated_probes(materialised(found))
    place = F.col("place")
    first, strings = F.floor(place / 65536), F.floor(place / 256) % 256
    whole = seen.where("not mixed").select("text_key", F.array(F.struct(first.alias("first"), (first + strings).alias("last"))).alias("ranges"))
    mixed = seen.where("mixed")
    contexts = mixed.groupBy("probe", "context").agg(F.min(F.struct("text_key", "place")).alias("at"), F.sum("n").alias("n"))

    wanted = contexts.groupBy("at.text_key").agg(F.collect_list(F.struct("probe", "context", F.col("at.place").alias("place"), "n")).alias("wanted"))
    bodies = wanted.join(_compressed(texts, "_t"), "text_key").select("wanted", "body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                body, items = loose.decompress(batch.column(1)[i].as_py()), batch.column(0)[i].values.flatten()
                probe, context, places, many = (x.to_numpy(zero_copy_only=False) for x in items)
                size = places // 256 % 256
                out = [body[a : a + n + length] for a, n in zip((places // 65536).tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(context), pa.array(places % 65536), pa.array(many), pa.array(out, pa.binary())], names=["probe", "context", "shape", "n", "bytes"])

    cuts = bodies.mapInArrow(cut, "probe long, context long, shape long, n long, bytes binary")
    cuts = materialised(cuts.groupBy("probe", "context").agg(F.first("shape").alias("shape"), F.first("n").alias("n"), F.first("bytes").alias("bytes")))
    hot = materialised(cuts.groupBy("probe").agg(F.count("*").alias("c")).where(F.col("c") > CLASS_LIMIT).select("probe"))
    known = _sorted_classes(cuts.join(hot, "probe", "left_anti"), length).unionByName(_counted_strings(cuts.join(hot, "probe", "left_semi"), length))
    part = mixed.select("probe", "context", "text_key", first.alias("first")).join(known, ["probe", "context"])
    part = part.select("text_key", F.transform("runs", lambda r: F.struct((F.col("first") + r["first"]).alias("first"), (F.col("first") + r["last"]).alias("last"))).alias("ranges"))
    return whole.unionByName(part).groupBy("text_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


RUNS = "array<struct<first:long,last:long>>"


def _runs_array(masks: list[np.ndarray]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in mask_runs(m)] for m in masks], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))


def _sorted_classes(cuts: DataFrame, length: int) -> DataFrame:
    """Suffix-sort the contexts, whole classes at a time."""

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        shape = part.column("shape").to_numpy()
        masks = repeats_in(part.column("n").to_numpy(), shape % 256, shape // 256, part.column("bytes").to_pylist(), length)
        keep = [i for i, m in enumerate(masks) if m.any()]
        return pa.RecordBatch.from_arrays([part.column("probe").take(pa.array(keep, pa.int64())), part.column("context").take(pa.array(keep, pa.int64())), _runs_array([masks[i] for i in keep])], names=["probe", "context", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            while held is not None and held.num_rows > SORT_RUN:
                probe = held.column("probe").to_numpy()
                at = int(np.searchsorted(probe, probe[SORT_RUN]))  # whole classes only
                if not at:
                    at = int(np.searchsorted(probe, probe[0], "right"))
                    if at == held.num_rows:
                        break
                yield solve(held.slice(0, at))
                held = held.slice(at)
        if held is not None:
            yield solve(held)

    dealt = cuts.select("probe", "context", "shape", "n", "bytes").repartition("probe").sortWithinPartitions("probe")
    return dealt.mapInArrow(run, f"probe long, context long, runs {RUNS}")


def _counted_strings(cuts: DataFrame, length: int) -> DataFrame:
    """The exact way for classes too large for one task: count every string by hash and distance from its anchor."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for probe, context, shape, many, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = np.arange(shape // 256 + 1)
                h = Prefixes(np.frombuffer(body, np.uint8)).of(starts, length)
                value = mix(h ^ mix((np.uint64(probe % (1 << 64)) + (shape % 256 - starts).astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(starts), pa.int64()) for x in (probe, context)] + [pa.array(starts), pa.array(value.view(np.int64)), pa.array([many] * len(starts), pa.int64())], names=["probe", "context", "start", "value", "n"])

    found = cuts.select("probe", "context", "shape", "n", "bytes").mapInArrow(strings, "probe long, context long, start long, value long, n long")
    twice = found.groupBy("value").agg(F.sum("n").alias("total")).where("total > 1").select("value")
    return found.join(twice, "value").groupBy("probe", "context").agg(F.collect_list(F.struct(F.col("start").alias("first"), F.col("start").alias("last"))).cast(RUNS).alias("runs"))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col))


def united(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans covered by strings that start in the ranges; spans that touch are one."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_ranges(df: DataFrame, text_col: str, length: int) -> DataFrame:
    ranges = repeated_ranges(df, text_col, length)
    rows = df.withColumn("_text_key", text_key(text_col))
    return rows.join(ranges.select(F.col("text_key").alias("_text_key"), F.col("ranges").alias("_ranges")), "_text_key", "left").drop("_text_key")


def _spans(column: pa.Array, i: int, length: int) -> list[tuple[int, int]]:
    found = column[i].as_py()
    return united([(r["first"], r["last"]) for r in found], length) if found else []


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_t"):
                rows = []
                for i, text in enumerate(as_bytes(part.column("_t"))):
                    spans = _spans(part.column("_ranges"), i, length)
                    rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(text, spans)).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *columns], names=names)

    ready = _with_ranges(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t", length).select("_id", "_t", "_ranges")
    return ready.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with repeated bytes cut from its texts and ``n_removed``; characters cut in two are dropped whole."""
    own = [c for c in df.columns if c not in ("n_removed", "_ranges", "_text_key")]
    schema = df.select(*own, F.lit(0).cast("long").alias("n_removed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                texts, removed = [], []
                for i, (text, null) in enumerate(zip(as_bytes(part.column(text_col)), part.column(text_col).is_null().to_pylist(), strict=True)):
                    spans = _spans(part.column("_ranges"), i, length)
                    texts.append(None if null else kept_bytes(text, spans).decode("utf-8", "ignore"))
                    removed.append(sum(b - a for a, b in spans))
                columns = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=schema.names)

    return _with_ranges(df.select(*own), text_col, length).select(*own, "_ranges").mapInArrow(run, schema)
