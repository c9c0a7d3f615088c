"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words of an item are runs of letters, digits and non-ASCII bytes after
lower-casing A-Z; every run of ``window`` words is a pattern (a shorter item is
one pattern).  Texts and patterns are written as their words between single
spaces, so a byte match of a pattern with its outer spaces is a match of words.

Wu-Manber: with ``m`` the shortest pattern of a length class, the block of
bytes that ends at place ``m`` of the search window is looked up in a table of
hashed blocks.  Its shift says how far the window may move without missing a
pattern; a shift of zero selects the bucket of patterns whose first ``m`` bytes
end in such a block, and direct comparison confirms an occurrence.  Many
windows advance at once as lanes of a numpy vector, each over its own stretch
of the joined texts, so no byte is handled by Python code.  Patterns are put
into classes by length, for a short one would shorten every shift.

Benchmarks larger than ``chunk_bytes`` are searched chunk by chunk, so the
broadcast tables are bounded; every chunk passes over the texts and none is
dropped.  The texts never shuffle.

Edge cases: null or wordless texts have no words; an item without words is
never found; several items may share a pattern; equal items each count; the
windows of an item without an id count as hits, but it is not among the items.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialised, text_slices

WINDOW = 8
CHUNK_BYTES = 8 << 20
#: Bytes of a block, and bits of the shift table.
BLOCK, BITS = 8, 20
#: Least m of each length class.
CLASSES = (1, 12, 24, 40)
LANE = 2048
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(KEEP).split()


def item_patterns(item: bytes, window: int = WINDOW) -> list[bytes]:
    w = words(item)
    return [b" %s " % b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


class LengthClass:
    """Shift table and buckets of the patterns of one length class."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        self.table = np.full(1 << BITS, self.m - self.block + 1, np.uint8 if self.m < 256 else np.uint16)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        for end in range(self.block, self.m + 1):
            at = self.slots(np.ascontiguousarray(heads[:, end - self.block : end]))
            np.minimum.at(self.table, at, self.m - end)
        self.buckets: dict[int, list[bytes]] = defaultdict(list)
        for slot, p in zip(self.slots(np.ascontiguousarray(heads[:, self.m - self.block :])).tolist(), patterns, strict=True):
            self.buckets[slot].append(p)
        self.buckets = dict(self.buckets)
        # a candidate's whole head is compared by its hash before Python sees it
        self.head_hashes = np.unique(self.hash_heads(heads))

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        value = np.zeros(len(blocks), np.uint64)
        for k in range(self.block):
            value |= blocks[:, k].astype(np.uint64) << np.uint64(8 * k)
        return self.slot_of(value)

    @staticmethod
    def slot_of(value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    @staticmethod
    def hash_heads(heads: np.ndarray) -> np.ndarray:
        h = np.zeros(len(heads), np.uint64)
        for k in range(heads.shape[1]):
            h = (h ^ heads[:, k].astype(np.uint64)) * np.uint64(0x100000001B3)
        return h

    def candidates(self, text: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Starts at which the head of some pattern may stand; value: the 8 bytes from every place."""
        last = len(text) - self.m  # the last start
        if last < 0:
            return np.empty(0, np.int64)
        mask = np.uint64((1 << (8 * self.block)) - 1)
        at = np.arange(0, last + 1, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, last + 1)
        found = []
        while len(at):
            slot = self.slot_of(value[at + (self.m - self.block)] & mask)
            shift = self.table[slot].astype(np.int64)
            zero = shift == 0
            if zero.any():
                found.append(at[zero])
                shift[zero] = 1
            at = at + shift
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not found:
            return np.empty(0, np.int64)
        starts = np.concatenate(found)
        heads = np.lib.stride_tricks.sliding_window_view(text, self.m)
        keep = [starts[i : i + 65536][np.isin(self.hash_heads(heads[starts[i : i + 65536]]), self.head_hashes)] for i in range(0, len(starts), 65536)]
        return np.concatenate(keep)


class Matcher:
    """All patterns of one chunk of a benchmark."""

    def __init__(self, patterns: list[bytes]):
        groups = defaultdict(list)
        for p in dict.fromkeys(patterns):
            groups[max(c for c in CLASSES if c <= max(len(p), CLASSES[0]))].append(p)
        self.classes = [LengthClass(g) for g in groups.values()]

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence, overlapping ones too."""
        if not self.classes or not text:
            return
        padded = np.frombuffer(text + bytes(8), np.uint8)
        flat = padded[: len(text)]
        value = np.ndarray((len(text),), np.dtype("<u8"), padded, strides=(1,))
        for group in self.classes:
            for start in group.candidates(flat, value).tolist():
                end = start + group.m
                block = int.from_bytes(text[end - group.block : end], "little")
                slot = (block * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - BITS)
                for p in group.buckets.get(slot, ()):
                    if text.startswith(p, start):
                        yield start, p


def pattern_chunks(benchmark: DataFrame, id_col: str, text_col: str, window: int, chunk_bytes: int) -> Iterator[dict[bytes, list[str | None]]]:
    """pattern -> item ids, in chunks of bounded size; items reach the driver one partition at a time."""
    chunk: dict[bytes, list[str | None]] = defaultdict(list)
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        for p in item_patterns(row.t.encode(), window):
            chunk[p].append(row.i)
            size += len(p) + 64
            if size > chunk_bytes:
                yield dict(chunk)
                chunk, size = defaultdict(list), 0
    yield dict(chunk)


def _scan(column: pa.Array, matcher: Matcher, owners: dict[bytes, list[str | None]]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, and of each row the hit word ranges and the items found."""
    texts = [words(t) for t in as_bytes(column)]
    counts = [len(w) for w in texts]
    joined = [b" ".join(w) for w in texts]
    starts = np.cumsum([0] + [len(j) + 2 for j in joined])  # each text stands between a space and a space
    flat = b"".join(b" %s " % j for j in joined)
    # every word follows one space, and a text ends with one
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    opens = np.searchsorted(spaces, starts[:-1])
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for start, p in matcher.search(flat):
        row = int(np.searchsorted(starts, start, "right")) - 1
        if start + len(p) > starts[row + 1]:
            continue  # across two texts
        first = int(np.searchsorted(spaces, start) - opens[row])
        ranges[row].append((first, first + p.count(b" ") - 1))
        items[row].update(i for i in owners[p] if i is not None)
    return counts, ranges, items


def find_overlaps(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of ``df`` and ``n_words``, ``hits array<struct<start,end>>`` (word ranges, end exclusive), ``items array<string>``.

    Columns of ``df`` with these names are replaced.  One narrow pass for each
    chunk of the benchmark; between two passes the rows are written out.
    """
    own = [c for c in df.columns if c not in ("n_words", "hits", "items")]
    out = df.select(*own, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    sc, schema = df.sparkSession.sparkContext, out.schema
    sent = text_col if text_col in own else "_text"  # a text is sent once
    for k, chunk in enumerate(pattern_chunks(benchmark, item_id, item_text, window, chunk_bytes)):
        shared = sc.broadcast((Matcher(list(chunk)), chunk))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher, owners = shared.value
            for batch in batches:
                for part in text_slices(batch, sent):
                    counts, ranges, items = _scan(part.column(sent), matcher, owners)
                    before = part.column("hits").to_pylist()
                    known = part.column("items").to_pylist()
                    hits = [[*a, *({"start": x, "end": y} for x, y in dict.fromkeys(b))] for a, b in zip(before, ranges, strict=True)]
                    both = [sorted({*a, *b}) for a, b in zip(known, items, strict=True)]
                    kept = [part.column(c) for c in own]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(both, pa.list_(pa.string()))], names=[*own, "n_words", "hits", "items"])

        rows = materialised(out) if k else out
        out = (rows if sent == text_col else rows.withColumn("_text", F.col(text_col))).mapInArrow(run, schema)
    return out


def digest(df: DataFrame, id_col: str = "doc_id", least_items: int = 2) -> DataFrame:
    """Per-row report from the columns of ``find_overlaps``; word ranges are united natively."""
    ordered = "array_sort(hits)"
    covered = f"aggregate({ordered}, named_struct('n', 0L, 'to', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.end - greatest(s.to, x.start)), 'to', greatest(s.to, x.end)), s -> s.n)"
    return df.select(
        F.col(id_col),
        "n_words",
        F.expr(covered).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """What ``digest`` must give for one text, by plain comparison of words."""
    doc = words((text or "").encode())
    hit, found = set(), set()
    for item_id, item in items:
        w = words((item or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for j in range(len(doc) - len(part) + 1):
                if doc[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item_id)
    ids = sorted(found)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2
