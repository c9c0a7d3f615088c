"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector component becomes the integer ``floor(scale * x)``; a dimension is a
term and its non-zero components are its postings.  Queries and rows are dealt
by hash into blocks of bounded size, and every block of queries meets every
block of rows in one tile; neither is collected or broadcast.  A tile lays out
the postings of each term of some rows at a time, and for term after term
scatters the weighted postings of the queries that hold it into a dense score
array.  Partition selection then keeps each query's best k of the tile, and the
partial lists of all tiles merge by one ranked window.

Scores are exact 64-bit integers; ties go to the smaller id.

Edge cases: a vector that is null, or holds a null or a component that is not
finite, takes no part; vectors of another length than a query's share their
leading terms only; a query is not its own candidate (rows with its id are
left out); rows without an id take no part; fewer than k candidates give all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, K = 1024, 10
#: Queries and rows of a tile, on average, and rows of one score array.
QUERY_BLOCK, TILE_ROWS, ROW_BLOCK = 2048, 16384, 256


def integer_vector(c: Column, scale: int = SCALE) -> Column:
    return F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(c: Column) -> Column:
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return c.isNotNull() & F.coalesce(whole, F.lit(False))


def prepared(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vec_col), scale).alias("v"))


def postings(rows: np.ndarray, value: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(term, row numbers, values) of the non-zero components, term after term."""
    keep = value != 0
    rows, value, term = rows[keep], value[keep], term[keep]
    order = np.argsort(term, kind="stable")
    rows, value, term = rows[order], value[order], term[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    for r, v, t in zip(np.split(rows, cuts), np.split(value, cuts), np.split(term, cuts), strict=True):
        if len(t):
            yield int(t[0]), r, v


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, value and term of every component."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    return row, value, np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)


class QueryBlock:
    """Ids of a block of queries, and of each term the queries that hold it with their weights."""

    def __init__(self, ids: np.ndarray, lists: pa.Array):
        self.ids = ids
        self.terms = {t: (q, w) for t, q, w in postings(*flat(lists))}

    def best(self, ids: np.ndarray, lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, candidate and score of each query's best k among these rows."""
        scores = np.zeros((len(ids), len(self.ids)), np.int64)
        for term, rows, values in postings(*flat(lists)):
            if term in self.terms:
                queries, weights = self.terms[term]
                whole = len(queries) == len(self.ids)
                if whole and len(rows) == len(ids):
                    scores += values[:, None] * weights
                elif whole:
                    scores[rows] += values[:, None] * weights
                else:
                    scores[rows[:, None], queries] += values[:, None] * weights
        scores = scores.T
        other = ids[None, :] != self.ids[:, None]
        scores = np.where(other, scores, np.iinfo(np.int64).min)
        if len(ids) > k:
            bar = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            q, c = np.nonzero((scores >= bar[:, None]) & other)
        else:
            q, c = np.nonzero(other)
        got = scores[q, c]
        order = np.lexsort((ids[c], -got, q))
        q, c, got = q[order], c[order], got[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        return self.ids[q[keep]], ids[c[keep]], got[keep]


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of every query."""
    cand, asked = prepared(rows, id_col, vec_col, scale), prepared(queries, id_col, vec_col, scale)
    wide, high = (max(1, -(-df.count() // most)) for df, most in ((asked, query_block), (cand, tile_rows)))

    def dealt(own: int, other: int) -> tuple[Column, Column]:
        """The block of a row and every block of the other side."""
        return F.pmod(F.xxhash64("id", "v"), F.lit(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))

    block, each = dealt(high, wide)
    tiles = cand.select("id", "v", F.lit(1).alias("side"), block.alias("down"), each.alias("across"))
    block, each = dealt(wide, high)
    tiles = tiles.unionByName(asked.select("id", "v", F.lit(0).alias("side"), each.alias("down"), block.alias("across")))
    tiles = tiles.select((F.col("across") * high + F.col("down")).alias("tile"), "side", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked_of, block, kept = None, [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge(kept, k)], names=["query_id", "vec_id", "score"])
                kept.clear()

        for batch in batches:
            at, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            change = np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1
            for start, end in zip(np.r_[0, change].tolist(), np.r_[change, len(at)].tolist(), strict=True):
                if start == end:
                    continue
                if at[start] != tile:
                    yield from flush()
                    tile, asked_of, block = at[start], [], None
                part = batch.slice(start, end - start)
                if not side[start]:  # queries come first
                    asked_of.append(part)
                    continue
                if block is None and asked_of:
                    whole = pa.Table.from_batches(asked_of).combine_chunks()
                    block = QueryBlock(whole["id"].to_numpy(), whole["v"].combine_chunks())
                for first in range(0, part.num_rows if block else 0, ROW_BLOCK):
                    some = part.slice(first, ROW_BLOCK)
                    kept.append(block.best(some.column("id").to_numpy(), some.column("v"), k))
                    if len(kept) >= 16:
                        kept[:] = [merge(kept, k)]
        yield from flush()

    best = tiles.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return best.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merge(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    q, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], s[keep]
