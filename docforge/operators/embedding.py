"""Embedding, assembly of embedded chunks and vector search."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.control import RateLimiter, Retry
from ..functions.vectors import cosine

BATCH = 10
#: Rows and queries of a tile, queries that are multiplied at once, tasks that tiles go to.
BLOCK_ROWS, BLOCK_QUERIES, ASKED_AT_ONCE, MOST_TASKS = 1 << 14, 1 << 12, 128, 2000
#: Norms between which a matrix product is near to the cosine, and how near.
LEAST_NORM, MOST_NORM, MARGIN = 1e-100, 1e100, 1e-9


class EmbeddingProvider(Protocol):
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Deterministic offline vectors: hashed character trigrams, signed, of unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dimensions
        for i in range(max(1, len(text) - 2)):
            h = zlib.crc32(text[i : i + 3].encode())
            v[h % self.dimensions] += 1.0 if h & 0x8000_0000 else -1.0
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else v


def embedder(provider: EmbeddingProvider, batch: int = BATCH, qps: float | None = None, retry: Retry | None = None) -> Callable[[Column], Column]:
    """A Column function that embeds texts in batches.

    One call takes one permit of the task's share of ``qps``, is retried, and must
    give vectors of the provider's size in the order of its texts; a null text
    has a null vector.
    """

    @F.arrow_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        limiter = RateLimiter(qps) if qps else None
        tries = retry or Retry()
        for s in batches:
            texts = s.drop_null()
            out = [np.zeros(0, np.float32)]
            for at in range(0, len(texts), batch):
                part = texts.slice(at, batch).to_pylist()
                if limiter:
                    limiter.acquire()
                got = tries.run(lambda part=part: provider.embed_batch(part))
                if len(got) != len(part) or any(len(v) != provider.dimensions for v in got):
                    raise ValueError("EMBED_003: the provider gave vectors of another number or size")
                out.append(np.asarray(got, np.float32).ravel())
            known = s.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(known * provider.dimensions)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)), mask=pa.array(~known))

    return run


def embedded_chunks(chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """``id, text, embedding, documentId, metadata``: metadata leaves out what is null."""
    pairs = [(k, F.col(k).cast("string")) for k in ("sectionTitle", "sectionLevel", "startPage", "sourcePath") if k in chunks.columns]
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull())
    return chunks.select("id", "text", embed(F.col("text")).alias("embedding"), "documentId", F.map_from_entries(entries).alias("metadata"))


def top_k(rows: DataFrame, query: list[float], k: int, vec_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one query by cosine distance, as one top-k node without a full sort."""
    distance = 1 - cosine(F.col(vec_col), F.array(*(F.lit(float(x)) for x in query)))
    return rows.withColumn("distance", distance).orderBy("distance", "id").limit(k)


def _plain_cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """``cosine`` of vectors of one size, summed in the order of the Column expression."""

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(a.shape[:1], b.shape[:1]))
        for i in range(a.shape[1]):
            out = out + a[:, i] * b[:, i]
        return out

    with np.errstate(all="ignore"):
        size = np.sqrt(dot(rows, rows)) * np.sqrt(dot(query, query))
        return np.where(size == 0, 0.0, dot(rows, query) / np.where(size == 0, 1.0, size))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Sizes (null: -1); which are null or hold a null; by size, places and vectors of the others."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    at = np.repeat(np.arange(len(column)), sizes)
    null = column.is_null().to_numpy(zero_copy_only=False)
    void = null.copy()
    void[at[values.is_null().to_numpy(zero_copy_only=False)]] = True
    flat, start = values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    known = {}
    for n in np.unique(sizes[~void]):
        places = np.flatnonzero((sizes == n) & ~void)
        known[int(n)] = (places, flat[start[places][:, None] + np.arange(n)])
    return np.where(null, -1, sizes), void, known


def _best(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """``query_id, id, similarity``: for each query of a tile what can be among its k best of the tile's rows."""
    rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_start"))  # of equal rows the first by id stay
    sizes, void, known = _vectors(rows["v"])
    q_sizes, q_void, asked = _vectors(queries["v"])
    whose, which, score = [], [], []

    def keep(query: int, places: np.ndarray, similar: np.ndarray) -> None:
        order = np.lexsort((places, -similar, ~np.isnan(similar)))[:k]
        whose.append(np.full(len(order), query))
        which.append(places[order])
        score.append(pa.array(similar[order]))

    def nulls(query: int, places: np.ndarray) -> None:
        whose.append(np.full(len(places[:k]), query))
        which.append(places[:k])
        score.append(pa.nulls(len(places[:k]), pa.float64()))

    for q in np.flatnonzero(q_void):
        same = (sizes == -1) | (sizes == q_sizes[q]) | (q_sizes[q] == -1)
        other = np.flatnonzero(~same)[:k]
        keep(q, other, np.zeros(len(other)))
        nulls(q, np.flatnonzero(same))
    for n, (q_places, q_vectors) in asked.items():
        other, none = np.flatnonzero((sizes != n) & (sizes != -1))[:k], np.flatnonzero((sizes == -1) | ((sizes == n) & void))[:k]
        places, vectors = known.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
        with np.errstate(all="ignore"):
            norm, q_norm = np.sqrt((vectors**2).sum(axis=1)), np.sqrt((q_vectors**2).sum(axis=1))
        common, usual = (norm > LEAST_NORM) & (norm < MOST_NORM), (q_norm > LEAST_NORM) & (q_norm < MOST_NORM)
        rare, unit = np.flatnonzero(~common), vectors[common] / norm[common][:, None]
        common = np.flatnonzero(common)
        for at in range(0, len(q_places), ASKED_AT_ONCE):
            part = np.arange(at, min(at + ASKED_AT_ONCE, len(q_places)))
            with np.errstate(all="ignore"):
                near = (q_vectors[part] / q_norm[part][:, None]) @ unit.T if len(common) > k else None
            for row, i in enumerate(part):
                if near is None or not usual[i]:
                    found = np.arange(len(places))
                else:
                    # the product may be off in its last digits: what comes near the k-th is computed again
                    least = np.partition(near[row], len(common) - k)[len(common) - k] - MARGIN
                    found = np.concatenate([common[near[row] >= least], rare])
                similar = _plain_cosine(vectors[found], q_vectors[i : i + 1])
                keep(q_places[i], np.concatenate([places[found], other]), np.concatenate([similar, np.zeros(len(other))]))
                nulls(q_places[i], none)
    index = pa.array(np.concatenate([np.zeros(0, np.int64), *whose]).astype(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *which]).astype(np.int64))
    return pa.Table.from_arrays([queries["id"].take(index[0]), rows["id"].take(index[1]), pa.chunked_array(score, pa.float64())], names=["query_id", "id", "similarity"])


def top_k_per_query(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query") -> DataFrame:
    """``query_id, id, similarity, rank``: every query meets every row, in tiles of a block of each.

    A tile finds the k best of its rows by a matrix product and computes their
    similarity as ``cosine`` does; a window ranks what the tiles leave.
    """
    n_rows, n_queries = (-(-df.count() // n) or 1 for df, n in ((rows, BLOCK_ROWS), (queries, BLOCK_QUERIES)))

    def dealt(df: DataFrame, name: str, vec: str, mine: int, others: int, tile: Callable[[Column, Column], Column]) -> DataFrame:
        block, other = F.pmod(F.xxhash64(name), F.lit(mine)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select(F.col(name).alias("id"), F.col(vec).alias("v"), block.cast("int").alias("_b"), other.alias("_o")).select(tile(F.col("_b"), F.col("_o")).alias("tile"), "id", "v")

    left = dealt(rows, id_col, vec_col, n_rows, n_queries, lambda b, o: b * n_queries + o)
    right = dealt(queries, query_id, query_vec, n_queries, n_rows, lambda b, o: o * n_queries + b)
    tasks = min(n_rows * n_queries, MOST_TASKS)
    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, id {rows.schema[id_col].dataType.simpleString()}, similarity double"
    found = left.repartition(tasks, "tile").groupBy("tile").cogroup(right.repartition(tasks, "tile").groupBy("tile")).applyInArrow(lambda a, b: _best(a, b, k), kinds)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
