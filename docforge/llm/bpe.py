"""Byte-level BPE by backtracking over an Aho-Corasick automaton.

The byte tokens of a rank file are mapped to Latin-1 strings and put into a
pyahocorasick automaton, whose trie gives the longest token that starts at a
byte in time bounded by the longest token; the encoder walks left to right,
takes the longest token whose pair with its predecessor is *compatible* and
falls back to shorter prefixes or to the previous position when none is.  Two
adjacent tokens are compatible when the merge order of BPE would not have
joined bytes across their border; that test is memoised.  A position once found
dead is never entered again, so the work is linear in the length and the result
is the exact merge sequence.  Many pre-tokens are encoded in step: the
automaton's goto function and the merges are laid out in hash tables that numpy
looks up for all of them at once.

Edge cases: a null text counts as empty and gives no ids; special-token strings
are ordinary text; texts of any length are processed in blocks of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import CACHES, map_slices

#: Vocabulary of the registered queries.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens and token pairs that a Python worker remembers; on overflow the memo starts anew.
MEMO_PIECES, MEMO_PAIRS, PAIR_BITS = 200_000, 100_000, 20
#: Chunks of more characters are not remembered.
KEPT_CHARS = 256
#: Pre-tokens handled at once.
BLOCK = 1 << 16
NONE = -1
SEPARATOR = "\x01"
#: Stands behind a pre-token and is no byte; longer pre-tokens than LONG are encoded one by one.
END, LONG = 256, 64
#: White_Space other than space and line feed.
ODD_SPACE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks whose unknown ones are encoded together.
TOGETHER = 1 << 18


class Memo(dict):
    """chunk -> ids as int32 bytes, filled on a miss; two generations bound its size and keep what is in use."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(key) <= KEPT_CHARS:
            self.keep_all({key: value}, ())

    def keep_all(self, new: dict, needed: Iterable) -> None:
        """Keep what is new, and of an older generation what is needed now."""
        if len(self) + len(new) > self.limit:
            self.older = dict(self)
            self.clear()
            self.update((k, self.older[k]) for k in needed if k in self.older)
        self.update(new)


class Table:
    """Distinct int64 keys from 0 -> int32 values, looked up for whole arrays; open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = (2 * len(keys)).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, NONE, np.int64), np.full(1 << bits, NONE, np.int32)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == NONE
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or NONE."""
        slot = self._slots(keys)
        found, out = self.keys[slot], self.values[slot]
        other = np.flatnonzero((found != keys) & (found != NONE))
        while len(other):
            slot[other] = (slot[other] + 1) & self.last
            found = self.keys[slot[other]]
            out[other] = self.values[slot[other]]
            other = other[(found != keys[other]) & (found != NONE)]
        return out


class Encoder:
    """Encoder and decoder for one rank file (ids are ranks, single bytes all present)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # \s of the regex library also takes U+001C..U+001F, which are not White_Space
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        size = max(self.ranks.values()) + 1
        self.vocab: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.size = [len(x) for x in self.vocab]
        self.most = max(self.size)
        self.decimal = [b"%d" % i for i in range(size)]
        self.single = [np.int32(i).tobytes() for i in range(size)]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [NONE] * size  # the longest proper prefix that is a token
        for token, rank in self.ranks.items():
            for end in range(len(token) - 1, 0, -1):
                if (r := self.ranks.get(token[:end])) is not None:
                    self.shorter[rank] = r
                    break
        self.sizes, self.shorter_of = np.array(self.size), np.array(self.shorter)
        self._compatible: dict[int, bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        for rank, token in enumerate(self.vocab):
            left = self.shorter[rank] if token else NONE
            while left != NONE:
                right = self.ranks.get(token[len(self.vocab[left]) :])
                if right is not None and left < rank and right < rank and self._border_holds(left, right):
                    self.merged[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]
        left, right = np.array(list(self.merged), np.int64).reshape(-1, 2).T
        self.merges = Table(left << 24 | right, np.array(list(self.merged.values()), np.int64))
        self.left_half, self.right_half = np.array(self.halves, np.int64).T
        self._lay_out()
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, NONE), np.zeros(1 << PAIR_BITS, bool)
        self.memo = Memo(self._encode_chunk, MEMO_PIECES)

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo the merges on both sides, latest first: no earlier merge may have crossed the border."""
        bound = 1 << 62
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < bound:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            whole_left, whole_right = inner_left == left, inner_right == right
            if whole_left and whole_right:
                return True
            if whole_right or (left > right and not whole_left):
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right

    def _lay_out(self) -> None:
        """The goto function: ``goto`` has the node after a node and a byte, ``token_of`` the token that ends at a node."""
        tokens = [t for t in self.vocab if t]
        rank, size = np.flatnonzero(self.sizes), np.array(list(map(len, tokens)))
        text, start = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size
        node, open_, nodes, depth = np.zeros(len(tokens), np.int64), np.arange(len(tokens)), 1, 0
        keys, token_of = [], [np.array([NONE])]
        while len(open_):
            step, place = np.unique(node[open_] * (END + 1) + text[start[open_] + depth], return_inverse=True)
            node[open_] = nodes + place
            nodes, depth = nodes + len(step), depth + 1
            ends = np.full(len(step), NONE)
            whole = size[open_] == depth
            ends[place[whole]] = rank[open_[whole]]
            keys.append(step)
            token_of.append(ends)
            open_ = open_[~whole]
        self.goto, self.token_of = Table(np.concatenate(keys), np.arange(1, nodes)), np.concatenate(token_of)

    def _longest_all(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest token that starts at each place of an array of bytes; every stretch of bytes is followed by END."""
        best = np.full(len(at), NONE)
        lane, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(lane):
            node = self.goto.get(node * (END + 1) + text[at])
            on = np.flatnonzero(node != NONE)
            lane, node, at = lane[on], node[on].astype(np.int64), at[on] + 1
            token = self.token_of[node]
            some = np.flatnonzero(token != NONE)
            best[lane[some]] = token[some]
        return best

    def _borders_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_border_holds`` of many pairs."""
        out, lane, bound = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(lane):
            joined = self.merges.get(left << 24 | right)
            crossed = (joined != NONE) & (joined < bound)
            out[lane[crossed]] = False
            inner_left, inner_right = self.right_half[left], self.left_half[right]
            whole_left, whole_right = inner_left == left, inner_right == right
            by_left = whole_right | ((left > right) & ~whole_left)
            bound = np.where(by_left, left, right + 1)
            on = ~crossed & ~(whole_left & whole_right)
            left, right = np.where(by_left, inner_left, left)[on], np.where(by_left, right, inner_right)[on]
            lane, bound = lane[on], bound[on]
        return out

    def compatible(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= MEMO_PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self._border_holds(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, border, known, longest = len(piece), self.size, self.shorter, self.compatible, self._compatible, self._longest
        text = piece.decode("latin-1")
        dead = set()
        out: list[int] = []
        at, last, token = 0, NONE, longest(text, 0)
        while at < n:
            while token != NONE:
                end = at + size[token]
                if end not in dead:
                    if last == NONE:
                        break
                    fits = known.get(last << 24 | token)
                    if border(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token == NONE:  # a dead end: never come here again, try the previous token's prefixes
                dead.add(at)
                out.pop()
                at -= size[last]
                token = shorter[last]
                last = out[-1] if out else NONE
            else:
                out.append(token)
                at, last = end, token
                if at < n:
                    token = longest(text, at)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, as int32 bytes: ``encode_piece`` for all of them in step.

        Each round, every pre-token takes the longest token at its place if that
        fits its predecessor.  Else its shorter prefixes are tried, then those of
        the accepted tokens before it, latest first.  The sequence of fitting
        tokens for the bytes before a place is unique, so a place left behind is
        not come to again and none need be marked dead.
        """
        if not pieces:
            return []
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(length + 1) - 1
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
        text[end] = END
        stack = np.empty((len(pieces), int(length.max()) + 1), np.int32)
        stack[:, 0] = NONE
        depth, at = np.zeros(len(pieces), np.int64), end - length
        lane = np.flatnonzero(length)
        while len(lane):
            now = self._longest_all(text, at[lane])
            at[lane] += self.sizes[now]
            open_ = np.flatnonzero(~self.compatible_all(stack[lane, depth[lane]].astype(np.int64), now))
            while len(open_):
                who, last = lane[open_], now[open_]
                now[open_] = self.shorter_of[last]
                at[who] -= self.sizes[last]
                none = now[open_] == NONE
                back = who[none]  # no prefix fits: those of the token before come next
                now[open_[none]] = stack[back, depth[back]]
                depth[back] -= 1
                some = open_[~none]
                at[lane[some]] += self.sizes[now[some]]
                fits = self.compatible_all(stack[lane[some], depth[lane[some]]].astype(np.int64), now[some])
                open_ = np.concatenate([open_[none], some[~fits]])
            depth[lane] += 1
            stack[lane, depth[lane]] = now
            lane = lane[at[lane] < end[lane]]
        flat = stack[:, 1:][np.arange(stack.shape[1] - 1) < depth[:, None]].tobytes()
        ends = 4 * np.cumsum(depth)
        return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs; with nothing to the left all is.  What was found last for a slot is remembered."""
        pair = np.where(left == NONE, NONE, left << 24 | right)
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        fits = self.pair_fits[slot]
        new = np.flatnonzero((self.pair_keys[slot] != pair) & (pair != NONE))
        if len(new):
            pairs, place = np.unique(pair[new], return_inverse=True)
            fits[new] = self._borders_hold(pairs >> 24, pairs & 0xFFFFFF)[place]
            self.pair_fits[slot[new]] = fits[new]
            self.pair_keys[slot[new]] = pair[new]
        return fits | (pair == NONE)

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place: the deepest trie node there, or the nearest token above it."""
        part = text[at : at + self.most]
        depth = self.automaton.longest_prefix(part)
        while (rank := self.automaton.get(part[:depth], NONE)) == NONE:
            depth -= 1
        return rank

    def _encode_chunk(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return np.array(self.encode_piece(chunk.encode()), np.int32).tobytes()
        pieces = self.pattern.findall(chunk)
        if len(pieces) == 1:
            return np.array(self.encode_piece(chunk.encode()), np.int32).tobytes()
        return b"".join(map(self.memo.__getitem__, pieces))

    def learn(self, blocks: list[list[str]]) -> None:
        """Fill the memo with what it lacks of these chunks; very long ones are left to be encoded when met."""
        memo, older = self.memo, self.memo.older
        need: set[str] = set().union(*blocks)
        fresh = [c for c in filterfalse(memo.__contains__, need) if len(c) <= KEPT_CHARS]
        known = {c: older[c] for c in filter(older.__contains__, fresh)}
        plain, mixed = [], []
        for c in filterfalse(known.__contains__, fresh):
            (plain if c.isalpha() or c[:1] == " " and c[1:].isalpha() else mixed).append(c)
        parts = list(map(self.pattern.findall, mixed))
        todo = dict.fromkeys(plain)
        for p in {*chain.from_iterable(parts)}:
            if p not in memo and p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    todo[p] = None
        as_bytes = list(map(str.encode, todo))
        if max(map(len, as_bytes), default=0) <= LONG:
            ids = self.encode_pieces(as_bytes)
        else:
            short = iter(self.encode_pieces([b for b in as_bytes if len(b) <= LONG]))
            ids = [next(short) if len(b) <= LONG else np.array(self.encode_piece(b), np.int32).tobytes() for b in as_bytes]
        known.update(zip(todo, ids, strict=True))
        for c, pieces in zip(mixed, parts, strict=True):
            known[c] = b"".join([known[p] if p in known else memo[p] for p in pieces])
        memo.keep_all(known, need)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, in blocks."""
        if len(text) <= 4 * BLOCK:
            if text:
                yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Runs of whole pre-tokens whose borders are certain.

        No pre-token crosses a lone space or line feed between characters that
        are not white space: the space opens the next pre-token, the line feed
        is one.  A text with any other white space is cut by the pattern.
        """
        if SEPARATOR in text or any(map(text.__contains__, ODD_SPACE)) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
            yield from self.pieces(text)
        else:
            yield text.replace("\n", f"{SEPARATOR}\n{SEPARATOR}").replace(" ", f"{SEPARATOR} ").split(SEPARATOR)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; what the memo lacks is encoded together for texts of TOGETHER chunks."""
        get = self.memo.__getitem__
        done: list[bytes] = []  # of the first text held, all that is encoded
        held: list[list[str] | None] = []  # blocks of chunks; None ends a text
        size = 0

        def flush() -> Iterator[np.ndarray]:
            self.learn([b for b in held if b])
            for block in held:
                if block is not None:
                    done.append(b"".join(map(get, block)))
                else:
                    yield np.frombuffer(b"".join(done), np.int32)
                    done.clear()
            held.clear()

        for text in texts:
            for block in self.chunks(text):
                held.append(block)
                size += len(block)
                if size >= TOGETHER:
                    yield from flush()
                    size = 0
            held.append(None)
        yield from flush()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each rank file and Python worker."""
    return Encoder(path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN)


CACHES.append(encoder.cache_clear)


def encode_array(texts: pa.Array, enc: Encoder) -> list[np.ndarray]:
    return list(enc.encode_many(x or "" for x in texts.to_pylist()))


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id, ids array<int>`` for every row; null texts give an empty list."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), list_array(encode_array(part.column(1), encoder(path)))], names=[id_col, "ids"])

    return map_slices(df.select(id_col, df[text_col].alias("_text")), "_text", f"`{id_col}` {kind}, ids array<int>", work)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id, bytes binary`` for every row; null ids give empty bytes."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out = [enc.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode every text and return ``id, n_tokens, ids_sha256, decoded_sha256``.

    Both passes run over the same Arrow slice, so neither ids nor bytes cross
    to the JVM; there is no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        enc, n, ids_hash, text_hash = encoder(path), [], [], []
        for ids in enc.encode_many(text or "" for text in part.column(1).to_pylist()):
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(enc.decimals(ids)).hexdigest())
            text_hash.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(df.select(id_col, df[text_col].alias("_text")), "_text", f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
