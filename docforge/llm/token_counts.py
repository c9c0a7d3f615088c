"""Token counts that follow edits.

A document is cut at pre-token borders into leaves of ``LEAF`` pre-tokens; a
segment tree holds the token sum and the length of every subtree.  An edit
finds its leaves by descending on length, re-encodes only those leaves with a
few characters of context on either side and updates the sums on their paths.

Why the context suffices: the pattern looks at most three characters past the
end of a pre-token and never looks back, so a pre-token that ends more than
three characters before an edit cannot change, and from any old border behind
the edit that is a border again the old pre-tokens follow unchanged.

Edge cases: a null text counts as empty with zero tokens; edits may insert,
delete or replace, touch each other, and lie at either end; texts of any
length are held whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Encoder, encoder
from .common import map_slices

LEAF, CONTEXT = 64, 3
Edit = tuple[int, int, str]
#: What the registered query scrubs: addresses, telephone-like numbers and key-like secrets, each a fixed public shape.
SCRUB = (
    (regex.compile(r"[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"), "<address>"),
    (regex.compile(r"\+?\d[\d ()-]{7,}\d"), "<number>"),
    (regex.compile(r"\b(?=[A-Za-z]*\d)[A-Za-z0-9_-]{20,}+"), "<secret>"),
)


class CountTree:
    """Token count of one text under edits.  ``reencoded`` counts the pre-tokens encoded since it was built."""

    def __init__(self, text: str, enc: Encoder):
        self.enc = enc
        self._build([p for block in enc.pieces(text) for p in block])
        self.reencoded = 0

    def _build(self, pieces: list[str]) -> None:
        self.n_pieces = len(pieces)
        self.leaves = ["".join(pieces[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [""]
        counts = self._counts(pieces)
        n = len(self.leaves)
        self.size = 1 << (n - 1).bit_length()
        self.tokens, self.chars = np.zeros((2, 2 * self.size), np.int64)
        if len(counts):
            self.tokens[self.size : self.size + n] = np.add.reduceat(counts, np.arange(0, len(counts), LEAF))
        self.chars[self.size : self.size + n] = [len(x) for x in self.leaves]
        for tree in (self.tokens, self.chars):
            level = self.size
            while level > 1:
                half = level >> 1
                tree[half:level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level = half

    def _counts(self, pieces: list[str]) -> np.ndarray:
        get = self.enc.memo.__getitem__
        return np.fromiter(map(len, map(get, pieces)), np.int64, len(pieces)) >> 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """(leaf, its first character) that holds a character, or the last leaf."""
        i, at = 1, 0
        while i < self.size:
            left = int(self.chars[2 * i])
            if char - at < left or not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                at += left
                i = 2 * i + 1
        return i - self.size, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.size
        self.tokens[i], self.chars[i] = tokens, len(text)
        i >>= 1
        while i:
            for tree in (self.tokens, self.chars):
                tree[i] = tree[2 * i] + tree[2 * i + 1]
            i >>= 1

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters start..end by ``new``."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError(f"edit {start}..{end} is outside the text")
        first, at = self._leaf_at(max(0, start - CONTEXT))
        last, last_at = self._leaf_at(end)
        old = "".join(self.leaves[first : last + 1])
        text = old[: start - at] + new + old[end - at :]
        while True:
            after = ""
            follow = last + 1
            while follow < len(self.leaves) and len(after) <= CONTEXT:
                after += self.leaves[follow]
                follow += 1
            pieces, length = [], 0
            for block in self.enc.pieces(text + after):
                for piece in block:
                    if length < len(text):
                        pieces.append(piece)
                        length += len(piece)
            if length == len(text):
                break
            last += 1  # the old border is none any more: take the next leaf in
            text += self.leaves[last]
        self.reencoded += len(pieces)
        self._set(first, text, int(self._counts(pieces).sum()))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "", 0)
        if len(text) > 64 * LEAF * 8 and len(pieces) > 64 * LEAF:
            spent = self.reencoded
            self._build([p for block in self.enc.pieces(self.text()) for p in block])
            self.reencoded = spent + self.n_pieces


def scrub_edits(text: str) -> list[Edit]:
    """Edits, in text order and without overlap, that replace what SCRUB finds (earlier patterns first)."""
    found: list[Edit] = []
    for pattern, new in SCRUB:
        for m in pattern.finditer(text):
            if all(m.end() <= a or b <= m.start() for a, b, _ in found):
                found.append((m.start(), m.end(), new))
    return sorted(found)


def count_edited(df: DataFrame, edits: Callable[[str], list[Edit]], id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id, n_tokens, n_edits, n_tokens_edited, n_pieces, n_reencoded`` for every row.

    ``edits`` gives a text's edits in order, without overlap, in offsets of the
    unedited text; each is applied to the tree, never to a fresh encoding.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "n_edits", "n_tokens_edited", "n_pieces", "n_reencoded"]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, enc = [], encoder(path)
        for text in part.column(1).to_pylist():
            tree = CountTree(text or "", enc)
            before, shift, todo = tree.total, 0, edits(text or "")
            for start, end, new in todo:
                tree.edit(start + shift, end + shift, new)
                shift += len(new) - (end - start)
            rows.append((before, len(todo), tree.total, tree.n_pieces, tree.reencoded))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *names])

    return map_slices(df.select(id_col, df[text_col].alias("_text")), "_text", f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names), work)
