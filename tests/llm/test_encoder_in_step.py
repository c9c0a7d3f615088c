"""The encoder of many pre-tokens in step against the encoder of one."""

import random

import numpy as np
import public_tokenizers

from docforge.llm import bpe


def fresh():
    return bpe.Encoder(public_tokenizers.path(bpe.RANK_FILE), public_tokenizers.PATTERN)


def test_words_known_without_their_marks_are_not_encoded_again(monkeypatch):
    enc, asked, encode = fresh(), [], bpe.Encoder.encode_pieces
    monkeypatch.setattr(bpe.Encoder, "encode_pieces", lambda self, pieces: asked.extend(pieces) or encode(self, pieces))
    first = enc.encode("Und retionreon onshrewh.").tolist()
    asked.clear()
    again = enc.encode("Und retionreon. onshrewh").tolist()
    assert b" retionreon" not in asked and b" onshrewh" not in asked
    assert first == fresh().encode("Und retionreon onshrewh.").tolist() and again == fresh().encode("Und retionreon. onshrewh").tolist()


def test_in_step_equals_one_by_one(monkeypatch):
    enc, rng = fresh(), random.Random(3)
    pieces = [b"", *(bytes(rng.choice(b"aeinrst \xc3\xa9\xff\x00.0") for _ in range(rng.randint(1, 40))) for _ in range(3000))]
    got = enc.encode_pieces(pieces)
    assert got[0] == b"" and got[1:] == [np.array(enc.encode_piece(p), np.int32).tobytes() for p in pieces[1:]]
    left, right = (np.array([rng.randrange(len(enc.vocab)) for _ in range(3000)]) for _ in range(2))
    assert enc._borders_hold(left, right).tolist() == [enc._border_holds(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]


def test_table_finds_all_keys_and_no_others():
    keys = np.arange(0, 3000, 3)
    table = bpe.Table(keys, keys * 2)
    assert table.get(np.arange(3001)).tolist() == [2 * k if k % 3 == 0 and k < 3000 else bpe.NONE for k in range(3001)]
