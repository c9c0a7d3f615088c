"""Near-duplicate groups against brute force over whole shingle sets."""

import random

import corpus_pipeline as cp
from docforge.llm import similar

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def planted(rng, n, low, high):
    """A text and a copy with words changed, of a similarity within the bounds."""
    while True:
        a = words(rng, n)
        b = list(a)
        while True:
            b[rng.randrange(n)] = "".join(rng.choice("stuvwxyz") for _ in range(6))
            s = similarity(" ".join(a), " ".join(b))
            if s < high:
                break
        if s >= low:
            return " ".join(a), " ".join(b)


def similarity(a, b):
    a, b = (set(similar.shingle_set(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def kept(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return {r.doc_id for r in cp.near_duplicates(spark, spark.createDataFrame(rows, COLS), "").collect()}


def test_no_pair_at_0_80_to_0_85_is_missed(spark):
    rng = random.Random(11)
    texts = [t for n in (60, 150, 400, 1200) for _ in range(15) for t in planted(rng, n, 0.8, 0.85)]
    assert kept(spark, texts) == set(range(0, len(texts), 2))


def test_no_pair_below_0_8_is_linked(spark):
    rng = random.Random(12)
    texts = [t for n in (60, 150, 400, 1200) for _ in range(15) for t in planted(rng, n, 0.7, 0.79)]
    assert kept(spark, texts) == set(range(len(texts)))


def test_groups_are_components_of_the_exact_relation(spark):
    rng, texts = random.Random(13), ["two words", "Two  WORDS", "two other", ""]
    line = words(rng, 12)  # a line that all families share
    for _ in range(6):
        base = words(rng, 120) + line
        texts.append(" ".join(base))
        for _ in range(8):
            v = list(base)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(len(v))] = rng.choice("stuvwxyz") * 5
            texts.append(" ".join(v))
    sets = [set(similar.shingle_set(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {min(i for i in range(len(texts)) if root[i] == r) for r in set(root)}
    assert len(groups) < len(texts) - 10 and kept(spark, texts) == groups
