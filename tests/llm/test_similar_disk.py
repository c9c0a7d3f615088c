"""What the near-duplicate stage leaves on disk, and its rarest shingles in passes against a plain count."""

import os
import random
import time
from collections import Counter
from urllib.parse import urlparse

import pytest

from docforge.llm import common, similar

K = 5


def words(rng, n):
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("klmnop") * rng.randint(1, 3) for _ in range(n)]


def families(rng, n):
    line, out = words(rng, 30), []  # a passage that all have
    for i in range(n):
        base = words(rng, 200)
        for _ in range(3):
            v = list(base)
            v[rng.randrange(200)] = "zz"
            out.append((10 * i + len(out) % 3, " ".join(v + line)))
    return out


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getPath(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def stored(spark):
    top = urlparse(common.shared_dir(spark)).path
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs)


def test_a_step_leaves_neither_its_shuffles_nor_tables_that_are_read_no_more(spark):
    texts = families(random.Random(21), 60)
    df = spark.createDataFrame(texts, "node long, text string").repartition(2).cache()
    df.count()
    had, kept = shuffled(spark), stored(spark)
    before = spark.conf.get(common.TIDY, None)
    groups = similar.similar_groups(df, "node")
    assert groups.count() == 120 and spark.conf.get(common.TIDY, None) == before
    for _ in range(40):  # files go in the background
        left = sum(n for f, n in shuffled(spark).items() if f not in had)
        if left < 100_000:
            break
        time.sleep(0.25)
    assert left < 100_000
    assert stored(spark) - kept < 400_000


@pytest.mark.parametrize("passes", [1, 3])
def test_rarest_shingles_are_those_of_a_plain_count(spark, passes):
    texts = families(random.Random(22), 12) + [(900, "two words"), (901, "Two  WORDS"), (902, "other")]
    sets = {n: similar.shingle_set(t.encode(), K).view("i8").tolist() for n, t in texts}
    often = Counter(x for s in sets.values() for x in s)
    want = {(x, n, len(s)) for n, s in sets.items() for x in sorted(s, key=lambda x: (often[x], x))[: len(s) // 5 + 1] if often[x] > 1}
    df = spark.createDataFrame(texts, "node long, text string")
    prints = spark.createDataFrame([(n, len(s)) for n, s in sets.items()], "node long, size int")
    got = similar.rare_first(similar.pressed(df, "node", "text"), prints, K, passes)
    rows = [tuple(r) for r in got.select("shingle", "node", "size").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and want
