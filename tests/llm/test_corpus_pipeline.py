"""Every stage on its own input, against what it must keep."""

import random

import pytest

import corpus_pipeline as cp
from docforge.llm import decontam, suffix_dedup

COLS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], COLS)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_near_duplicates_against_jaccard(spark):
    rng, rows, copies = random.Random(1), [], set()
    for i in range(40):
        w = sentence(rng, 120).split()
        rows.append((10 * i, " ".join(w)))
        for j in (1, 2):
            v = list(w)
            for _ in range(j):
                v[rng.randrange(len(v))] = "edit"
            rows.append((10 * i + j, " ".join(v)))
            copies.add(10 * i + j)
        rows.append((10 * i + 5, sentence(rng, 120)))
    odd = [(None, rows[0][1]), (0, rows[0][1]), (2000, None), (2001, None), (2002, ""), (None, "alone without id"), (2003, "two words"), (2004, "two words")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in cp.near_duplicates(spark, frame(spark, rows + odd), SF).collect())
    ids = [i for i, _ in got]
    assert len(set(got)) == len(got) and not copies & set(ids)
    assert {i for i, _ in rows} - copies <= set(ids) and -1 in ids and 2003 in ids and 2004 not in ids


def test_contaminated(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(2)
    rows = [(i, sentence(rng, 60)) for i in range(20)] + [(100 + k, sentence(rng, 20) + " " + t + " " + sentence(rng, 5)) for k, (_, t) in enumerate(items[:10])] + [(200, None), (None, "")]
    kept = [r.doc_id for r in cp.contaminated(spark, frame(spark, rows), SF).collect()]
    want = [i for i, t in rows if not decontam.brute_force(t, [(str(k), x) for k, x in items])[2]]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_repeated_strings(spark):
    rng = random.Random(3)
    passage = sentence(rng, 70)
    rows = [(1, "before " + passage + " after"), (2, passage), (3, sentence(rng, 50)), (4, None), (5, "é" * 300)]
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.repeated_strings(spark, frame(spark, rows), SF).collect()}
    assert got[1][0] == "before  after" or len(got[1][0]) < 20
    assert got[2] == ("", 0) and got[3][0] == rows[2][1] and got[4][0] is None and got[5] == ("", 0)
    assert suffix_dedup.united([(0, 3), (5, 5)], 4) == [(0, 9)]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_nothing(spark, k):
    name, stage = cp.STAGES[k]
    assert stage(spark, frame(spark, [(1, "x")]).where("false"), SF).count() == 0


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cp.run(spark, SF)
    assert 0 < out.count() <= docs.count() and out.columns[0] == "doc_id" and out.where("doc_id is null").count() == 0
