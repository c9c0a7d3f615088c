"""Thresholds follow the labelled rows' own share of toxic ones, whatever the sample for fitting."""

import random
import zlib

import numpy as np

from docforge.llm import toxicity
from docforge.llm.decontam import words


def best_f1(logit, label):
    return max(f1(logit, label, t) for t in logit)


def f1(logit, label, bar):
    said = logit >= bar
    return 2 * (said & (label == 1)).sum() / (said.sum() + label.sum())


def test_all_rows_kept_out_set_the_thresholds(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 150)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 150)
    monkeypatch.setattr(toxicity, "MAX_CHARS", 400)
    rng, rows = random.Random(5), []
    common = ["".join(rng.choice("aeilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    for i in range(6000):
        bad = i % 12 == 0
        w = [rng.choice(common) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.choice([1, 2, 3]) if bad else rng.choice([0] * 6 + [1])):
            w.insert(rng.randrange(len(w)), rng.choice(["grobian", "wicht", "schuft", "lump", "tor"]))
        rows.append((i, " ".join(w), "de" if i % 2 else "en", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 3]
    assert any(len(r[1]) > 400 for r in kept)
    scorer = toxicity.Scorer(model)
    features, tongue = scorer.maxima([words(r[1].encode()) for r in kept])
    logit, label = features @ model.out + model.shift, np.array([r[3] for r in kept])
    for i, bar in enumerate(model.bar):
        own = tongue.argmax(axis=1) == i
        if label[own].sum() >= 5:
            assert f1(logit[own], label[own], bar) >= best_f1(logit[own], label[own]) - 0.01
