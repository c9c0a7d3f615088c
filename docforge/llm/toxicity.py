"""Toxicity by a convolutional text classifier, trained and run in numpy.

Words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) are
embedded by hashing the word and two of its prefixes into one table, so that
unseen inflections share what was learned of their stem.  Filters of several
widths slide over the words of the whole text, each keeps its maximum, and a
logistic layer scores the maxima.

The model is fitted on the driver from a bounded sample of labelled rows
(``MAX_POSITIVE`` and ``MAX_NEGATIVE`` rows of at most ``MAX_CHARS``
characters, those with the smallest hash of their id) and only from rows whose
crc32(id) mod 4 is not 2.  Rows of remainder 3 are kept out of the gradient
and set the thresholds: one for each language, mapped to a score of 0.3.  The
sample's share of toxic rows is not that of the data, so the thresholds are set
by all labelled rows of remainder 3, of any length, which are scored in Spark
and reach the driver as counts by logit.  The language of a text is itself told
from its words; label, language column, source and id never enter a score.

For scoring, the product of the embedding table and every filter tap is laid
out once, so a text costs a gather and a sum for each word and tap; the model
has a fixed size and is broadcast.  There is no shuffle.

Edge cases: null, empty or wordless texts are scored from zero features; with
no label, or labels of one class, the score is a constant (the smoothed share
of toxic labels); without both classes at remainder 3 the sample sets the
thresholds; labels that are null or without an id are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, let_go, text_slices
from .decontam import words

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
PREFIXES = (4, 6)
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1500, 2000, 40_000
#: At least so many passes over the sample, and so many steps.
EPOCHS, STEPS, BATCH, RATE, DROP = 4, 300, 64, 0.01, 0.2
PASS = 0.3
#: Logits are counted in steps of this size, up to LOGIT_LIMIT on both sides, for thresholds.
LOGIT_STEP, LOGIT_LIMIT = 1 / 64, 60
#: Words whose windows are evaluated at once.
BLOCK = 1 << 16
#: Bytes of text whose words are held at once.
SCORED_BYTES = 1 << 20
#: Distinct words that a Python worker remembers.
MEMO_WORDS = 150_000


def bucket_rows(word: bytes) -> tuple[int, ...]:
    """Rows of the embedding table that a word sums: itself and its prefixes of whole characters."""
    text = word.decode("utf-8", "replace")
    return (zlib.crc32(word) % BUCKETS, *(zlib.crc32(b"%d:" % n + text[:n].encode("utf-8", "replace")) % BUCKETS for n in PREFIXES))


class Words(dict):
    """word -> number, with the table rows of each; starts anew when full."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, ...]] = [(0,) * (1 + len(PREFIXES))]  # number 0 is padding

    def __missing__(self, word: bytes) -> int:
        self.rows.append(bucket_rows(word))
        n = self[word] = len(self.rows) - 1
        return n


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    taps: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, DIM, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    shift: float = 0.0
    constant: float | None = None
    languages: list[str] = field(default_factory=list)
    spoken: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))  # log share of a word by language
    bar: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))  # logit that counts as PASS, by language

    def lay_out(self) -> np.ndarray:
        """(bucket, tap, filter): the embedding table times every tap."""
        return np.concatenate([np.einsum("bd,odf->bof", self.table, self.taps[w]) for w in WIDTHS], axis=1).astype(np.float32)


def stream(texts: Iterable[list[bytes]], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each followed by padding, and where each text starts."""
    pad = max(WIDTHS) - 1 or 1
    numbers, starts = [], []
    for w in texts:
        starts.append(len(numbers))
        numbers.extend(map(known.__getitem__, w))
        numbers.extend([0] * pad)
    return np.array(numbers, np.int64), np.array(starts, np.int64)


class Scorer:
    """A model laid out for scoring; remembers the summed taps of the words it has met, within a bound."""

    def __init__(self, model: Model):
        self.model, self.laid = model, model.lay_out() if model.constant is None else None
        self._forget()

    def _forget(self) -> None:
        taps = sum(WIDTHS)
        self.known = Words()
        self.done = 1
        self.vectors = np.zeros((taps, 1024, FILTERS), np.float32)
        self.said = np.zeros((1024, len(self.model.languages)), np.float32)

    def _learn(self) -> None:
        n = len(self.known.rows)
        if n > self.vectors.shape[1]:
            size = n + n // 4
            self.vectors, old = np.zeros((self.vectors.shape[0], size, FILTERS), np.float32), self.vectors
            self.vectors[:, : old.shape[1]] = old
            self.said, old = np.zeros((size, self.said.shape[1]), np.float32), self.said
            self.said[: len(old)] = old
        for at in range(self.done, n, BLOCK):
            rows = np.array(self.known.rows[at : min(n, at + BLOCK)], np.int64)
            self.vectors[:, at : at + len(rows)] = sum(self.laid[rows[:, i]] for i in range(rows.shape[1])).transpose(1, 0, 2)
            if self.said.shape[1]:
                self.said[at : at + len(rows)] = self.model.spoken[rows[:, 0]]
        self.done = n

    def maxima(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Pooled features and the language log-likelihoods of every text."""
        if len(self.known.rows) > MEMO_WORDS:
            self._forget()
        numbers, starts = stream(texts, self.known)
        self._learn()
        features = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        tongue = np.zeros((len(texts), self.said.shape[1]), np.float32)
        ends = np.append(starts[1:], len(numbers))
        pad = max(WIDTHS) - 1 or 1
        text = at = 0
        while at < len(numbers):  # blocks may begin and end within a text
            stop = min(at + BLOCK, len(numbers))
            piece = numbers[at : min(stop + pad, len(numbers))]
            last = int(np.searchsorted(starts, stop, "left")) - 1
            cuts = np.maximum(starts[text : last + 1], at) - at
            blank = piece[: stop - at] == 0
            tap = 0
            for k, width in enumerate(WIDTHS):
                value = self.vectors[tap].take(piece[: stop - at], axis=0)
                for o in range(1, width):
                    part = piece[o : o + stop - at]
                    value[: len(part)] += self.vectors[tap + o].take(part, axis=0)
                tap += width
                value[blank] = -np.inf  # a window starts at a word
                span = slice(k * FILTERS, (k + 1) * FILTERS)
                features[text : last + 1, span] = np.maximum(features[text : last + 1, span], np.maximum.reduceat(value, cuts, axis=0))
            if tongue.shape[1]:
                tongue[text : last + 1] += np.add.reduceat(self.said.take(piece[: stop - at], axis=0), cuts, axis=0)
            text = last if ends[last] > stop else last + 1
            at = stop
        return np.maximum(np.where(np.isfinite(features), features, 0) + self.model.bias, 0), tongue

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits before any language's threshold, and the number of each text's language (0 where none is known)."""
        features, tongue = self.maxima(texts)
        spoken = tongue.argmax(axis=1) if self.model.languages else np.zeros(len(texts), np.int64)
        return features @ self.model.out + self.model.shift, spoken

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        model = self.model
        if model.constant is not None:
            return np.full(len(texts), model.constant)
        logit, spoken = self.logits(texts)
        if model.languages:
            logit = logit - model.bar[spoken]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64) + np.log(PASS / (1 - PASS)), -60, 60)))


def fit(rows: list[tuple[bytes, str | None, int, bool]], seed: int = 7) -> Model:
    """Train on (text, language, label, for thresholds) rows."""
    rng, model = np.random.default_rng(seed), Model()
    labels = np.array([r[2] for r in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        model.constant = float((labels.sum() + 0.1) / (len(rows) + 1))
        return model
    texts = [words(r[0]) for r in rows]
    train = [i for i, r in enumerate(rows) if not r[3]]
    if len({labels[i] for i in train}) < 2:
        train = list(range(len(rows)))
    known = Words()
    model.table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    model.taps = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    model.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    params = {"table": model.table, "bias": model.bias, "out": model.out, "shift": np.zeros(1, np.float32)} | {f"taps{w}": model.taps[w] for w in WIDTHS}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    pad, step = max(WIDTHS) - 1 or 1, 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(train)))):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            numbers, starts = stream([texts[i] for i in batch], known)
            if DROP:
                numbers[rng.random(len(numbers)) < DROP * 0.25] = 0
            rows_of = np.array(known.rows, np.int64)
            used, local = np.unique(numbers, return_inverse=True)
            vectors = params["table"][rows_of[used]].sum(axis=1)
            vectors[used == 0] = 0
            x = vectors[local]
            x = np.concatenate([x, np.zeros((pad, DIM), np.float32)])
            ends = np.append(starts[1:], len(numbers))
            picked, raw = {}, []
            for w in WIDTHS:
                value = sum(x[o : o + len(numbers)] @ params[f"taps{w}"][o] for o in range(w))
                picked[w] = np.stack([a + value[a : max(a + 1, b - pad)].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                raw.append(np.take_along_axis(value, picked[w], axis=0))
            pooled = np.concatenate(raw, axis=1) + params["bias"]
            hidden = np.maximum(pooled, 0)
            mask = (rng.random(hidden.shape) >= DROP) / (1 - DROP)
            hidden = hidden * mask
            error = 1 / (1 + np.exp(-np.clip(hidden @ params["out"] + params["shift"], -30, 30))) - labels[batch]
            error = (error / len(batch)).astype(np.float32)
            back = error[:, None] * params["out"] * mask * (pooled > 0)
            grads = {"out": hidden.T @ error, "shift": error.sum(keepdims=True), "bias": back.sum(axis=0), "table": np.zeros_like(model.table)}
            into = np.zeros((len(used), DIM), np.float32)
            for k, w in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[f"taps{w}"] = np.zeros_like(params[f"taps{w}"])
                for o in range(w):
                    places = picked[w] + o
                    grads[f"taps{w}"][o] = np.einsum("df,dfe->ef", g, x[places])
                    inside = places < len(numbers)
                    np.add.at(into, local[places[inside]], (g[:, :, None] * params[f"taps{w}"][o].T)[inside])
            into[used == 0] = 0
            for column in range(rows_of.shape[1]):
                np.add.at(grads["table"], rows_of[used, column], into)
            step += 1
            for name, value in params.items():
                m, v = moments[name]
                m += 0.1 * (grads[name] - m)
                v += 0.001 * (grads[name] ** 2 - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.shift = float(params["shift"][0])
    calibrate(model, rows, texts, labels)
    return model


def calibrate(model: Model, rows: list[tuple[bytes, str | None, int, bool]], texts: list[list[bytes]], labels: np.ndarray) -> None:
    """Learn to tell languages, then set each language's logit threshold by the best F1 on the rows kept out."""
    languages = sorted({r[1] for r in rows if r[1]})
    logit = Scorer(model).maxima(texts)[0] @ model.out + model.shift
    kept = np.array([r[3] for r in rows])
    if len(set(labels[kept])) < 2:
        kept[:] = True
    everyone = threshold(logit[kept], labels[kept], 0.0)
    if languages:
        counts = np.full((BUCKETS, len(languages)), 0.5)
        place = {name: i for i, name in enumerate(languages)}
        for (_, language, _, _), w in zip(rows, texts, strict=True):
            if language:
                for word in set(w):
                    counts[zlib.crc32(word) % BUCKETS, place[language]] += 1
        model.languages = languages
        model.spoken = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        spoken = Scorer(model).maxima(texts)[1].argmax(axis=1)
        bars = []
        for i in range(len(languages)):
            own = kept & (spoken == i)
            bars.append(threshold(logit[own], labels[own], everyone) if labels[own].sum() >= 5 else everyone)
        model.bar = np.array(bars, np.float32)
    else:
        model.shift -= everyone


def threshold(logit: np.ndarray, label: np.ndarray, default: float) -> float:
    """The logit that divides the labels with the best F1; in the middle of its gap."""
    if not len(logit) or not label.sum():
        return default
    order = np.argsort(-logit, kind="stable")
    value, hit = logit[order], np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + label.sum())
    f1[:-1][value[:-1] == value[1:]] = -1
    best = int(f1.argmax())
    below = value[best + 1] if best + 1 < len(value) else value[best] - 1
    return float((value[best] + below) / 2)


def threshold_of_counts(rows: list[tuple[float, float, int, int]], default: float) -> float:
    """``threshold`` over (least logit, largest logit, toxic rows, all rows) of disjoint steps of logits."""
    if not rows or not sum(r[2] for r in rows):
        return default
    low, high, toxic, count = (np.array(c, np.float64) for c in zip(*sorted(rows, reverse=True), strict=True))
    best = int((2 * np.cumsum(toxic) / (np.cumsum(count) + toxic.sum())).argmax())
    below = high[best + 1] if best + 1 < len(high) else low[best] - 1
    return float((low[best] + below) / 2)


def recalibrate(model: Model, kept: DataFrame) -> None:
    """Set the thresholds anew by all rows ``_t, _y`` kept out of fitting, each counting once."""
    shared = kept.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in text_slices(batch, "_t", SCORED_BYTES):
                logit, spoken = scorer.logits([words(t) for t in as_bytes(part.column("_t"))])
                logit = np.clip(logit.astype(np.float64), -LOGIT_LIMIT, LOGIT_LIMIT)
                columns = [pa.array(spoken.astype(np.int32)), pa.array(np.floor(logit / LOGIT_STEP).astype(np.int32)), pa.array(logit), part.column("_y")]
                yield pa.RecordBatch.from_arrays(columns, names=["language", "step", "logit", "y"])

    scored = kept.select("_t", F.col("_y").cast("int").alias("_y")).mapInArrow(run, "language int, step int, logit double, y int")
    counts = scored.groupBy("language", "step").agg(F.min("logit").alias("low"), F.max("logit").alias("high"), F.sum("y").alias("toxic"), F.count("*").alias("n")).collect()
    toxic, n = sum(r["toxic"] for r in counts), sum(r["n"] for r in counts)
    if not 0 < toxic < n:
        return
    steps: dict[int, list] = {}
    for r in counts:
        steps.setdefault(r["step"], []).append(r)
    merged = [(min(r["low"] for r in g), max(r["high"] for r in g), sum(r["toxic"] for r in g), sum(r["n"] for r in g)) for g in steps.values()]
    everyone = threshold_of_counts(merged, 0.0)
    if not model.languages:
        model.shift -= everyone
        return
    bars = []
    for i in range(len(model.languages)):
        own = [(r["low"], r["high"], r["toxic"], r["n"]) for r in counts if r["language"] == i]
        bars.append(threshold_of_counts(own, everyone) if sum(r[2] for r in own) >= 5 else everyone)
    model.bar = np.array(bars, np.float32)


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang") -> Model:
    """Fit from the bounded sample, set thresholds by all labelled rows of remainder 3.

    Ids of the sample are chosen first, so only their texts reach the driver.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"), remainder(id_col).alias("_r")).where("_id is not null and _y in (0, 1) and _r <> 2").distinct()
    lang = F.col(lang_col) if lang_col and lang_col in documents.columns else F.lit(None).cast("string")
    every = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), lang.alias("_l"))
    texts = every.where(F.length("_t") <= MAX_CHARS)
    rows = []
    for label, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        chosen = own.where(F.col("_y") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
        rows += texts.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id").limit(most).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["_id"]).encode()), str(r["_id"])))
    model = fit([(r["_t"].encode(), r["_l"], r["_y"], r["_r"] == 3) for r in rows])
    if model.constant is None:
        recalibrate(model, every.where(remainder("_id") == 3).join(own.where("_r = 3").select("_id", "_y"), "_id"))
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``score`` (a column of that name is replaced)."""
    own = [c for c in df.columns if c not in ("score", "_text")]
    sent = text_col if text_col in own else "_text"  # a text is sent once
    schema = df.select(*own, F.lit(0.0).alias("score")).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in text_slices(batch, sent, SCORED_BYTES):
                got = scorer.scores([words(t) for t in as_bytes(part.column(sent))])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(got, pa.float64())], names=[*own, "score"])

    rows = df.select(*own) if sent == text_col else df.select(*own, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema)
