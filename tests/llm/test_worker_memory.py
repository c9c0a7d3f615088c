"""What a Python worker holds while it scores."""

import pyarrow as pa

from docforge.llm import bpe, decontam, toxicity


def test_scoring_lets_go_of_the_encoder_and_sends_a_text_once(spark, monkeypatch):
    docs, seen = spark.createDataFrame([(1, "a good day"), (2, None)], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.append((self.columns, run)) or self)
    toxicity.score(docs, toxicity.Model(constant=0.25))
    (sent, run), batch = seen[0], pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a good day", None]})
    assert sent == ["doc_id", "text"]
    bpe.encoder()
    out = list(run(iter([batch])))
    assert bpe.encoder.cache_info().currsize == 0
    assert pa.Table.from_batches(out).to_pydict() == {"doc_id": [1, 2], "text": ["a good day", None], "score": [0.25, 0.25]}


def test_text_under_another_name_is_scored(spark):
    docs = spark.createDataFrame([(1, "a good day", 7)], "doc_id long, score string, n int")
    got = toxicity.score(docs, toxicity.Model(constant=0.25), "score").collect()
    assert [r.asDict() for r in got] == [{"doc_id": 1, "n": 7, "score": 0.25}]


def test_decontamination_sends_a_text_once(spark, monkeypatch):
    docs, seen = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), []
    items = spark.createDataFrame([("x", "b c")], "item_id string, text string")
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.append(self.columns) or plain(self, run, schema))
    assert [r["items"] for r in decontam.find_overlaps(docs, items).collect()] == [["x"]]
    assert all("_text" not in columns for columns in seen if "hits" in columns) and any("hits" in columns for columns in seen)
