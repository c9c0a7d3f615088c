"""Configuration, sources, sinks, state, the whole pipeline and the registered SQL."""

import io
import json
import zipfile

import duckdb
import pytest

from docforge.plans import catalog, config, pipeline, state
from docforge.sources import files, sinks

SF = "/root/testdata/sf0.001"


def test_config():
    c = config.load("pipeline:\n  clean:\n    chunking: {max_size: 100}\n  input: ${IN:here}\n", {"pipeline.name": "x"}, {})
    assert c.chunking == {"strategy": "structure_aware", "max_size": 100, "overlap": 50, "min_size": 50} and c.input == ["here"] and c.name == "x"
    for bad, code in (("pipeline: {name: ''}", "CONFIG_002"), ("pipeline: {stages: {clean: {chunking: {max_size: 0}}}}", "CONFIG_004"), ("pipeline: {sinks: [{type: vectors}], stages: {embed: {provider: other}}}", "CONFIG_003"), ("a: !!python/object/apply:os.system [x]", "CONFIG_001")):
        with pytest.raises(config.ConfigError) as e:
            config.load(bad, env={})
        assert e.value.code == code
    assert config.load(overrides={"pipeline.name": "a"}).job_id() != config.load(overrides={"pipeline.name": "b"}).job_id()


def office(path, inner):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in inner.items():
            z.writestr(name, body)


def make_files(folder):
    (folder / "sub").mkdir()
    (folder / "a.md").write_text("# Title\n" + "A sentence that is long enough. " * 5, encoding="utf-8")
    (folder / "sub" / "copy.txt").write_text("# Title\n" + "A sentence that is long enough. " * 5, encoding="utf-8")
    (folder / "gbk.txt").write_bytes(("中文内容在这里，说明编码检测。" * 4).encode("gbk"))
    (folder / "p.html").write_text("<html><head><title>T</title><style>x</style></head><body><h1>Head</h1><p>One &amp; two, a paragraph that goes on for a while.</p></body></html>")
    (folder / "broken.pdf").write_bytes(b"%PDF-broken")
    (folder / ".hidden.txt").write_text("no")
    (folder / "skip.xyz").write_text("no")
    office(folder / "w.docx", {"word/document.xml": '<w:document xmlns:w="w"><w:p><w:r><w:t>Word text of some length, enough to stand alone.</w:t></w:r></w:p></w:document>', "docProps/core.xml": '<c xmlns:d="d"><d:creator>Me</d:creator></c>'})


def test_sources(spark, tmp_path):
    make_files(tmp_path)
    scanned = files.scan(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "absent")])
    docs = {r.fileName: r for r in files.documents(scanned).collect()}
    assert set(docs) == {"a.md", "copy.txt", "gbk.txt", "p.html", "broken.pdf", "w.docx"}
    assert docs["a.md"].id == docs["copy.txt"].id and docs["gbk.txt"].content.startswith("中文")
    assert docs["p.html"].content.split("\n")[0] == "Head" and docs["p.html"].metadata.extra["title"] == "T"
    assert docs["broken.pdf"].status == "FAILED" and "PDF" in docs["broken.pdf"].error and docs["w.docx"].metadata.author == "Me"


def test_xlsx():
    data = io.BytesIO()
    office(data, {"xl/sharedStrings.xml": '<s xmlns="x"><si><t>name</t></si></s>', "xl/worksheets/sheet1.xml": '<w xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></w>'})
    assert files.parse_office(data.getvalue(), "x.xlsx")["content"] == "name\t5"


def test_run_and_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make_files(tmp_path / "in")
    out = str(tmp_path / "out")
    conf = config.load(overrides={"pipeline.input": [str(tmp_path / "in")], "pipeline.output": out, "pipeline.sinks": [{"type": "markdown", "dir": "00-clean"}, {"type": "jsonl", "path": "01-chunks/chunks.jsonl"}, {"type": "vectors", "path": "03-vectors"}]})
    result = pipeline.run(spark, conf)
    assert result.report["total_files"] == 6 and result.report["failed"] == 1
    rows = files.read_chunks(spark, f"{out}/01-chunks/chunks.jsonl").collect()
    assert len(rows) == result.report["total_chunks"] and all(r._corrupt is None for r in rows)
    assert spark.read.parquet(f"{out}/03-vectors").count() == len(rows)
    again = pipeline.run(spark, conf)
    assert again.report["total_files"] == 1  # only the failed file is left
    assert files.read_chunks(spark, f"{out}/01-chunks/chunks.jsonl").count() == len(rows)
    with open(f"{out}/02-reports/error-report.json", encoding="utf-8") as f:
        assert json.load(f)["failed"] == 1
    assert pipeline.preview(files.documents(files.scan(spark, [str(tmp_path / "in" / "a.md")])), conf, 1)["total"] >= 1


def test_jsonl_sink_replaces(spark, tmp_path):
    cols = "id string, documentId string, sourcePath string, text string, ordinal int, sectionTitle string, sectionLevel int, startPage int, charCount int, blockType string"
    row = lambda i, d, t: (i, d, "p", t, 0, "", 0, 0, len(t), "PARAGRAPH")
    sink = sinks.JsonlSink(str(tmp_path / "c.jsonl"))
    sink.write(spark.createDataFrame([row("a#0", "a", "x"), row("b#0", "b", "y")], cols))
    sink.write(spark.createDataFrame([row("a#0", "a", "new")], cols))
    assert {r.text for r in files.read_chunks(spark, sink.path).collect()} == {"new", "y"}
    sink.delete_by_document(["b"], spark)
    assert {r.text for r in files.read_chunks(spark, sink.path).collect()} == {"new"}
    with pytest.raises(LookupError):
        sinks.create_sink("nothing", {})


def test_state(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path / "state"))
    assert not table.has_unfinished("j")
    one = lambda s: spark.createDataFrame([("j", "f", "h", "d", "INGEST", s)], "job_id string, file_path string, content_hash string, document_id string, stage string, status string")
    table.append(one("FAILED"))
    assert table.has_unfinished("j")
    table.append(one("SUCCESS"))
    assert not table.has_unfinished("j") and state.last_completed(table.current("j")).first().stage == "INGEST"
    table.clean("j")
    assert table.all().isEmpty()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect())
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())


def test_entry(spark):
    assert catalog.flagship(spark, SF).count() > 0
