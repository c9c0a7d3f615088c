"""Text, cleaning, chunking, de-duplication, graph, layout and vectors: small cases and properties."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.functions.control import RateLimiter, Retry, is_safe_path
from docforge.functions.vectors import cosine
from docforge.operators import chunking, cleaning, dedup, embedding, graph, layout, quality


def one(spark, value, step):
    return spark.createDataFrame([(value,)], "c string").select(step(F.col("c")).alias("x")).first().x


def test_fullwidth_keeps_chinese_punctuation(spark):
    assert one(spark, "ＡＢ１，：　。", T.fullwidth_to_halfwidth) == "AB1，： 。"


def test_traditional(spark):
    assert one(spark, "學習國語", T.traditional_to_simplified) == "学习国语"


def test_whitespace(spark):
    assert one(spark, " a \t b\r\n\r\n\r\nc　", T.trim_whitespace) == "a b\n\nc"


@pytest.mark.parametrize(("data", "name"), [(b"", "UTF-8"), (b"\xef\xbb\xbfa", "UTF-8"), (b"\xff\xfea\x00", "UTF-16LE"), ("中文".encode("gbk"), "GBK"), (b"abc", "UTF-8"), (None, "UTF-8")])
def test_encoding(spark, data, name):
    assert spark.createDataFrame([(data,)], "b binary").select(T.detect_encoding(F.col("b"))).first()[0] == name


def test_decode(spark):
    rows = spark.createDataFrame([("中文".encode("gbk"),), (b"\xef\xbb\xbfx",)], "b binary").select(T.decode(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == ["中文", "x"]


def test_fence_stem_format(spark):
    assert one(spark, '```json\n{"a":1}\n```', T.strip_code_fence) == '{"a":1}'
    assert one(spark, "/a/b.c.txt", T.file_stem) == "b.c" and one(spark, "/a/.x", T.file_stem) == ".x" and one(spark, None, T.file_stem) == "unknown"


def test_page_numbers(spark):
    assert one(spark, "对你来\n32\n说", cleaning.remove_page_numbers) == "对你来\n说"
    assert one(spark, "2024年报告", cleaning.remove_page_numbers) == "年报告"
    assert one(spark, "2024年报告\n12\nx", lambda c: cleaning.remove_page_numbers(c, True)) == "2024年报告\nx"


def test_marks(spark):
    assert one(spark, "a​b﻿", cleaning.remove_zero_width) == "ab"
    assert one(spark, "好。。。。，，", cleaning.collapse_punctuation) == "好。，，"
    assert one(spark, "x\n-----\ny", cleaning.remove_separators) == "x\n\ny"
    assert one(spark, "列印日期/時間：1\nok\n加QQ:1234567\n豆丁网", cleaning.remove_print_marks) == "ok"


def reference_blocks(text):
    rows = text.rstrip("\n").split("\n")
    if len(rows) < 6:
        return text
    keys = [None] * len(rows)
    for i in range(len(rows) - 2):
        key = "\n".join(x.strip() for x in rows[i : i + 3])
        if rows[i].strip() and len(key) >= 30:
            keys[i] = key
    often = {k for k in keys if k and keys.count(k) >= 3}
    if not often:
        return text
    out, seen, i = [], set(), 0
    while i < len(rows):
        if keys[i] in often and keys[i] in seen:
            i += 3
            continue
        if keys[i] in often:
            seen.add(keys[i])
        out.append(rows[i])
        i += 1
    return "\n".join(out)


def test_repeated_blocks_against_a_plain_scan(spark):
    rng = random.Random(1)
    words = ["alpha beta gamma delta", "the second line here", "third line of block", "x", ""]
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", cleaning.remove_repeated_blocks(F.col("c")).alias("x")).collect()
    assert all(r.x == reference_blocks(texts[r.i]) for r in got)


def reference_units(line):
    s = line.strip()
    if len(s) < 4:
        return s
    out, i = [], 0
    while i < len(s):
        for n in range(min((len(s) - i) // 3, 8), 0, -1):
            unit, k = s[i : i + n], 1
            while s[i + k * n : i + (k + 1) * n] == unit:
                k += 1
            if k >= 3 and unit.strip():
                out.append(unit)
                i += k * n
                break
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def test_units_against_a_plain_scan(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", cleaning.collapse_units(F.col("c")).alias("x")).collect()
    assert [(r.x, texts[r.i]) for r in got if r.x != reference_units(texts[r.i])] == []


def test_watermarks(spark):
    text = "\n".join(["mark"] * 5 + ["body one", "body one", "", "mark mark", "last"])
    assert one(spark, text, cleaning.clean_lines) == "body one\nlast"
    composed = "\n".join(["ab"] * 5 + ["cde"] * 5 + ["abcde", "x"])
    assert one(spark, composed, cleaning.clean_lines) == "x"


def test_clean_chain_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain text"), (4, "第 3 页\n正文。。。。\n\n-----\n尾")], "id int, text string")
    got = {r.id: r.text for r in cleaning.clean(df).collect()}
    assert got == {1: None, 2: "", 3: "plain text", 4: "正文。\n尾"}


@pytest.mark.parametrize(
    ("line", "level"),
    [("", 0), ("# a", 1), ("### a b", 3), ("#a", 0), ("序", 2), ("目 录", 2), ("第一章 起", 1), ("第2节", 2), ("一、总", 2), ("（三）x", 2), ("1、x", 3), ("1.1 标题", 3), ("一、乾为天.......... 捌", 0), ("x" * 41, 0), ("plain", 0)],
)
def test_heading_level(spark, line, level):
    assert one(spark, line, chunking.heading_level) == level == chunking.level_of(line, frozenset(chunking.HEADING_WORDS))


def test_sections_relational_equals_python(spark):
    rng = random.Random(3)
    lines = ["# A", "第一章 b", "目录", "text one", "  ", "一、 c", "more text", ""]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 15))) for _ in range(80)]
    rel = {}
    for r in chunking.sections(spark.createDataFrame(list(enumerate(texts)), "d int, text string"), "d").orderBy("d", "section").collect():
        rel.setdefault(r.d, []).append((r.text, r.title, r.level))
    for i, t in enumerate(texts):
        assert rel.get(i, []) == [s for s in chunking.sections_of(t, frozenset(chunking.HEADING_WORDS)) if s[0]], repr(t)


def test_structure_aware(spark):
    long = "".join(f"第{i}句话在这里说明。" for i in range(60))
    df = spark.createDataFrame([("d1", f"# T\n{long}"), ("d2", ""), ("d3", None), ("d4", "short")], "id string, text string")
    rows = chunking.structure_aware(df, "id", limits=chunking.Limits(100, 0, 30)).orderBy("documentId", "ordinal").collect()
    assert {r.documentId for r in rows} == {"d1", "d4"}
    assert all(r.charCount == len(r.text) <= 150 for r in rows) and rows[0].id == "d1#0" and rows[0].sectionTitle == "# T"
    with pytest.raises(ValueError):
        chunking.Limits(0)
    with pytest.raises(ValueError):
        chunking.Limits(100, 100)
    with pytest.raises(LookupError):
        chunking.create("nothing")


def test_fragments_relational_equals_python(spark):
    rng = random.Random(4)
    parts = ["。tail", "a long enough chunk of text to stand alone", "short", " x ", "another chunk that is long enough, surely"]
    rows, want = [], []
    for d in range(60):
        texts = [rng.choice(parts) for _ in range(rng.randint(1, 8))]
        rows += [(d, i, t) for i, t in enumerate(texts)]
        want += [(d, o, t) for o, t, _, _ in chunking.merge_fragments([(t, "", 0) for t in texts])]
    got = chunking.fragment_groups(spark.createDataFrame(rows, "documentId int, ordinal int, text string")).collect()
    assert sorted((r.documentId, r.ordinal, r.text) for r in got) == sorted(want)


def test_windows_and_sentences(spark):
    assert one(spark, "abcdefghij", lambda c: chunking.fixed_windows(c, 4, 1)) == ["abcd", "defg", "ghij"]
    assert one(spark, "ab", lambda c: chunking.fixed_windows(c, 4, 1)) == ["ab"] and one(spark, "", lambda c: chunking.fixed_windows(c, 4, 1)) == []
    assert one(spark, "short. no. " + "x" * 20 + "! rest", chunking.sentences) == ["short. no. " + "x" * 20 + "!", "rest"]


def test_semantic(spark):
    df = spark.createDataFrame([(1, "aaaaaaaaaaaaaaaaaaaaaa! aaaaaaaaaaaaaaaaaaaaaaa! zzzzzzzzzzzzzzzzzzzzzzzzz!")], "d int, text string")
    rows = chunking.semantic(df, "d", "text", embedding.embedder(embedding.HashingProvider()), 0.5).orderBy("ordinal").collect()
    assert len(rows) == 2 and rows[1].text.startswith("z")


def test_exact_dedup(spark):
    df = spark.createDataFrame([("a", "h", "p2"), ("b", "h", "p1"), ("c", "g", "p3"), ("d", None, "p4")], "id string, contentHash string, sourcePath string")
    got = {r.id: (r.isDuplicate, r.duplicateOf) for r in dedup.first_by_hash(df).collect()}
    assert got == {"a": (True, "b"), "b": (False, None), "c": (False, None), "d": (False, None)}


def greedy(texts, t):
    sets = [frozenset({x[i : i + 3] for i in range(len(x) - 2)}) if len(x) >= 3 else frozenset({x}) for x in texts]
    lead, out = [], {}
    for i, s in enumerate(sets):
        hit = next((j for j in lead if len(s & sets[j]) / len(s | sets[j]) >= t), None)
        if hit is None:
            lead.append(i)
        else:
            out[i] = hit
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.5])
def test_near_dup_equals_greedy_scan(spark, threshold):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 120))) for _ in range(15)]
    texts = []
    for _ in range(120):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            if x:
                x[rng.randrange(len(x))] = rng.choice("xyz")
        texts.append("".join(x))
    got = dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", threshold).collect()
    assert {r.id: r.leader for r in got} == greedy(texts, threshold)


def test_candidates_of_common_grams_are_few(spark):
    """Texts that share most grams, none of them similar: nearly none are compared; similar ones all are."""
    rng = random.Random(8)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    words = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(400)]
    base = [rng.sample(words, 120) for _ in range(300)]
    texts = [" ".join(x) for x in base] + [" ".join(x[:-2] + ["zzz"]) for x in base[:20]]
    sets = dedup.gram_sets(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").cache()
    found = {(r.a, r.b) for r in dedup._candidates(sets, 0.85).collect()}
    assert {(i, 300 + i) for i in range(20)} <= found and len(found) < 60


def test_tiles_meet_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE_ROWS", 7)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    sets = dedup.gram_sets(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").cache()
    plain = {r.id: set(r.g) for r in sets.collect()}
    want = {(a, b) for a in plain for b in plain if a < b and len(plain[a] & plain[b]) >= 0.5 * len(plain[a] | plain[b])}
    found = [(r.a, r.b) for r in dedup._candidates(sets, 0.5).collect()]
    assert len(found) == len(set(found)) and want <= set(found)


def test_gram_codes_are_the_grams(spark):
    texts = [None, "", "a", "ab", "\x00b", "abc", "aaaa", "😀x😀x", "知盈医学 知盈"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", "t", dedup.grams(F.col("t")).alias("g")).collect()

    def code(gram):
        padded = [0] * (3 - len(gram)) + [ord(c) + 1 for c in gram]
        return padded[0] << 42 | padded[1] << 21 | padded[2]

    assert all(dedup.gram_codes(r.t).tolist() == sorted(code(g) for g in r.g) for r in rows)


def test_top_k_per_query_in_tiles_equals_all_pairs(spark, monkeypatch):
    """Odd vectors and ties included; no join of rows with queries is left in the plan."""
    monkeypatch.setattr(embedding, "BLOCK_ROWS", 20)
    monkeypatch.setattr(embedding, "BLOCK_QUERIES", 5)
    rng = random.Random(12)
    some = [[rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(90)]
    odd = [None, [], [1.0, None, 0.0], [1.0, 0.5], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [0.0, 0.0, 0.0], [1e-170, 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(some + odd)), "id int, embedding array<double>")
    queries = rows.where("id % 10 = 0 or id >= 90").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = embedding.top_k_per_query(rows, queries, 7)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    pairs = rows.crossJoin(queries).select("query_id", "id", cosine(F.col("embedding"), F.col("query")).alias("similarity"))
    want = pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 7")
    shown = [sorted((r.query_id, r["rank"], r.id, str(r.similarity)) for r in x.collect()) for x in (got, want)]
    assert shown[0] == shown[1] and len(shown[0]) == 7 * 17


def test_workers_make_chunks_pages_and_vectors_of_few_rows_at_once(spark, monkeypatch):
    """What a worker holds as Python objects is bounded by bytes, not by the rows of an Arrow batch."""
    monkeypatch.setattr(T, "SLICE_CHARS", 1000)
    texts = [None, "", "x" * 3000] + ["一" * 100] * 30
    column = pa.array(texts)
    runs = list(T.slices(column))
    assert [i for start, n in runs for i in range(start, start + n)] == list(range(len(texts)))
    assert max(sum(len((texts[i] or "").encode()) for i in range(start, start + n)) for start, n in runs if n > 1) <= 1000
    docs = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), column, pa.nulls(len(texts), pa.string())], names=["d", "t", "p"])
    sizes = [batch.num_rows for batch in chunking.chunk_batches(iter([docs]), chunking.Limits(), frozenset())]
    assert len(sizes) == len(runs) and sum(sizes) == 6 + 30

    class Provider:
        dimensions = 2

        def embed_batch(self, texts):
            return [[float(len(t)), 0.5] for t in texts]

    rows = spark.createDataFrame([("a",), (None,), ("abc",)], "t string").coalesce(1)
    assert [r.v for r in rows.select(embedding.embedder(Provider(), 1)(F.col("t")).alias("v")).collect()] == [[1.0, 0.5], None, [3.0, 0.5]]


def test_overlaps_equal_all_pairs_without_a_row_for_each_common_gram(spark, monkeypatch):
    monkeypatch.setattr(dedup, "ITEMS", 4)
    rng = random.Random(15)
    texts = [None, "", "ab"] + ["".join(rng.choice("abc") for _ in range(rng.randint(3, 40))) for _ in range(40)]
    items = texts[:3] + texts[5:12]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "i string, text string")
    got = dedup.overlaps(docs, bench, "d", "i", "text", 0.4)
    assert "Join" not in got._jdf.queryExecution().toString()
    grams = lambda t: {t or ""} if len(t or "") < 3 else {t[j : j + 3] for j in range(len(t) - 2)}
    want = {(a, f"i{b}", len(x), len(y), len(x & y)) for a, x in enumerate(map(grams, texts)) for b, y in enumerate(map(grams, items)) if len(x & y) >= 0.4 * len(x | y)}
    assert {tuple(r) for r in got.collect()} == want


def test_mark(spark):
    chunks = spark.createDataFrame([("a", ["k"]), ("b", None)], "id string, tags array<string>")
    found = spark.createDataFrame([("a", "z")], "id string, leader string")
    assert {r.id: r.tags for r in dedup.mark(dedup.mark(chunks, found), found).collect()} == {"a": ["k", "DUPLICATE_OF:z"], "b": []}


def test_gate_and_resume(spark):
    chunks = spark.createDataFrame([("a", "fine"), ("b", "x bjbj"), ("c", "�" * 5 + "y" * 10), ("d", None)], "documentId string, text string")
    kept, failures = quality.gate(chunks)
    assert {r.documentId for r in kept.collect()} == {"a", "d"} and {r.documentId for r in failures.collect()} == {"b", "c"}
    state = spark.createDataFrame([("f", s, "SUCCESS") for s in ("INGEST", "CLEAN", "SINK")] + [("g", "INGEST", "SUCCESS")], "file_path string, stage string, status string")
    files = spark.createDataFrame([("f",), ("g",), ("h",)], "file_path string")
    assert {r.file_path for r in quality.pending(files, state).collect()} == {"g", "h"}
    assert {r.file_path for r in quality.pending(files, state, True).collect()} == {"f", "g", "h"}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [2.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0], [1.0, 0.0])], "i int, a array<float>, b array<float>")
    assert [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]


class Canned:
    def chat(self, system, user):
        if "relations" in system:
            return '{"relations": [{"source": "A", "target": "Bee", "type": "t"}, {"source": "A", "target": "none", "type": "t"}]}'
        return '```json\n{"entities": [{"name": "A", "type": "x", "aliases": []}, {"name": "B", "type": "y", "aliases": ["Bee"]}, {"name": " "}, {"name": "Ａ"}]}\n```' if "bad" not in user else "no json"


def test_graph(spark):
    chunks = spark.createDataFrame([("c1", "text", 0), ("c2", "bad", 1)], "id string, text string, ordinal int")
    per = graph.chunk_entities(graph.extract_entities(chunks, Canned()))
    assert sorted((r.name, r.aliases) for r in per.collect()) == [("A", ["Ａ"]), ("B", ["Bee"])]
    rel = graph.resolve_relations(graph.extract_relations(chunks, per, Canned()), per)
    assert [(r.confidence, r.type) for r in rel.collect()] == [(0.8, "t")]
    merged = graph.merge_entities(per.withColumn("chunkOrder", F.lit(0)))
    assert merged.count() == 2 and graph.valid_edges(rel, merged).count() == 1
    both = graph.upsert(merged, merged.where("name = 'A'").withColumn("type", F.lit("new")), ["id"])
    assert {r.name: r.type for r in both.collect()} == {"A": "new", "B": "y"}


def test_layout(spark):
    assert spark.range(1).select(layout.is_scanned(F.lit(19), F.lit(2))).first()[0]
    df = spark.createDataFrame([("甲\n正文内容很长的一行\n乙",)], "c string")
    assert df.select(layout.page_alt_text(F.col("c"), F.lit(2))).first()[0] == "乙"
    images = F.array(F.struct(F.lit(1).alias("page"), F.lit("p1.png").alias("filePath"), F.lit("甲").alias("altText")))
    assert "file=p1.png" in df.select(layout.insert_image_markers(F.col("c"), images)).first()[0].split("\n")[1]
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, None)], "doc string, page int, text string")
    assert layout.ocr_text(pages).first().text == "x\n[第2页 OCR 失败]\n"


def test_control(tmp_path):
    now = [0.0]
    limiter = RateLimiter(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    limiter.acquire(5)
    assert 1.4 < now[0] < 1.6 and not limiter.try_acquire(3, 0.1)
    with pytest.raises(ValueError):
        limiter.acquire(0)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert Retry(sleep=lambda s: None).run(flaky) == "ok"
    with pytest.raises(OSError):
        Retry(only=(KeyError,), sleep=lambda s: None).run(lambda: (_ for _ in ()).throw(OSError()))
    assert is_safe_path("a/../b", str(tmp_path)) and not is_safe_path("../x", str(tmp_path))
