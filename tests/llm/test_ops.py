"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd inputs."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from docforge.llm import bpe, common, decontam, packing, queries, simhash, suffix_dedup, token_counts, topk, toxicity, urlfilter, wrappers
from docforge.llm.suffix_array import suffix_array

ODD = [(1, None), (2, ""), (None, "same text"), (3, "same text"), (3, "same text"), (4, " \n\t "), (5, "x" * 30_000), (6, "été 中文 🙂 it's 1234!!  \n\n end")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in ODD], "doc_id long, text string, score int, fp string")
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.RANK_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rng, n):
    return "".join(rng.choice(["foo", " ", "\n", "'", "s", "re", " bar", "12", "é", "  ", "!", "中", "\x1c", "the", " of"]) for _ in range(n))


# 1


def test_url_parts_and_rules(spark):
    urls = ["http://A.example.NET/en/1?x#y", "https://example.com/de/", "http://x.org/fr/a", "http://net/", "http://net", None, "no scheme", "http://", "a://b://c/d", "http://notnet/x", "http://example.net/e"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id int, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("example.com/de/", "block") and got[2][2:] == ("org/fr/", "allow")
    assert got[3][2:] == ("net/", "block") and got[4] == ("net", "", None, "allow") and got[5] == got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("b:", "//c/d", None, "allow") and got[9][2] is None and got[10][2:] == ("net/", "block")


def test_aliases(spark):
    link = "<head><link href='{}' rel=\"canonical\"></head>"
    rows = [
        (1, "http://a.com/x#f", link.format("https://bad.net/y")),  # alias of a blocked one
        (2, "http://b.com/", '<meta http-equiv="refresh" content="0; url=http://a.com/x">'),  # and its alias
        (3, "http://c.org/fr/z", link.format("http://bad.net/y")),  # its own allow rule wins
        (4, "http://d.com/p/q", link.format("../r")),
        (5, "http://e.com/", link.format("mailto:x")),
        (6, None, link.format("http://bad.net/y")),
        (7, "http://a.com/x", None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: (r.verdict, r.via) for r in urlfilter.judge(pages).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "rule"), 4: ("allow", "default"), 5: ("allow", "default"), 6: ("allow", "default"), 7: ("block", "alias")}
    redirects = spark.createDataFrame([("http://d.com/p/q", "http://a.com/x")], "source string, target string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(pages, redirects=redirects).collect()}[4] == "block"
    assert urlfilter.judge(pages.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 80)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.component_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# 2


def test_packing(spark, odd, reference):
    rows = packing.pack(odd, length=64, window=500).collect()
    back = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens and list(ids[r.n_tokens :]) == [packing.PAD] * (64 - r.n_tokens)
        assert r.position_resets == r.cu_seqlens[:-1] and len(packing.position_ids(r)) == r.n_tokens
        for doc, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            back[doc].setdefault(at, []).append(ids[a:b].tolist())
    for doc, text in {(i, t) for i, t in ODD if t}:
        copies = sum(1 for x in ODD if x == (doc, text))
        assert all(len(v) == copies for v in back[doc].values())
        assert [x for at in sorted(back[doc]) for x in back[doc][at][0]] == reference.encode_ordinary(text)


def test_best_fit_against_plain_scan():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        rows = packing.best_fit_decreasing(sizes, 30)
        rooms = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(30 - s)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(30 - sum(sizes[i] for i in r) for r in rows) == sorted(rooms)


# 3


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats_come_from_the_suffix_order(monkeypatch):
    """Contexts of one anchor against every pair of strings at one distance; a wrong order or blind ends lose or add repeats."""
    rng, length = np.random.default_rng(3), 200
    for least in range(6):
        base = rng.integers(97, 99, 341).astype(np.uint8)
        offset, strings, contexts = [], [], []
        for _ in range(40):
            body = base.copy()
            body[rng.integers(0, 140, least)] ^= 3  # left of the anchor
            body[rng.integers(200, 341, least)] ^= 3  # right of its probe
            first, last = sorted(rng.integers(0, 141, 2).tolist())
            contexts.append(body[first : last + length].tobytes())
            offset.append(140 - first)
            strings.append(last - first)
        offset, strings = np.array(offset), np.array(strings)
        many = np.where(rng.random(40) < 0.1, 2, 1)
        where = Counter((d, c[o - d : o - d + length]) for o, n, c in zip(offset, strings, contexts, strict=True) for d in range(o - n, o + 1))
        want = [[m > 1 or where[o - i, c[i : i + length]] > 1 for i in range(n + 1)] for m, o, n, c in zip(many, offset, strings, contexts, strict=True)]
        args = (many, offset, strings, contexts, length)
        assert [m.tolist() for m in suffix_dedup.repeats_in(*args)] == want
        with monkeypatch.context() as patch:  # all strings of one hash: bytes decide
            patch.setattr(suffix_dedup, "mix", lambda h: h * np.uint64(0))
            assert [m.tolist() for m in suffix_dedup.repeats_in(*args)] == want
        with monkeypatch.context() as patch:
            patch.setattr(suffix_dedup, "suffix_array", lambda s: rng.permutation(len(s)))
            assert least > 2 or [m.tolist() for m in suffix_dedup.repeats_in(*args)] != want


def removed_by_force(texts, length=200):
    where = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        gone = np.cumsum(m)[: len(t)] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize(("limit", "hot_parts"), [(8_000, 1000), (8_000, 2), (2, 2)])
def test_repeated_strings(spark, odd, monkeypatch, limit, hot_parts):
    monkeypatch.setattr(suffix_dedup, "CLASS_LIMIT", limit)
    monkeypatch.setattr(suffix_dedup, "HOT_PARTS", hot_parts)
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(150, 500))) for _ in range(6)]
    rows = list(ODD)
    for i in range(100):
        parts = [rng.choice([rng.choice(base)[rng.randint(0, 200) :][: rng.randint(1, 400)], "aaaa" * rng.randint(1, 120), "é" * rng.randint(1, 150), str(rng.random())]) for _ in range(rng.randint(0, 5))]
        rows.append((100 + i, "".join(parts)))
    want = Counter((i, *v) for (i, _), v in zip(rows, removed_by_force([(t or "").encode() for _, t in rows]), strict=True))
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_repeated_strings_empty(empty):
    assert suffix_dedup.report(empty).count() == 0 and suffix_dedup.cut_repeats(empty).count() == 0


# 4

PAGE = """<!doctype html><html><head><title>No</title><style>p{{}}</style><script>var a="</p><p>no</p>"</script></head><body class="home">
<header><a href=/>Site</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">Cookies</div>
<article><header><h1>Head {n}</h1></header>{body}<aside>Side</aside><div class="ad">Buy</div><form>Mail <input></form></article>
<section id="comments"><article class="comment">Nice!</article></section><footer>&copy; all</footer></body></html>"""


def test_extraction(spark):
    body = "<p>One &amp; <b>tw</b>o<br>three&nbsp;\n four<p>Next &#233;t&eacute; <!-- no -->x</p><ul><li>a<li>b</ul>"
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE.format(n=i, body=body)) for i in range(6)]
    rows += [(10, None, None), (11, "http://h0.com/", ""), (12, "http://h0.com/c", PAGE.format(n=12, body=body)[:600]), (13, "http://plain.com/a", "<div class=menu>m</div><div class=text><p>main text that is long</p></div><div>small</div>")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract(pages).collect()}
    for i in range(6):
        text = f"Head {i} One & two three four Next été x a b"
        assert got[i] == (text, len(text))
    assert got[10] == got[11] == ("", 0) and got[12][0].startswith("Head 12") and got[13][0] == "main text that is long"
    assert wrappers.extract(pages.where("false")).count() == 0


def test_wrapper_inference():
    def e(s, pages=1):  # a word beside tags is a text
        return wrappers.folded([[t] if t[0] == "<" else ["#", [None if t == "#" else t, pages]] for t in s.split()])

    def both(a, b):
        return wrappers.rendered(wrappers.aligned(e(a), e(b)))

    assert wrappers.rendered(e("<a> # <p> # <p> # <p> #")) == "<a> ( # <p> )+ #"
    assert both("<u> x </u>", "<u> x </u>") == "<u> = </u>" and both("<u> x </u>", "<u> y </u>") == "<u> # </u>"
    assert both("<a> top </a> <b> x </b>", "<a> top </a> <h> t </h> <b> y </b>") == "<a> = </a> ( <h> = </h> )? <b> # </b>"
    assert both("<u> <l> # </u>", "<u> <l> # <l> # </u>") == "<u> ( <l> # )+ </u>"
    met = wrappers.aligned(e("<a> top </a> <b> x </b>", 2), e("<a> top </a> <b> y </b>", 3))
    assert list(wrappers.slots_of(met)) == [((), ["top", 5]), ((), [None, 5])]


def test_wrapper_decides(spark):
    """Unnamed parts: only the wrapper tells the template's texts, lists of them and optional ones included, from content."""
    def page(i):
        odd = "<div>Winter sale</div>" if i % 2 else ""
        return f"<body><div>Acme daily</div><ul><li>News<li>Sport</ul>{odd}<div><h2>Title {i}</h2>" + "".join(f"<p>Text {i} {j}" for j in range(1 + i % 3)) + "</div><div>All rights reserved</div></body>"

    rows = [(i, "http://a.org/x", page(i)) for i in range(12)] + [(20, "http://b.org/", page(0)), (21, "http://b.org/", page(0)), (22, "http://b.org/", page(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    for i in range(12):
        assert got[i] == " ".join([f"Title {i}", *(f"Text {i} {j}" for j in range(1 + i % 3))])
        assert got[i] != wrappers.Reader(page(i)).main_text(frozenset(), "div")
    whole = "Acme daily Title 0 Text 0 0 All rights reserved"
    assert got[20] == got[21] == got[22] == whole  # copies of one page show no template


# 5


def test_bpe_equals_tiktoken(reference):
    enc, rng = bpe.encoder(), random.Random(5)
    for _ in range(3000):
        t = random_text(rng, rng.randint(0, 40)) if rng.random() < 0.7 else "".join(chr(rng.choice([*range(0x20, 0x250), 0x3000, 0x85, 0xA0, 0x1F600, 0x4E00])) for _ in range(12))
        ids = enc.encode(t)
        assert ids.tolist() == reference.encode_ordinary(t), repr(t)
        assert enc.decode(ids) == t.encode()
    for t in ("a" * 20_000, "ab " * 200_000, "<|endoftext|>"):
        assert enc.encode(t).tolist() == reference.encode_ordinary(t)


def test_bpe_query(spark, odd, empty, reference):
    got = Counter(tuple(r) for r in bpe.round_trip(odd).collect())
    want = Counter()
    for i, t in ODD:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want and bpe.round_trip(empty).count() == 0
    back = bpe.decode(bpe.encode(odd))
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in ODD)


# 6


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_decontamination(spark, odd, chunk):
    rng = random.Random(6)
    vocabulary = ["a", "b", "ab", "c9", "é", "Zz", "longer", "words"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, n)))
    items = [(i, rng.choice([None, "", text(12)])) for i in range(14)]
    rows = ODD + [(100 + i, text(40)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, items string")
    found = decontam.digest(decontam.find_overlaps(docs, spark.createDataFrame(items, "item_id long, text string"), chunk_bytes=chunk))
    want = Counter((i, *decontam.brute_force(t, [(str(k), x) for k, x in items])) for i, t in rows)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_decontamination_empty(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_items for r in decontam.digest(decontam.find_overlaps(odd, none)).collect()} == {0}
    assert decontam.digest(decontam.find_overlaps(empty, none)).count() == 0


# 7


def test_edits_equal_fresh_counts(reference):
    rng, enc = random.Random(7), bpe.encoder()
    for _ in range(300):
        text = random_text(rng, rng.choice([0, 5, 40, 900]))
        tree = token_counts.CountTree(text, enc)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 200]))
            new = random_text(rng, rng.randint(0, 4))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total == len(reference.encode_ordinary(text))
    with pytest.raises(ValueError):
        token_counts.CountTree("abc", enc).edit(2, 9, "")


def test_count_query(spark, odd, empty, reference):
    rows = [*ODD, (20, "mail me: some.one@example.com or +1 (555) 123-4567 " * 40)]
    got = {(r.doc_id, r.n_tokens): r for r in token_counts.count_edited(spark.createDataFrame(rows, "doc_id long, text string"), token_counts.scrub_edits).collect()}
    for i, t in rows:
        edited, shift = t or "", 0
        for a, b, new in token_counts.scrub_edits(t or ""):
            edited = edited[: a + shift] + new + edited[b + shift :]
            shift += len(new) - (b - a)
        assert got[i, len(reference.encode_ordinary(t or ""))].n_tokens_edited == len(reference.encode_ordinary(edited))
    assert got[20, len(reference.encode_ordinary(rows[-1][1]))].n_edits == 80
    assert token_counts.count_edited(empty, token_counts.scrub_edits).count() == 0


# 8


def plain_fingerprint(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    bits = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))


def test_simhash(spark, odd, empty):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    rows = list(ODD)
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.choice([1, 4, 80]))]
        rows.append((100 + 3 * i, " ".join(w)))
        for j in (1, 2):
            v = list(w)
            v[rng.randrange(len(v))] = "other"
            rows.append((100 + 3 * i + j, " ".join(v).upper()))
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = Counter((doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.components(empty).count() == 0


def test_near_links_miss_nothing(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for r in (1, 2, 3, 4):
            for _ in range(6):
                y = x
                for b in rng.choice(64, r, replace=False):
                    y ^= 1 << int(b)
                fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), "fp", ("fp",))
    got = {r.node: r.root for r in common.component_labels(links).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


# 9


@pytest.mark.parametrize("block", [1024, 3])
def test_topk(spark, block):
    rng = random.Random(10)
    rows = [(i, [rng.choice([0.0, 0.1, -0.2, 0.5]) for _ in range(6)]) for i in range(0, 900, 7)]
    rows += [(1000, None), (1001, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1100, [float("inf")] * 6), (None, [0.5] * 6), (7, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, df.where("vec_id % 100 = 0"), query_block=block, tile_rows=3 * block).collect()
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:10]
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.search(df.where("false"), df.where("false")).count() == 0


# 10


def test_toxicity(spark, odd, empty):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grobian", "wicht", "schuft"]))
        rows.append((i, " ".join(w), "de" if i % 2 else "en"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    scored = toxicity.score(docs, model).withColumn("held", toxicity.remainder("doc_id") == 2).collect()
    held = [(r.score >= toxicity.PASS, r.doc_id % 4 == 0) for r in scored if r.held]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) >= 0.97
    again = toxicity.score(odd, model).collect()
    assert len(again) == len(ODD) and all(0 <= r.score <= 1 for r in again)
    assert toxicity.score(empty, model).count() == 0
    # the score is a function of the text alone
    moved = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    assert {r.text: r.score for r in toxicity.score(moved, model).collect()} == {r.text: r.score for r in scored}


def test_toxicity_without_labels(spark, odd):
    model = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score < toxicity.PASS for r in toxicity.score(odd, model).collect())


def test_blocks_of_words_join(monkeypatch):
    rng = random.Random(12)
    model = toxicity.fit([(b"good day " * 5, "en", 0, i % 3 == 0) for i in range(20)] + [(b"bad day", "en", 1, i % 3 == 0) for i in range(20)])
    texts = [[rng.choice([b"good", b"bad", b"day", b"x"]) for _ in range(rng.randint(0, 50))] for _ in range(60)]
    whole = toxicity.Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(toxicity.Scorer(model).scores(texts), whole, atol=1e-5)


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 11)} | {"pipeline"}


def test_overlaps_with_items_without_id(spark):
    window = "one two three four five six seven eight"
    bench = spark.createDataFrame([(None, window), (7, "four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(1, f"zero {window} nine ten eleven"), (2, window), (3, f"{window} {window}"), (4, "one two three"), (5, None)]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.digest(decontam.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench)).collect()}
    assert got == {1: (12, 11, 1), 2: (8, 8, 0), 3: (16, 16, 0), 4: (3, 0, 0), 5: (0, 0, 0)}


def test_similar_groups_keep_borderline_families_apart(spark):
    """A family of texts with one common passage: groups are the components of the exact relation, however they meet."""
    from docforge.llm import similar

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(120):
        own = [word() for _ in range(rng.choice((8, 14, 20, 40)))]
        texts.append(" ".join(passage + own))
        if rng.random() < 0.4:
            own[rng.randrange(len(own))] = word()
            texts.append(" ".join(passage + own))
    sets = [set(similar.shingle_set(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {r.node: r.root for r in similar.similar_groups(df, "node").collect()}
    assert [found.get(i, i) for i in range(len(texts))] == root


def test_forest_of_a_large_group():
    rng = np.random.default_rng(4)
    for radius in (1, 3):
        rest = rng.integers(0, 1 << 32, 400, dtype=np.uint64)
        for i in range(200, 400):  # chains of near neighbours
            rest[i] = rest[rng.integers(0, i)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(32, radius, replace=False)))
        fps = (rest << np.uint64(32) | np.uint64(7))[:, None]
        node = np.arange(400)

        def roots(links):
            root = list(range(400))
            for x, y in links:
                a, b = sorted((root[x], root[y]))
                root = [a if r == b else r for r in root]
            return root

        assert len(node) > simhash.WHOLE_GROUP
        assert roots(simhash._forest(node, fps, rest, radius)) == roots(simhash._spanning(node, fps, radius))
