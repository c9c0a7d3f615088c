"""HTML extraction by union-free regular expressions inferred for each host.

A page is a stream of block-level tags and texts.  ``expression`` folds runs of
parts of one shape into repeated groups.  ``aligned`` takes two expressions of
a host and resolves each mismatch, iteratively: texts that differ become a
slot, a part that repeats its neighbour a repeated group, any other part an
optional one.  The result is union-free: tags, fixed texts, slots, ``( )?`` and
``( )+``.  All pages of a host go into one such wrapper.

What is extracted: menus, headers, footers, sidebars, notices, adverts, forms
and comments are left out by their tags and names.  Of the rest an ``article``
is taken whole, else ``main``.  A page that marks neither is read through its
wrapper: texts in slots are content, in the host's main container (by mass of
text) before elsewhere, and a text that the wrapper fixes is the template's
and goes.  Fixed is what fills one slot alike on at least three pages different
in text and on half of the host's; a page that has no other text keeps it.

Edge cases: null or empty html gives empty text; broken or cut-off markup is
read as far as it goes; a page without host is its own group under the empty
host; pages equal in every tag share one expression; text is whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, materialised
from .urlfilter import host_of

#: One markup item: comment, element whose content is no text, declaration, tag, or a tag cut off by the end.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|title|select|button|object|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[A-Za-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div nav header footer aside form menu dialog figure table ul ol dl body".split())
DROPPED = frozenset("nav header footer aside form menu dialog".split())
#: Elements without content; they hold nothing that could be left out.
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
NEVER_OUT = VOID | frozenset("p li html head body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end where a sibling of these begins, if their end tag is missing.
SIBLINGS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Words of names of parts that are no article text.
CHROME = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side|widget|header|masthead|footer|foot|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus|complementary|contentinfo|dialog|skip|hidden|pagination|pager|toolbar|tags",
    re.I,
)
#: Words that may stand beside those in one name without changing what it says; any other makes it the name of something else.
BESIDE = re.compile(
    r"\d*|wp|block|site|page|global|main|primary|secondary|top|bottom|left|right|inner|outer|mobile|desktop|sticky|fixed|box|bar|area|section|container|wrap|wrapper|panel|holder|slot|unit|group|row|col|column|list|item|items|link|links|button|buttons|btn|icon|icons|form|posts|articles|stories|sense|google|front|css|js|widgets|menus|us|to|up",
    re.I,
)
#: Parts that hold articles of their own, which are not the page's.
COMPANION = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|widget|related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus", re.I)
#: Longest period that folding looks for.
PERIOD = 12
#: Distinct pages that must show a text in a slot before it counts as the template's.
FIXED_PAGES = 3
#: Rank of a template's text: kept where a page has no other.
TEMPLATE = 5


def _attributes(attributes: str) -> list[tuple[str, list[str]]]:
    return [(m[1].lower(), m[2].strip("\"'").split()) for m in NAMED.finditer(attributes)] if attributes else []


def _names(attributes: str) -> str:
    return " ".join(n for _, names in _attributes(attributes) for n in names)


def walk(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes) with kind text, space, open or close; text is decoded, inline markup left out."""
    at = 0
    for m in MARKUP.finditer(html):
        if m.start() > at:
            yield "text", unescape(html[at : m.start()]), ""
        at = m.end()
        if m[3]:
            name = m[3].lower()
            if name == "br":
                yield "space", "br", ""
            elif name not in INLINE:
                yield ("close" if m[2] else "open"), name, "" if m[2] else m[4]
    if at < len(html):
        yield "text", unescape(html[at:]), ""


def words_of(name: str) -> list[str]:
    return re.split(r"[-_]+", name)


def is_chrome(name: str) -> bool:
    """Whether a whole class, id or role names a part that is no article text: ``has-sidebar`` or ``side-effects`` does not."""
    parts = words_of(name)
    return any(CHROME.fullmatch(p) for p in parts) and all(CHROME.fullmatch(p) or BESIDE.fullmatch(p) for p in parts)


def dropped_by(name: str, attributes: str, inside: bool) -> str:
    """Why a container is left out: ``tag``, ``name``, ``companion`` (a name of a part with articles of its own) or nothing.

    inside: within an article, whose own header holds its title.  A heading or
    section is not left out for its id, which is often a slug of its title.
    """
    if name in NEVER_OUT:
        return ""
    if name in DROPPED and not (name == "header" and inside):
        return "tag"
    slug = name in HEADINGS or name in ("section", "article", "main")
    found = [n for kind, names in _attributes(attributes) if not (slug and kind == "id") for n in names if is_chrome(n)]
    if name in HEADINGS or name == "header":
        found = [n for n in found if not any(w.lower() in ("header", "masthead", "banner") for w in words_of(n))]
    if not found:
        return ""
    return "companion" if any(COMPANION.fullmatch(w) for n in found for w in words_of(n)) else "name"


#: Mark of a container that is left out, at the end of its signature.
OUT = "!"
Path = tuple[str, ...]


def signature(name: str, names: str, out: bool) -> str:
    return (f"{name}.{names.split()[0]}" if names else name) + OUT * out


def opens_container(token: str) -> bool:
    return token.endswith(OUT) or token.split(".")[0] in CONTAINERS


class Reader:
    """Tokens of a page and its blocks of text, each with the path of its containers."""

    def __init__(self, html: str):
        held = self._read(html, frozenset())
        if held and not any(rank(path, None) in (1, 2) for _, path in self.blocks):
            self._read(html, held)  # what a name marks holds the page's only article

    def _read(self, html: str, spared: frozenset[int]) -> frozenset[int]:
        """Read the page; returns the places of elements left out by name that hold an article or <main>."""
        self.blocks: list[tuple[str, Path]] = []
        self.tokens: list[str] = []
        stack: list[str] = []
        marks: list[tuple[int, str]] = []  # beside the stack: place of the element, why it is left out
        held: set[int] = set()
        parts: list[str] = []

        def end_block() -> None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.tokens.append("#")
                self.blocks.append((text, tuple(stack)))

        for place, (kind, name, attributes) in enumerate(walk(html)):
            if kind == "text":
                parts.append(name)
            elif kind == "space":
                parts.append(" ")
            else:
                end_block()
                if kind == "open":
                    while stack and tag(stack[-1]) in SIBLINGS.get(name, ()):
                        stack.pop()
                        marks.pop()
                    inside = any(tag(s) in ("article", "main") for s in stack)
                    why = "" if place in spared else dropped_by(name, attributes, inside)
                    if name in ("article", "main") and not why and not any(w in ("tag", "companion") for _, w in marks):
                        held.update(p for p, w in marks if w == "name")
                    token = signature(name, _names(attributes), bool(why))
                    self.tokens.append(f"<{token}>")
                    if opens_container(token):
                        stack.append(token)
                        marks.append((place, why))
                elif any(tag(s) == name for s in stack):
                    self.tokens.append(f"</{name}>")
                    while True:
                        marks.pop()
                        if tag(stack.pop()) == name:
                            break
        end_block()
        return frozenset(held)

    def mass(self) -> dict[str, int]:
        """Characters of text by its innermost container, of what is not left out."""
        out: dict[str, int] = {}
        for text, path in self.blocks:
            if rank(path, None):
                key = path[-1] if path else ""
                out[key] = out.get(key, 0) + len(text)
        return out

    def slots(self) -> Iterator[tuple[Path, list[int]]]:
        """The text slots of the page's own expression: containers and the blocks that fill each."""
        number = iter(range(len(self.blocks)))
        return slots_of(expression([["#", [next(number)]] if t == "#" else [t] for t in self.tokens]))

    def main_text(self, fixed: frozenset[int], main: str | None) -> str:
        """The blocks of the best rank.  A block outside of articles that fills its slot with a text the wrapper fixes ranks last."""
        ranks = [rank(path, main) for _, path in self.blocks]
        if fixed and min((r for r in ranks if r), default=0) > 2:
            for path, filled in self.slots():
                if slot_key(path, self.value(filled)) in fixed:
                    for i in filled:
                        ranks[i] = ranks[i] and TEMPLATE
        best = min((r for r in ranks if r), default=0)
        return " ".join(t for r, (t, _) in zip(ranks, self.blocks, strict=True) if r == best) if best else ""

    def value(self, filled: list[int]) -> int:
        """A number for the texts that fill a slot, in order."""
        return signed("\n".join(self.blocks[i][0] for i in filled))


def tag(signature_: str) -> str:
    return signature_.rstrip(OUT).split(".")[0]


def rank(path: Path, main: str | None) -> int:
    """0 for a slot that is left out, else 1 in an article, 2 in <main>, 3 in the host's main container, 4 elsewhere."""
    if any(s.endswith(OUT) for s in path):
        return 0
    names = {tag(s) for s in path}
    return 1 if "article" in names else 2 if "main" in names else 3 if main and main in path else 4


def signed(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "replace")), "big", signed=True)


def slot_key(path: Path, value: int) -> int:
    return signed(f"{'/'.join(path)} {value}")


def slots_of(parts: list) -> Iterator[tuple[Path, list]]:
    """Every text slot of an expression in order: its containers and what it holds."""
    stack: list[str] = []

    def visit(parts: list) -> Iterator[tuple[Path, list]]:
        for part in parts:
            if part[0] == "#":
                yield tuple(stack), part[1]
            elif len(part) > 1:
                yield from visit(part[1])
            elif part[0].startswith("</"):
                name = part[0][2:-1]
                if any(tag(s) == name for s in stack):
                    while tag(stack.pop()) != name:
                        pass
            elif opens_container(part[0][1:-1]):
                stack.append(part[0][1:-1])

    return visit(parts)


# An expression is a list of parts: [tag], ["#", what the slot holds], ["+", parts] or ["?", parts].
# A slot of a page holds the numbers of its blocks; one of a wrapper the only text that fills it
# (by number, None if texts differ) and the number of pages that were seen to fill it.
Held = Callable[[list, list], list]


def shape(part: list) -> tuple:
    """A part without what its slots hold."""
    return (part[0], tuple(shape(p) for p in part[1])) if part[0] in ("+", "?") else (part[0],)


def filled_too(a: list, b: list) -> list:
    """A wrapper's slot filled by the pages of both: their text if it is one, else a slot for any text."""
    return [a[0] if a[0] == b[0] else None, a[1] + b[1]]


def joined(a: list, b: list, held: Held) -> list:
    """One part for two of the same shape."""
    if a[0] == "#":
        return ["#", held(a[1], b[1])]
    return [a[0], [joined(x, y, held) for x, y in zip(a[1], b[1], strict=True)]] if len(a) > 1 else a


def folded(parts: list, held: Held = filled_too) -> list:
    """Adjacent parts of one shape become ("+", part); shortest period first, left to right."""
    keys = [shape(p) for p in parts]
    for period in range(1, len(parts) // 2 + 1):
        if period > PERIOD:
            break
        out, out_keys, i = [], [], 0
        while i < len(parts):
            unit, key, j = parts[i : i + period], keys[i : i + period], i + period
            while len(key) == period and keys[j : j + period] == key:
                unit = [joined(a, b, held) for a, b in zip(unit, parts[j : j + period], strict=True)]
                j += period
            if j > i + period:
                out.append(unit[0] if period == 1 and key[0][0] == "+" else ["+", unit])
                out_keys.append(shape(out[-1]))
                i = j
            else:
                out.append(parts[i])
                out_keys.append(keys[i])
                i += 1
        parts, keys = out, out_keys
    return parts


def expression(parts: list) -> list:
    """Union-free expression of one page, from its tags and its blocks."""
    return folded(parts, lambda a, b: a + b)


def aligned(a: list, b: list) -> list:
    """The least general union-free expression found that covers both.

    Parts equal with their texts are aligned first.  In what lies between, parts
    of one shape are aligned and texts that differ become slots; of the rest each
    mismatch is resolved as repeated or optional.
    """
    out: list = []

    def texts(part: list) -> object:
        return (part[0], part[1][0]) if part[0] == "#" else (part[0], tuple(texts(p) for p in part[1])) if len(part) > 1 else part[0]

    for kind, i, j, k, n in SequenceMatcher(None, [texts(x) for x in a], [texts(x) for x in b], autojunk=False).get_opcodes():
        left, right = a[i:j], b[k:n]
        if kind == "equal":
            out += [joined(x, y, filled_too) for x, y in zip(left, right, strict=True)]
            continue
        left, right = folded(left), folded(right)
        for kind_, i_, j_, k_, n_ in SequenceMatcher(None, [shape(x) for x in left], [shape(x) for x in right], autojunk=False).get_opcodes():
            if kind_ == "equal":
                out += [joined(x, y, filled_too) for x, y in zip(left[i_:j_], right[k_:n_], strict=True)]
            else:
                _resolve(out, left[i_:j_], right[k_:n_])
    return folded(out)


def _resolve(out: list, left: list, right: list) -> None:
    """Append to ``out`` what covers two parts that do not match: a group both are in, or each as repeated or optional."""
    if len(left) == len(right) == 1 and left[0][0] == right[0][0] and left[0][0] in ("+", "?"):
        out.append([left[0][0], aligned(left[0][1], right[0][1])])
        return
    for one, group in ((left, right), (right, left)):  # one page has the part once, the other repeats it
        if one and len(group) == 1 and group[0][0] == "+" and [shape(p) for p in group[0][1]] == [shape(p) for p in one]:
            out.append(["+", [joined(x, y, filled_too) for x, y in zip(group[0][1], one, strict=True)]])
            return
    for part in (left, right):
        if not part:
            continue
        keys = [shape(p) for p in part]
        if len(part) == 1 and part[0][0] == "?":
            keys, part = [shape(p) for p in part[0][1]], part[0][1]
        elif [shape(p) for p in out[-len(part) :]] == keys:  # repeats what stands before it
            out[-len(part) :] = [["+", [joined(x, y, filled_too) for x, y in zip(out[-len(part) :], part, strict=True)]]]
            continue
        last = out[-1] if out else [""]
        if last[0] in ("+", "?") and [shape(p) for p in last[1]] == keys:
            out[-1] = [last[0], [joined(x, y, filled_too) for x, y in zip(last[1], part, strict=True)]]
        else:
            out.append(["?", part])


def rendered(parts: list) -> str:
    """An expression as text; a slot with one text on all pages is shown as =."""
    return " ".join(("#" if p[1][0] is None else "=") if p[0] == "#" else p[0] if len(p) == 1 else f"( {rendered(p[1])} ){p[0]}" for p in parts)


def fixed_by(wrapper: list, pages: int) -> list[int]:
    """Keys of the texts that the wrapper fixes: one text in a slot, on FIXED_PAGES pages and half of the host's at least."""
    return sorted({slot_key(path, value) for path, (value, n) in slots_of(wrapper) if value is not None and n >= FIXED_PAGES and 2 * n >= pages})


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper, fixed, main``: wrapper, keys of its fixed texts and main container for every host.

    Pages of a host that are equal in every text count once.  Pages of one
    expression are put together by aggregation, slot by slot; distinct
    expressions are aligned in about as many groups as each group has members.
    """
    schema = "host string, expression string, texts array<long>, container string, mass long"
    kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64())

    def read(part: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            page = Reader(html or "")
            number = iter(range(len(page.blocks)))
            parts = expression([["#", [next(number)]] if t == "#" else [t] for t in page.tokens])
            texts = [page.value(filled) for _, filled in slots_of(parts)]
            rows.append((host, json.dumps([shape(p) for p in parts]), texts, None, None))
            rows += [(host, None, None, c, n) for c, n in page.mass().items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["host", "expression", "texts", "container", "mass"])

    seen = map_slices(pages.select(host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html")), "_html", schema, read)
    seen = materialised(seen.groupBy("host", "expression", "texts", "container").agg(F.sum("mass").alias("mass")))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out: list | None = None
        for text in sorted(group["wrapper"], key=lambda x: (len(x), x)):
            now = json.loads(text)
            out = now if out is None else aligned(out, now)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(out)], "pages": [int(group["pages"].sum())]})

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, n, slots in zip(*(batch.column(c).to_pylist() for c in ("expression", "pages", "slots")), strict=True):
                texts = iter(slots or [])
                out.append(json.dumps(_with_texts(json.loads(text), texts, n)))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string()), batch.column("pages")], names=["host", "wrapper", "pages"])

    by_slot = seen.where("expression is not null").select("host", "expression", F.posexplode_outer("texts").alias("at", "text"))
    by_slot = by_slot.groupBy("host", "expression", "at").agg(F.count("*").alias("pages"), F.when(F.min("text") == F.max("text"), F.min("text")).alias("text"))
    shapes = by_slot.groupBy("host", "expression").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("slots"))
    shapes = shapes.select("host", "expression", "pages", F.col("slots.text").alias("slots"))
    shapes = materialised(shapes.mapInArrow(filled, "host string, wrapper string, pages long"))
    counted = shapes.groupBy("host").agg(F.ceil(F.sqrt(F.count("*"))).alias("salts"))
    parts = shapes.join(counted, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.col("salts")))
    parts = parts.select("host", "wrapper", "pages", "salt").groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string, pages long")
    wrappers = parts.groupBy("host").applyInPandas(
        lambda group: merge(group).assign(fixed=lambda d: [fixed_by(json.loads(w), n) for w, n in zip(d["wrapper"], d["pages"], strict=True)])[["host", "wrapper", "fixed"]],
        "host string, wrapper string, fixed array<long>",
    )
    main = seen.where("container is not null and container not in ('', 'body')").groupBy("host").agg(F.max_by("container", F.struct("mass", "container")).alias("main"))
    return wrappers.join(main, "host", "left")


def _with_texts(shapes: list, texts: Iterator[int | None], pages: int) -> list:
    return [["#", [next(texts), pages]] if s[0] == "#" else [s[0], _with_texts(s[1], texts, pages)] if len(s) > 1 else s for s in shapes]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars, main`` for every page."""
    wrappers = materialised(infer(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(wrappers.drop("wrapper"), "host", "left").select("_id", "_url", "_html", "fixed", "main")
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, url_col, "text", "n_chars", "main"]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = (part.column(c).to_pylist() for c in ("_html", "fixed", "main"))
        texts = [Reader(h or "").main_text(frozenset(f or ()), m) for h, f, m in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column("main")], names=names)

    return map_slices(rows, "_html", f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long, main string", work)
