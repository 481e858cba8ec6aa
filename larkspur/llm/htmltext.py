"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of the same host.

Method. A page is cut into tags and texts, its blocks. A host's wrapper is union-free: the slots that its pages have, known by their tag
paths, each once, repeated or optional as pages have it; pages with an article (or main) element and pages without one are
two layouts with a wrapper each. All distinct pages and all their blocks count. A block is content if it lies
in the article and in no part that tag or class names mark as menu, header, footer, sidebar, notice,
advert, form or comments; in pages without article, if it is mostly not links. Where the blocks of a slot differ in this, the slot decides: it is content
if one of its blocks lies in the article, or if its blocks are mostly not links on average. Slots that at most one page
has are judged by that page alone, and marks on the page itself always count. Template text is counted over all distinct pages and blocks of a host: a text
that `SHARE` of the pages with its path have, `ARTICLE_PAGES` of them at least inside articles and two elsewhere. A page's text
is that of the blocks on content paths without template text. A page whose article holds nothing else keeps it, as
near copies of one page are no evidence of a template.

Output. Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.

Scale. One pass over the pages gives the blocks of each slot as counts and its texts as hashes; these are aggregated by host, layout and path, so that no host is held by
one task. Of a wrapper only the slots whose blocks differ stay (the others are as each block says), and template texts; pages meet their host's wrapper by a broadcast while hosts are few
(`HOSTS`) and by a shuffle otherwise (AQE splits hot hosts). A page is worked on alone, whatever its host's size.

Edge cases. Null and empty html give the empty text. A null url is a host of its own, the empty one. Broken markup (tags left
open, pages cut off) is closed where the next block or the page ends. Pages of any length and depth are read whole, in time linear in both.
Repeated rows each get a row; a column text is replaced, others may have any name. Empty tables give empty results.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import durable, read_table, small_side

#: Hosts up to which wrappers are broadcast.
HOSTS = 2000
#: Parts of a block that its share of links is counted in.
PARTS = 1_000_000
#: Share of the pages with a path that have a template text, and how many there must be at least inside articles.
SHARE, ARTICLE_PAGES = 0.8, 3

# HTML element names.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template iframe textarea svg math canvas object audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = set("head title nav footer aside form button select menu dialog fieldset".split()) | RAW
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsors?|sponsored|promos?|promoted|banners?|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|newsletter|subscribe|"
    r"subscription|sidebars?|menus?|navs?|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|comments?|commentlist|discussion|respond|replies|disqus|related|recommended|shares?|sharing|"
    r"social|widgets?|toolbar|pagination|pager|copyright|login|signin|signup|search|skip)(?:$|[\s_-])",
    re.I,
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, marks): open, close or text."""
    at, end = 0, len(page)
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        marks = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in _ATTR.findall(m[3])) if "=" in m[3] else ""
        if name in RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        yield "open", name, marks
    if at < end:
        yield "text", page[at:], ""


def _skips(name: str, marks: str, inside: bool) -> bool:
    if name in SKIPPED or (name == "header" and not inside):
        return True
    if not marks or name in ("html", "body", "article", "main"):
        return False
    values = dict(x.split("=", 1) for x in re.findall(r"(?:class|id|role|hidden|aria-hidden)=[^=]*(?= \S+=|$)", marks))
    return bool(MARKS.search(values.get("class", "")) or MARKS.search(values.get("id", "")) or values.get("role", "").lower() in ROLES or values.get("aria-hidden", "").lower() == "true")


class _Open:
    """The open elements of a page, innermost last, as (name, path, skipped, inside the article), and how many there are of each name."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        self.count: Counter[str] = Counter()

    def top(self) -> tuple[str, str, bool, bool]:
        return self.stack[-1]

    def push(self, *element) -> None:
        self.stack.append(element)
        self.count[element[0]] += 1

    def cut(self, at: int) -> None:
        """Closes all elements from place `at` on."""
        for element in self.stack[at:]:
            self.count[element[0]] -= 1
        del self.stack[at:]

    def last(self, name: str, within: set[str] | None = None, beyond: tuple[str, ...] = ()) -> int:
        """Place of the innermost element so named, 0 if there is none; what is open in it must be `within` these names and not one of `beyond`."""
        if self.count[name]:
            for at in range(len(self.stack) - 1, 0, -1):
                here = self.stack[at][0]
                if here == name:
                    return at
                if here in beyond or (within is not None and here not in within):
                    break
        return 0


def _step(path: str, name: str, marks: str) -> str:
    """The tag path of an element: a hash of its parent's, its name and its classes, so that deep pages have short paths."""
    cls = re.search(r"class=([^=]*?)(?: \S+=|$)", marks)
    return xxhash.xxh64_hexdigest("\0".join((path, name, *(sorted(cls[1].split()) if cls else ()))).encode("utf-8", "surrogatepass"))


def blocks(page: str) -> Iterator[tuple[str, str, bool, bool, int]]:
    """(tag path, raw text, skipped, inside the article, characters in links) of each block with text, in page order."""
    tree = _Open()
    text: list[str] = []
    where, links = ("", False, False), 0

    def flush() -> Iterator[tuple[str, str, bool, bool, int]]:
        nonlocal links
        if text and (raw := "".join(text)).strip():
            yield where[0], raw, where[1], where[2], links
        text.clear()
        links = 0

    for kind, name, marks in tokens(page):
        if kind == "text":
            if not text:
                where = tree.top()[1:]
            text.append(name)
            links += len(name) * (tree.count["a"] > 0)
        elif name in INLINE and not (kind == "open" and _skips(name, marks, tree.top()[3])):
            if kind == "open" and name == "a":
                tree.push(name, *tree.top()[1:])
            elif kind == "close" and (at := tree.last(name, within=INLINE)):
                was = tree.stack[at][2]
                tree.cut(at)
                if was != tree.top()[2]:
                    yield from flush()
        else:
            yield from flush()
            if kind == "open":
                while tree.top()[0] == "a":
                    tree.cut(len(tree.stack) - 1)
                if name in CLOSES_P and (at := tree.last("p", beyond=("article", "div", "section", "td", "li", "main"))):
                    tree.cut(at)
                if name in ("li", "option", "tr", "td", "th", "dt", "dd") and tree.top()[0] == name:
                    tree.cut(len(tree.stack) - 1)
                if name in VOID:
                    continue
                _, path, skip, inside = tree.top()
                main = name in ("article", "main") or "role=main" in marks
                tree.push(name, _step(path, name, marks), skip or _skips(name, marks, inside), inside or (main and not skip))
            elif at := tree.last(name):
                tree.cut(at)
    yield from flush()


def neat(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def _has_main(found: list[tuple[str, str, bool, bool, int]]) -> bool:
    return any(inside and not skip for _, _, skip, inside, _ in found)


def _hash(*parts: object) -> int:
    x = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _rule(main: bool, raw: str, inside: bool, links: int) -> bool:
    """Whether a block without marks is content by itself."""
    return inside if main else links < 0.5 * len(raw)


def extract(page: str | None, paths: dict[str, dict[str, bool]] | None = None, template: frozenset[int] = frozenset()) -> str:
    """Text of a page, given what its host's wrappers say about paths and the hashes of its host's template texts."""
    found = list(blocks(page or ""))
    has_main = _has_main(found)
    known = (paths or {}).get(str(int(has_main)), {})
    kept, plain = [], []
    for path, raw, skip, inside, links in found:
        rule = _rule(has_main, raw, inside, links)
        # marks on the page itself always count
        if not skip and known.get(path, rule) and (t := neat(raw)):
            (plain if template and _hash(int(has_main), path, t) in template else kept).append(t)
    return "\n".join(kept or (plain if has_main else []))


def host_of(url: str) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^(?:www|m|mobile|amp)\.", "")


SLOTS = pa.schema([("host", pa.string()), ("lot", pa.int64()), ("main", pa.int32()), ("path", pa.int64()), ("text", pa.int64()), ("blocks", pa.int64()), ("links", pa.int64()), ("every", pa.bool_()), ("some", pa.bool_())])


def _page_slots(page: str) -> Iterator[tuple]:
    """(main, path, text, blocks, links, every, some) of a page: a row for each path, then one for each text on it with its hash."""
    found = list(blocks(page))
    main = _has_main(found)
    by_path: dict[str, list[tuple[str, int, bool]]] = {}
    for path, raw, skip, inside, links in found:
        if not skip:
            by_path.setdefault(path, []).append((neat(raw), PARTS * min(links, len(raw)) // max(1, len(raw)), _rule(main, raw, inside, links)))
    for path, here in by_path.items():
        known = int(path, 16) - (int(path, 16) >> 63 << 64)
        yield int(main), known, None, len(here), sum(x[1] for x in here), all(x[2] for x in here), any(x[2] for x in here)
        for text in {x[0] for x in here}:
            yield int(main), known, _hash(int(main), path, text), None, None, None, None


def slots(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The slots of all distinct pages of each host, as `SLOTS` names them: rows of paths (text is null) and of texts."""
    x = pages.select(host_of(url).alias("h"), F.xxhash64(page).alias("lot"), F.coalesce(page, F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, lot, *row) for h, lot, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) for row in _page_slots(p.as_py())]
            cols = list(zip(*rows)) or [()] * len(SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SLOTS)], schema=SLOTS)

    return x.mapInArrow(run, "host string, lot long, main int, path long, text long, blocks long, links long, every boolean, some boolean").distinct()


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, paths): JSON of what each host's wrappers say about slots whose blocks differ, and of the hashes of its template texts."""
    x = durable(slots(pages, url, page))
    by = ["host", "main", "path"]
    seen = x.where("text is null").groupBy(by).agg(F.count("*").alias("n"), F.sum("blocks").alias("blocks"), F.sum("links").alias("links"), F.every("every").alias("every"), F.some("some").alias("some"))
    content = (F.col("main") == 1) | (2 * F.col("links") < PARTS * F.col("blocks"))
    paths = seen.where("n > 1 and some and not every").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("main", "path", content.alias("content")))).alias("paths"))
    same = x.where("text is not null").groupBy(*by, "text").agg(F.count("*").alias("same")).where(F.col("same") >= F.when(F.col("main") == 1, ARTICLE_PAGES).otherwise(2))
    texts = same.join(seen.select(*by, "n"), by).where(F.col("same") >= SHARE * F.col("n")).groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    return paths.join(texts, "host", "full").select("host", F.to_json(F.struct("paths", "texts")).alias("paths"))


def _known(paths: list[dict]) -> dict[str, dict[str, bool]]:
    """What wrappers say about paths, by layout and path."""
    out: dict[str, dict[str, bool]] = {}
    for x in paths:
        out.setdefault(str(x["main"]), {})[f"{x['path'] % (1 << 64):016x}"] = x["content"]
    return out


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """pages with a text column (replaced if there is one)."""
    known = durable(wrappers(pages, url, page))
    keep = [c for c in pages.columns if c != "text"]
    x = pages.select(F.struct(*keep).alias("row"), host_of(url).alias("h"), F.col(page).alias("html"))
    x = x.join(small_side(known, known.count(), HOSTS), x.h == known.host, "left").select("row", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str | None, tuple[dict, frozenset[int]]] = {None: ({}, frozenset())}
        for b in batches:
            texts = []
            for h, p in zip(b.column(1), b.column(2)):
                if (p := p.as_py()) not in cache:
                    if len(cache) > 200:
                        cache = {None: ({}, frozenset())}
                    host = json.loads(p)
                    cache[p] = (_known(host.get("paths", [])), frozenset(host.get("texts", [])))
                texts.append(extract(h.as_py(), *cache[p]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    schema = T.StructType([T.StructField("row", x.schema["row"].dataType), T.StructField("text", T.StringType())])
    return x.mapInArrow(run, schema).select("row.*", "text")


def op8_wrapper_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
