"""Main text of web pages by tree scoring.

A page is read once into a flat tree (parent links) and a list of text blocks. Each block gives
points, one plus its commas plus one per hundred characters (three at most), times its share of
text outside links, to its container, half to the next one up, and falling shares beyond. The
container with the most points, discounted by its own link density, wins; an ``article`` or
``main`` around it stands for it; siblings with a fifth of its points, or that are prose
paragraphs, are kept too. Navigation, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are cut before scoring, by element, role and the words of class and id.

Character references are decoded, white space (and ``br``) in a block becomes one space, blocks are
joined by one line feed in page order. Defined cases: null, empty and text-free pages have an empty
text; unclosed elements end with their parents; a tag cut off by the page's end is dropped; very long
pages are read whole, and deep nesting costs neither recursion nor a walk through what is open; repeated rows are extracted each; extra columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.textbytes import slices
from siltstone.runtime import small_batches

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<(?:/|[a-zA-Z])[^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"']+)")
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# Fixed sets of HTML elements, roles, and words of class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption address summary".split())
CUT = frozenset(
    "head script style noscript template iframe object embed svg canvas math audio video map nav footer aside form button select textarea input label "
    "fieldset dialog menu header title noembed noframes xmp".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar tablist form note status".split())
CUT_WORDS = frozenset(
    "ad ads adv alert alerts advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright discussion disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "paywall popup promo promoted promotion recommended recommendations related remark replies reply respond share sharing shareaholic sidebar signup skip "
    "social sponsor sponsored subscribe subscription toc toolbar widget".split()
)
#: Inside an article these words stand for its title or closing line, not the page's.
TITLE_WORDS = frozenset(["header", "masthead"])
WORDS_IN_ARTICLE = CUT_WORDS - TITLE_WORDS
SAFE = frozenset("html body article main".split())
#: An open element that a start tag ends, and the elements beyond which it is not looked for.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "body": (frozenset(["head"]), frozenset()),
}
P_LIMITS = frozenset("table td th caption button object template html body".split())
LEVELS = 6


def _cut(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in CUT and not (tag == "header" and inside_article):
        return True
    if not attrs.strip("/ \n\t"):
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name = (m[1] or m[5]).lower()
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "role" and tag not in SAFE and value.strip() in CUT_ROLES:
            return True
        if name in ("class", "id") and tag not in SAFE:
            raw = html.unescape(m[2] or m[3] or m[4] or "")
            words = {w.rstrip("0123456789") for w in WORDS.findall(value) + WORDS.findall(CAMEL.sub(" ", raw).lower())}
            if words & (WORDS_IN_ARTICLE if inside_article else CUT_WORDS):
                return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Page:
    """The flat tree: tag and parent of each node, and blocks (owner, text, characters in links)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.cut = ["#"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack, self.pieces, self.links = [0], [], 0
        # Places in the stack of the open elements of each tag, and of all open blocks.
        self.places: dict[str, list[int]] = {}
        self.open_blocks = [0]
        self.open_links = self.open_articles = 0
        self.read(source)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                owner = self.stack[self.open_blocks[-1]]
                if not self.cut[self.stack[-1]] or not self.cut[owner]:
                    self.blocks.append((owner, text, min(self.links, len(text))))
            self.pieces, self.links = [], 0

    def text(self, raw: str) -> None:
        if self.cut[self.stack[-1]]:
            return
        decoded = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(decoded)
        if self.open_links:
            self.links += len(" ".join(decoded.split()))

    def pop(self, keep: int) -> None:
        while len(self.stack) > keep:
            k = self.stack[-1]
            if self.tags[k] in BLOCK:
                self.flush()
                self.open_blocks.pop()
            self.places[self.tags[k]].pop()
            self.open_links -= self.tags[k] == "a"
            self.open_articles -= self.tags[k] in ("article", "main")
            self.stack.pop()

    def find(self, wanted: frozenset[str], limits: frozenset[str]) -> int:
        """Place in the stack of the innermost wanted element, or 0 where there is none or a limit is nearer."""
        at = self.innermost(wanted)
        beyond = self.open_blocks[-1] if limits is BLOCK else self.innermost(limits)
        return at if at >= beyond else 0

    def innermost(self, tags: frozenset[str]) -> int:
        return max((held[-1] for tag in tags if (held := self.places.get(tag))), default=0)

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.text(" ")
            return
        if tag in BLOCK:
            if tag not in ("html", "head", "body") and (at := self.find(frozenset(["head"]), frozenset(["body"]))):
                self.pop(at)
            self.flush()
            if at := self.find(frozenset(["p"]), P_LIMITS):
                self.pop(at)
        if tag in IMPLIED and (at := self.find(*IMPLIED[tag])):
            self.pop(at)
        if tag in VOID:
            return
        parent = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.cut.append(self.cut[parent] or _cut(tag, attrs, self.open_articles > 0))
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append(len(self.tags) - 1)
        self.open_links += tag == "a"
        self.open_articles += tag in ("article", "main")

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        elif at := self.find(frozenset([tag]), frozenset() if tag in BLOCK else BLOCK):
            self.pop(at)

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = MARKUP.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, attrs = tag.lower(), m["attrs"] if m["tag"] else m["attrs2"]
            if m["end"] or m["end2"]:
                self.end(tag)
                continue
            self.start(tag, attrs)
            if tag in RAW:
                close = re.compile(rf"</{tag}[^a-z0-9]", re.I).search(source, at)
                at = close.start() if close else size
        self.pop(0 if not self.stack else 1)
        self.flush()


def extract(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = _Page(source)
    if not page.blocks:
        return ""
    tags, parents, n = page.tags, page.parents, len(page.tags)
    score, length, linked = [0.0] * n, [0] * n, [0] * n
    for owner, text, links in page.blocks:
        length[owner] += len(text)
        linked[owner] += links
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - links / len(text))
        at = parents[owner] if tags[owner] in PARAGRAPH and owner else owner
        for level in range(LEVELS):
            if at < 0:
                break
            score[at] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            at = parents[at]
    for k in range(n - 1, 0, -1):
        length[parents[k]] += length[k]
        linked[parents[k]] += linked[k]
    final = [s * (1 - linked[k] / length[k]) if length[k] else 0.0 for k, s in enumerate(score)]
    best = max(range(n), key=lambda k: (final[k], -k))
    at = best
    while at > 0:
        if tags[at] in ("article", "main"):
            best = at
        at = parents[at]
    roots = {best}
    if best:
        bar = max(2.0, 0.2 * final[best])
        for k in range(1, n):
            if parents[k] == parents[best] and length[k] and not page.cut[k] and k != best:
                density = linked[k] / length[k]
                if final[k] >= bar or tags[k] in PARAGRAPH and density < 0.25 and length[k] > 80:
                    roots.add(k)
    kept = [False] * n
    for k in range(n):
        kept[k] = k in roots or k > 0 and kept[parents[k]]
    return "\n".join(text for owner, text, _ in page.blocks if kept[owner])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of (page_id, url, html)."""
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    pages = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
