"""Main-text extraction from HTML with removal of each host's recurring template subtrees.

Method: every element subtree is hashed; Spark counts, per host, on how many different pages each hash
occurs; subtrees found on ``min_pages`` of them or more (and on ``min_share``; inside an article or main
element, where copies of an article recur too, on ``article_share``) are template and are deleted, beside
elements that are never article text (navigation, forms, ...).  Pages are parsed once for the hashes and once for the text; what joins them is one
row per subtree of a page and per template subtree of a host, never a host's list.

What an article element is: the outermost one (or main) lifts the marks that class words have put on the elements
around it, since page layouts are named after their parts; it never lifts those of tags (``aside``, ``footer``, ...), nor
those of an element that is named, as a whole, after reader comments, related matter or the like.  An article so named
itself, or inside the article, is such matter: it goes.  A form goes unless it wraps the page: an article, or most of three or
more paragraphs.  An article's own ``header`` goes with what it holds, as headers do.

Edge cases: null or empty html gives the empty text; broken or unclosed markup is closed where
HTML closes it; pages without a host form one host; repeated page rows are all kept and count as one page;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm._common import staged, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
    "tbody tfoot thead tr ul caption".split()
)
#: Elements that are never article text.
DROP = frozenset(
    "head script style noscript template iframe object embed svg canvas nav header footer aside form button "
    "select textarea input label dialog menu title audio video".split()
)
#: Words of class, id or role that mark boilerplate on any element but headings, article, main and body.
DROP_WORDS = frozenset(
    "ad ads adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert sidebar aside menu menubar nav navbar navigation "
    "breadcrumb breadcrumbs toolbar masthead footer header comment comments disqus reply replies respond "
    "newsletter subscribe subscription signup login share sharing social related recommended popup modal "
    "overlay search contentinfo complementary".split()
)
_SAFE = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Whole names of elements that hold articles which are not the page's: readers' and others'.
SECONDARY = frozenset(
    "comment comments commentlist comment-list comment-body comment-thread comments-area reply replies respond disqus disqus_thread "
    "related related-posts recommended".split()
)
#: First parts of a class name that tell about a page's parts, and last parts that name article matter.
_ABOUT = frozenset("has with without no not is".split())
_MATTER = frozenset("article articles body content copy text story post price policy result results page".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body table td th caption button object template article section div ul ol dl".split())


class Page:
    """A parsed page: parallel arrays of nodes in document order and the text pieces between them."""

    def __init__(self, source: str) -> None:
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.dropped: list[bool] = [False]
        self.by_name: list[bool] = [False]  # dropped by a class word, which an article inside may lift
        self.secondary: list[bool] = [False]
        self.hashes: list[int] = [0]
        self.pieces: list[tuple[int, str | None]] = []  # a node's text, or None where a block begins or ends
        self._digests = {0: xxhash.xxh64(seed=1)}
        self._has_text = {0: False}
        self.textual: list[bool] = [False]
        self.within: list[bool] = [False]  # inside an article or main element, or one itself
        self._parse(source)

    def _open(self, tag: str, attributes: str, stack: list[int]) -> None:
        self.tags.append(tag)
        self.parents.append(stack[-1])
        aside = tag not in ("html", "body", "main") and _secondary(attributes)
        named = _boilerplate(tag, attributes)
        self.by_name.append(named and tag not in DROP)
        self.secondary.append(aside)
        self.dropped.append(tag in DROP or named or aside and tag == "article")
        if tag in ("article", "main") and not aside and not self.within[stack[-1]] and not any(self.secondary[n] for n in stack):
            for node in stack:  # an element that holds the article is no boilerplate
                self.dropped[node] &= not self.by_name[node]
        self.hashes.append(0)
        self.textual.append(False)
        self.within.append(self.within[stack[-1]] or tag in ("article", "main"))
        node = len(self.tags) - 1
        self._digests[node] = xxhash.xxh64(tag.encode(), seed=1)
        if tag in BLOCK:
            self.pieces.append((node, None))
        stack.append(node)

    def _close(self, stack: list[int]) -> None:
        node = stack.pop()
        value = self._digests.pop(node).intdigest()
        self.hashes[node] = value & ~1 | self.within[node]  # the lowest bit says where the subtree stands
        if stack:
            above = self._digests[stack[-1]]
            above.update(value.to_bytes(8, "little"))
            self.textual[stack[-1]] |= self.textual[node]
        if self.tags[node] in BLOCK:
            self.pieces.append((node, None))

    def _text(self, source: str, stack: list[int]) -> None:
        if source:
            text = html.unescape(source) if "&" in source else source
            self.pieces.append((stack[-1], text))
            if bare := " ".join(text.split()):
                self._digests[stack[-1]].update(b"\0" + bare.encode("utf-8", "surrogatepass"))
                self.textual[stack[-1]] = True

    def _parse(self, source: str) -> None:
        stack, at = [0], 0
        opened: dict[str, int] = {}  # how many elements of each tag are open

        def close() -> None:
            opened[self.tags[stack[-1]]] -= 1
            self._close(stack)

        while m := _TOKEN.search(source, at):
            self._text(source[at : m.start()], stack)
            at = m.end()
            slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                if m[0].startswith("<![CDATA["):
                    self._text(html.escape(m[0][9:].removesuffix("]]>")), stack)
                continue
            tag = name.lower()
            if slash:
                if opened.get(tag):
                    while self.tags[stack[-1]] != tag:
                        close()
                    close()
                elif tag == "br":
                    self.pieces.append((stack[-1], " "))
                continue
            if tag in BLOCK and opened.get("p"):
                for node in reversed(stack):
                    if self.tags[node] == "p":
                        while stack[-1] != node:
                            close()
                        close()
                        break
                    if self.tags[node] in _SCOPE:
                        break
            for other in (other for node in reversed(stack[-2:]) if (other := self.tags[node]) in _CLOSES.get(tag, ())):
                while opened.get(other) and self.tags[stack[-1]] != other:
                    close()
                if stack[-1] and self.tags[stack[-1]] == other:
                    close()
            if tag in VOID or attributes.endswith("/"):
                self.pieces.append((stack[-1], None if tag == "hr" else " " if tag == "br" else ""))
                if tag in VOID:
                    continue
            self._open(tag, attributes, stack)
            opened[tag] = opened.get(tag, 0) + 1
            if attributes.endswith("/") and tag not in BLOCK | RAW:
                close()
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                self._text(source[at : end.start() if end else len(source)], stack)
                at = (source.find(">", end.start()) + 1 or len(source)) if end else len(source)
                close()
            elif tag in ("td", "th"):
                self.pieces.append((stack[-1], " "))
        self._text(source[at:], stack)
        while len(stack) > 1:
            close()
        self._keep_wrapping_forms()

    def _keep_wrapping_forms(self) -> None:
        """A form around the page's article, or around most of its paragraphs, is no form to fill in."""
        if "form" not in self.tags:
            return
        paragraphs, articles = [t == "p" for t in self.tags], [t in ("article", "main") for t in self.tags]
        below, holds = list(map(int, paragraphs)), articles.copy()
        for i in range(len(self.tags) - 1, 0, -1):
            below[self.parents[i]] += below[i]
            holds[self.parents[i]] |= holds[i]
        for i, tag in enumerate(self.tags):
            if tag == "form" and (holds[i] or below[i] >= 3 and 2 * below[i] > below[0]):
                self.dropped[i] = False

    def subtrees(self) -> set[int]:
        """Hashes of the element subtrees that hold text and could be template."""
        gone = self._gone(frozenset())
        return {
            h
            for h, tag, textual, out in zip(self.hashes, self.tags, self.textual, gone)
            if textual and not out and tag not in ("#root", "html", "body")
        }

    def _gone(self, template: frozenset[int]) -> list[bool]:
        out: list[bool] = []
        for drop, parent, h in zip(self.dropped, self.parents, self.hashes):
            out.append(drop or (parent >= 0 and out[parent]) or h in template)
        return out

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """Blocks in page order, joined by an empty line, without dropped and template subtrees."""
        gone = self._gone(template)
        roots = {i for i, t in enumerate(self.tags) if t == "article" and not gone[i]} or {
            i for i, t in enumerate(self.tags) if t == "main" and not gone[i]
        }
        inside = [not roots]
        for i in range(1, len(self.tags)):
            inside.append(inside[self.parents[i]] or i in roots)
        blocks, current = [], []
        for node, piece in self.pieces:
            if piece is None:
                blocks.append(current)
                current = []
            elif inside[node] and not gone[node]:
                current.append(piece)
        blocks.append(current)
        clean = (" ".join("".join(b).split()) for b in blocks if b)
        return "\n\n".join(b for b in clean if b)


def _secondary(attributes: str) -> bool:
    """Whether some whole class name, id or role is one of ``SECONDARY``."""
    if not attributes or "=" not in attributes:
        return False
    return any(name in SECONDARY for m in _ATTRIBUTE.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").lower().split())


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in _SAFE or not attributes or "=" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = [p for p in _PART.split(name) if p and not p.isdigit()]
            # A name counts as a whole or by its affixes (``cookie-bar``, ``post-comments``), not when it speaks
            # of having or lacking a part (``has-sidebar``, ``no-ads``).
            if parts and parts[0] not in _ABOUT and not (len(parts) > 1 and parts[-1] in _MATTER):
                if name in DROP_WORDS or parts[0] in DROP_WORDS or parts[-1] in DROP_WORDS:
                    return True
    return False


def _signed(values: set[int]) -> list[int]:
    return np.fromiter(values, np.uint64, len(values)).astype(np.int64).tolist()


def _hash_batches(batches):
    for batch in batches:
        hosts, pages, found = [], [], []
        for host, page, source in zip(*(batch[c].to_pylist() for c in ("host", "page", "html"))):
            own = _signed(Page(source or "").subtrees())
            hosts += [host] * len(own)
            pages += [page] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosts, pages, found)], ["host", "page", "subtree"])


def _pack_batches(batches):
    """The pages' source compressed, since it is the one large thing that is shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [pack((x or "").encode("utf-8", "surrogatepass")) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["page"], pa.array(packed, pa.binary())], ["page_id", "url", "page", "packed"])


def _text_batches(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts = [
            Page(unpack(source).decode("utf-8", "surrogatepass")).text(frozenset(np.array(known or [], np.int64).astype(np.uint64).tolist()))
            for source, known in zip(batch["packed"].to_pylist(), batch["template"].to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def page_templates(pages: DataFrame, min_pages: int = 10, min_share: float = 0.05, article_share: float = 0.5) -> DataFrame:
    """``page, template`` (those of its own subtrees that are template) of the pages of ``pages(host, page, html)``
    that hold any; host and page are hashes, and rows with one page hash are one page."""
    marks = staged(pages.mapInArrow(_hash_batches, "host bigint, page bigint, subtree bigint").distinct(), "subtrees")
    per_host = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    counts = marks.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    share = F.when(F.col("subtree").bitwiseAND(F.lit(1)) == 1, article_share).otherwise(min_share)
    template = staged(counts.join(per_host, "host").where(F.col("n") >= F.col("n_pages") * share).select("host", "subtree"), "templates")
    return marks.join(template, ["host", "subtree"]).groupBy("page").agg(F.collect_list("subtree").alias("template"))


def extract_main_text(pages: DataFrame, min_pages: int = 10, min_share: float = 0.05, article_share: float = 0.5) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages(page_id, url, html)``."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)), F.lit(""))
    own = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"), F.xxhash64(host, F.coalesce("html", F.lit(""))).alias("page"))
    template = page_templates(own.select("host", "page", "html"), min_pages, min_share, article_share)
    packed = own.select("page_id", "url", "page", "html").mapInArrow(_pack_batches, "page_id bigint, url string, page bigint, packed binary")
    return packed.join(template, "page", "left").select("page_id", "url", "packed", "template").mapInArrow(_text_batches, "page_id bigint, url string, text string")


def query(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract_main_text(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))
