"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm.common import small_batches

#: What HTML's own rules or common usage say about elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
ASIDE = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head object canvas audio video".split())
#: An opening tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
#: An implied end is not looked for beyond these.
_BARRIER = frozenset("table ul ol dl select article div section body".split())
CLOSES_P = BLOCK - frozenset("body caption head html legend option select summary tbody td tfoot th thead title tr".split())
#: Words of class, id or role that speak against an element: one signal of its path's value.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_CLOSE_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
#: Elements whose class or id tells one path from another.
NAMED = frozenset("article aside div dl form main nav ol section table ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold all of a page and so tell nothing of a part.
WHOLE = frozenset("html body".split())
#: Words that menus are made of, and what opens a notice of rights.
MENU = frozenset("about account blog careers cart contact cookies faq home help imprint legal login logout menu news policy press privacy products register search services sitemap support terms us".split())
_NOTICE = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)|.{0,80}\ball rights reserved\b", re.I | re.S)
#: Words of a text of the menu's words at most.
MENU_WORDS = 10
#: Weight of neighbours two and one away and of a node itself.
KERNEL = (0.06, 0.24, 0.40, 0.24, 0.06)
#: A path is chosen from this share of the highest value.
HIGHEST = 0.2
#: Factor of a path's value for an element of ASIDE or with a word of BOILERPLATE, or for a text that is a menu or notice.
AGAINST = 0.001


def _against(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if tag in ("html", "body", "main") or not attributes.strip():
        return False
    return bool(_HIDDEN.search(attributes)) or any(not BOILERPLATE.isdisjoint(_NAME.split((m[2] or m[3] or m[4] or "").lower())) for m in _MARK.finditer(attributes))


def _cue(text: str) -> str | None:
    """What a text outside articles says about itself: a notice of rights, or words of a menu without a sentence."""
    if _NOTICE.match(text):
        return "#notice"
    words = text.split(None, MENU_WORDS)
    menu = len(words) <= MENU_WORDS and 2 * sum(w.strip("|·•»>-/").lower() in MENU for w in words) > len(words)
    return "#menu" if menu and not PUNCTUATION.search(text) else None


class Block:
    """A run of text in one block element: its path (outermost first), text, characters in links, and the factor of
    the elements around it."""

    __slots__ = ("path", "text", "linked", "factor")

    def __init__(self, path: tuple[str, ...], text: str, linked: int, factor: float) -> None:
        self.path, self.text, self.linked, self.factor = path, text, linked, factor


class _Page:
    def __init__(self) -> None:
        self.stack: list[tuple[str, str, float]] = []  # tag, name in a path, factor
        self.depth: list[tuple[str, ...]] = [()]  # paths of the block elements that are open
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.open_tags: dict[str, int] = {}

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path, factor = self.depth[-1], self.stack[-1][2] if self.stack else 1.0
                if not (self.open_tags.get("article") or self.open_tags.get("main") or HEADING.intersection(path[-1:])) and (cue := _cue(text)):  # a path of its own
                    path, factor = (*path, cue), min(factor, AGAINST)
                self.blocks.append(Block(path, text, min(self.linked, len(text)), factor))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.open_tags.get("a"):
                self.linked += len(raw)

    def pop_to(self, k: int) -> None:
        if any(x[0] in BLOCK for x in self.stack[k:]):
            self.flush()
        for tag, *_ in self.stack[k:]:
            self.open_tags[tag] -= 1
            if tag in BLOCK:
                self.depth.pop()
        del self.stack[k:]

    def _imply_ends(self, tag: str) -> None:
        """Ends of elements that the opening of `tag` implies: found from the innermost on, up to the next container."""
        ends = CLOSES.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else frozenset())
        if not any(self.open_tags.get(x) for x in ends):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            over = self.stack[k][0]
            if over in ends:
                self.pop_to(k)
                return
            if over in _BARRIER:
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            else:
                self.parts.append(" " if tag in ("br", "wbr") else "")
            return
        self._imply_ends(tag)
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            return
        if tag in BLOCK:
            self.flush()
        factor = self.stack[-1][2] if self.stack else 1.0
        if factor > AGAINST and _against(tag, attributes):
            factor = AGAINST
        name = tag
        if tag in NAMED and (m := _MARK.search(attributes)):
            name += "." + (m[2] or m[3] or m[4] or "").lower()
        self.stack.append((tag, name, factor))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if tag in BLOCK:
            self.depth.append((*self.depth[-1], name))

    def close(self, tag: str) -> None:
        if self.open_tags.get(tag):
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.pop_to(k)
        elif tag in BLOCK:
            self.flush()


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order. Scripts, styles and comments have none."""
    out, at, n = _Page(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            break
        out.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            out.close(tag)
            continue
        out.open(tag, m[3] if m[2] else m[6] or "")
        if tag in RAW:
            end = _CLOSE_RAW[tag].search(page, at)
            at = end.end() if end else n
            out.close(tag)
    out.text(page[at:] if at < n else "")
    out.flush()
    return out.blocks


def ratios(found: list[Block]) -> dict[tuple[str, ...], float]:
    """The value of each path.

    Per path, text length and punctuation of all its nodes, each by node: their logarithms' product is the path's ratio,
    log(1 + length) * (1 + log(1 + punctuation)). Along the page a node's ratio is smoothed by KERNEL over neighbours of
    the same parent path, and averaged by path again. A path is fused with the best of the elements around it, below the
    page's body, by the geometric mean of its smoothed ratio and the mean ratio of all text in that element: a list of
    short items in an article is part of it, one by itself is not. What speaks against a path, the factors of the
    elements around and the share of text in links, is a factor of its value.
    """
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        t = sums.setdefault(b.path, [0, 0, 0, 0, 0.0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(PUNCTUATION.findall(b.text))
        t[3] += b.linked
        t[4] += b.factor
    plain = {p: math.log1p(t[1] / t[0]) * (1 + math.log1p(t[2] / t[0])) for p, t in sums.items()}
    total = dict.fromkeys(sums, 0.0)
    for i, b in enumerate(found):
        weights = values = 0.0
        for k, w in enumerate(KERNEL, i - 2):
            if 0 <= k < len(found) and found[k].path[:-1] == b.path[:-1]:
                weights += w
                values += w * plain[found[k].path]
        total[b.path] += values / weights
    around: dict[tuple[str, ...], list[float]] = {}
    for p, t in sums.items():
        for k in range(1, len(p)):
            if p[k - 1] not in WHOLE:
                x = around.setdefault(p[:k], [0.0, 0.0])
                x[0] += t[1] * plain[p]
                x[1] += t[1]
    out = {}
    for p, t in sums.items():
        own = total[p] / t[0]
        best = max((around[p[:k]][0] / around[p[:k]][1] for k in range(1, len(p)) if p[k - 1] not in WHOLE), default=own)
        out[p] = math.sqrt(own * max(own, best)) * t[4] / t[0] * (1 - t[3] / t[1])
    return out


def content_paths(found: list[Block]) -> set[tuple[str, ...]]:
    """Paths of the content: those whose value reaches a share of the highest. Where all there is speaks against itself,
    nothing is content."""
    value = ratios(found)
    highest = max(value.values(), default=0.0)
    return {p for p, v in value.items() if v >= HIGHEST * highest and v > 10 * AGAINST}


def main_text(page: str | None) -> str:
    """The blocks of the content paths, in page order, joined by blank lines."""
    found = blocks(page or "")
    paths = content_paths(found)
    return "\n\n".join(b.text for b in found if b.path in paths)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["row", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Every row of pages with all its columns but html, and text, n_chars (code points).

    Null or empty html gives an empty text; repeated rows stay; columns already named text or n_chars are replaced;
    an empty table gives no rows. Paths of equal values are judged alike; bytes that are no UTF-8 are what Spark's cast
    to string makes of them; depth is bounded by the page alone. One pass without a shuffle.
    """
    small_batches(pages.sparkSession, 200)
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(_extract, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select("row.*", "text", "n_chars")


def op8_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
