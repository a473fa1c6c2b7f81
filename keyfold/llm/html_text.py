"""The main text of web pages, by tag path ratios.

A page's text is cut into blocks at block-level tags, and each block is filed under its path of
block-level tags from the root. Per path, the letters and the punctuation of its blocks are summed and
divided by the number of blocks; letters inside links do not count. Both ratios are smoothed by those of
paths that share all but the last few tags, scaled by their largest value, and fused by their product's root. Paths
whose fused ratio reaches ``THRESHOLD`` of the page's largest are content; an article or main element
that holds such a path, or else the element that most of the content lies in, is the content root.

Blocks of content paths under the content root are kept, and so are its headings, paragraphs, list
items, quotations, table cells and code, which may be short. Blocks in navigation, headers, footers,
asides, forms, scripts and the like, or in elements whose class, id or role names them as such, never
count nor stay; of a header inside an article its headings stay.

Character references are decoded, white space inside a block becomes one space, and blocks are joined
by line breaks in page order. Inline tags do not part a block; ``br`` is white space.

Cases: null, empty and tagless pages (a page without tags is one block of text), unclosed tags and
comments, and pages of any length are read whole, page by page; a page without content has an empty
text; repeated rows count each for itself; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.hashing import slices_of

# Share of the largest fused ratio from which a path is content.
THRESHOLD = 0.25
# Share of a block's letters inside links from which it is a menu rather than text.
LINK_SHARE = 0.6
# How many tags less a path may share with another for its ratio to be smoothed by it.
NEAR = 3

_TAG = re.compile(r"""<!--(?:.*?--!?>|.*)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\s(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)

# Kinds of HTML elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output "
                   "picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template title iframe noembed noframes nav footer aside form button select "
                  "textarea option menu dialog svg math canvas object embed audio video fieldset datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li blockquote pre td th dt dd figcaption caption summary address".split())
ROOTS = frozenset(("article", "main"))
# An opening tag of the key closes an open element of the values, up to the scope that holds it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table html body article section div".split())
_RAW_ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
_MARKS = re.compile("[.,;:!?…。，、！？；：]")
# Words in a class, an id or a role that name a part of a page other than its text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright discussion disqus dropdown footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion related "
    "reply replies respond responses search share sharing shoutbox sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget complementary contentinfo alert".split())
# Words beside which the above do not count, as they name the text itself.
CONTENT = frozenset("content article main body entry post story text".split())


class Paths:
    """The tag paths of a page as a tree: a path is a number, ``parent`` the path without its last tag.

    ``root`` is the topmost article or main element of a path, itself included, or -1.
    """

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.root, self.depth = [-1], [""], [-1], [0]

    def child(self, path: int, tag: str, label: str) -> int:
        number = self.numbers.setdefault((path, tag + label), len(self.parent))
        if number == len(self.parent):
            self.parent.append(path)
            self.tag.append(tag)
            self.root.append(number if self.root[path] < 0 and tag in ROOTS else self.root[path])
            self.depth.append(self.depth[path] + 1)
        return number

    def below(self, top: int) -> list[bool]:
        """Which paths begin with the path ``top``; a parent's number is below its children's."""
        inside = [False] * len(self.parent)
        for path in range(len(inside)):
            inside[path] = path == top or path > 0 and inside[self.parent[path]]
        return inside


@dataclass
class Block:
    path: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    letters: int = 0


def _named(attributes: str) -> tuple[str, bool]:
    """Label of an element from its class, and whether class, id, role or style exclude it."""
    label, excluded = "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name in ("class", "id", "role"):
            parts = [re.split(r"[^a-z]+", one) for one in value.split()]
            excluded |= any(BOILERPLATE & set(p) and not CONTENT & set(p[-1:]) for p in parts)
            label += "." + value if name == "class" and value else ""
        elif name == "style":
            excluded |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            excluded |= value != "false"
    return label, excluded


class _Reader:
    """Reads a page once and keeps the blocks that may be content, with their paths."""

    def __init__(self):
        self.paths, self.blocks = Paths(), []
        self.stack: list[tuple[str, int, bool]] = []  # tag, path, excluded
        self.open: Counter[str] = Counter()
        self.current: Block | None = None
        self.links = 0

    def text(self, piece: str) -> None:
        if not piece or (self.stack and self.stack[-1][2]):
            return
        if self.current is None:
            if piece.isspace():
                return
            self.current = Block(self.stack[-1][1] if self.stack else 0)
            self.blocks.append(self.current)
        self.current.pieces.append(html.unescape(piece) if "&" in piece else piece)
        if self.links:
            self.current.linked += sum(map(len, piece.split()))

    def close(self, tags: Container[str], until: Container[str] = ()) -> None:
        """Close the innermost open element of ``tags``, unless one of ``until`` is inside of which we are."""
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                self.open.subtract(o[0] for o in self.stack[i:])
                del self.stack[i:]
                return
            if tag in until:
                return

    def begin(self, tag: str, attributes: str) -> None:
        closing = CLOSES.get(tag, ()) or ("p",)
        for tags in (("p",), closing):
            if any(self.open[t] > 0 for t in tags):
                self.close(tags, SCOPES)
        _, path, excluded = self.stack[-1] if self.stack else ("", 0, False)
        label, named = _named(attributes) if attributes.strip(" /") else ("", False)
        excluded = tag not in ("html", "body") and (excluded or named or tag in NEVER)
        self.stack.append((tag, path if excluded else self.paths.child(path, tag, label), excluded))
        self.open[tag] += 1

    def read(self, page: str) -> None:
        at = 0
        while True:
            m = _TAG.search(page, at)
            self.text(page[at:m.start()] if m else page[at:])
            if not m:
                return
            at = m.end()
            if m[2] is None:  # a comment or declaration
                continue
            tag = m[2].lower()
            if tag in INLINE:
                if tag == "a":
                    self.links = 0 if m[1] else 1
                elif tag == "br":
                    self.text(" ")
                continue
            self.current, self.links = None, 0
            if m[1]:
                if self.open[tag] > 0:
                    self.close((tag,))
            elif tag in RAW:
                end = _RAW_ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not (m[3].endswith("/") and tag in NEVER):
                self.begin(tag, m[3])


def _ratios(paths: Paths, held: dict[int, list[Block]]) -> dict[int, float]:
    """Fused ratio of every path that holds blocks."""
    ratios = {}
    for path, blocks in held.items():
        marks = sum(len(_MARKS.findall(b.text)) for b in blocks)
        ratios[path] = max(sum(b.letters - b.linked for b in blocks), 0) / len(blocks), marks / len(blocks)
    # Sums over all paths below a path, for the means that smooth a ratio: half of it is its own, a
    # quarter the mean of the paths that share all but one tag, and so on.
    sums: dict[int, list[float]] = {}
    for path, (letters, marks) in ratios.items():
        for _ in range(NEAR + 1):
            total = sums.setdefault(path, [0.0, 0.0, 0.0])
            total[0] += letters
            total[1] += marks
            total[2] += 1
            path = paths.parent[path]
            if path < 0:
                break
    smooth = {}
    for path, own in ratios.items():
        value, weight, near = list(own), 0.5, path
        value = [0.5 * v for v in value]
        used = 0.5
        for _ in range(NEAR):
            near = paths.parent[near]
            if near < 0:
                break
            weight /= 2
            total = sums[near]
            value = [v + weight * t / total[2] for v, t in zip(value, total)]
            used += weight
        smooth[path] = [v / used for v in value]
    tops = [max(s[i] for s in smooth.values()) or 1 for i in (0, 1)]
    # A text without any punctuation is judged by its letters alone.
    marked = any(s[1] for s in smooth.values())
    return {p: math.sqrt(s[0] / tops[0] * (s[1] / tops[1] if marked else s[0] / tops[0])) for p, s in smooth.items()}


def _root_of(paths: Paths, held: dict[int, list[Block]], content: Iterable[int]) -> int:
    """The path of the content root."""
    size: Counter[int] = Counter()
    for path in content:
        outer = max(paths.parent[path], 0)
        size[paths.root[path] if paths.root[path] >= 0 else outer] += sum(b.letters for b in held[path])
    return max(size, key=lambda p: (paths.tag[p] in ROOTS, size[p], -paths.depth[p]))


def main_text(page: str | None) -> str:
    """The blocks of content, joined by line breaks."""
    reader = _Reader()
    reader.read(page or "")
    paths, held = reader.paths, {}
    for b in reader.blocks:
        b.text = " ".join("".join(b.pieces).split())
        b.letters = len(b.text) - b.text.count(" ")
        if b.letters and (b.linked < LINK_SHARE * b.letters or paths.tag[b.path] in HEADINGS):
            held.setdefault(b.path, []).append(b)
    # Where the page says what its article is, nothing else is asked.
    held = {p: bs for p, bs in held.items() if paths.root[p] >= 0} or held
    if not held:
        return ""
    fused = _ratios(paths, held)
    least = THRESHOLD * max(fused.values())
    content = {p for p, v in fused.items() if v >= least}
    root = _root_of(paths, held, content)
    inside, headers = paths.below(root), [False] * len(paths.parent)
    for path in range(1, len(headers)):
        headers[path] = path != root and inside[path] and (headers[paths.parent[path]] or paths.tag[path] == "header")

    def stays(path: int) -> bool:
        if headers[path]:
            return paths.tag[root] in ROOTS and paths.tag[path] in HEADINGS
        return inside[path] and (path in content or path == root or paths.tag[path] in TEXTUAL)

    kept = {p for p in held if stays(p)}
    shown = {id(b) for p in kept for b in held[p]}
    return "\n".join(b.text for b in reader.blocks if id(b) in shown)


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for each row of ``pages (page_id, url, html)``."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in (p for f in frames for p in slices_of(f)):
            texts = [main_text(page) for page in frame.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column("page_id"), frame.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
