"""Main text of web pages by tag-path ratios.

A page is read into text blocks; each has a root-to-leaf path of block tags. Text length, punctuation and link text
are added up per path: an article's paragraphs share one path and have much text and punctuation per node, menus
and teasers have little text, no punctuation and mostly links. The ratios are smoothed over neighbouring blocks and
fused into one score per path; thresholds on the scores choose the content.

Markup that authors state outright comes first. Blocks under tags, roles or class names of page furniture do not count;
names and forms only where the element is not a wrapper of the page's text, and a name only if each of its parts speaks of furniture
(``sidebar``, ``related-posts``, not ``share-price`` or ``has-sidebar``) and stands at a container, not at a
quotation or inline. Where the paths of an ``article`` or ``main`` hold most of the page's score, blocks outside of it are
furniture too; where they do not, theirs are. Of several articles one that holds most of their score is the text, as
comments and cards come in articles of their own. In a text that is marked out so, only paths of bare links are left out:
mostly links, few words a node and no punctuation.

A page is read once from its start to its end. Paths are numbered nodes that know their parent, open tags are looked
up by name, and what is open is counted, so time and memory grow with the page's length however deep it is nested. Each page
is handled by itself, in the task that reads it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the highest path score that a path needs.
THRESHOLD = 0.25
#: Weights by distance in blocks when ratios are smoothed.
KERNEL = (0.05, 0.2, 0.5, 0.2, 0.05)
#: Marks that running text has and menus lack.
PUNCTUATION = ".,;:!?\u2026\u3001\u3002\uff01\uff0c\uff1f"
#: Share of link text from which a path is a menu; within a marked-out text only up to so many words a node.
MOST_LINKS = 0.6
MENU_WORDS = 4

#: Tags that begin and end a text block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split())
#: Tags whose text is never content.
FURNITURE = frozenset(
    "aside button canvas datalist dialog footer head iframe input label menu nav noframes noscript object select svg "
    "template textarea title".split())
#: Tags whose inside is not markup.
RAW = frozenset("iframe noembed noframes noscript script style svg template textarea title xmp".split())
_RAW_END = {tag: re.compile(f"</{tag}(?![^\\s/>])", re.IGNORECASE | re.ASCII) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that name page furniture.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary consent contentinfo "
    "cookie cookies comment comments contentinfo copyright discussion disqus footer gdpr hidden login masthead menu modal nav navbar "
    "navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related replies "
    "reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar "
    "topbar widget widgets".split())
#: Words that names of furniture are completed with.
PLAIN = frozenset(
    "area bar block body bottom box btn button buttons col column container content footer form group header inner item items left "
    "link links list main module outer panel post posts right row section slot small text thread title tools top unit wrap wrapper "
    "zone".split())
#: Tags at which names say nothing: the page as a whole, quotations and what stands within a line.
UNNAMED = frozenset(
    "html body main blockquote q pre code a abbr b bdi bdo big cite data del dfn em font i img ins kbd mark math rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split())
#: An end tag or start tag that ends open ones of these kinds, up to the given container.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}

_MARKUP = re.compile(r"""<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>\x00]*+))""")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Path:
    """A node of the tree of root-to-leaf tag paths."""

    number: int
    parent: Path | None
    tag: str

    def tags(self) -> tuple[str, ...]:
        out, node = [], self
        while node.parent is not None:
            out.append(node.tag)
            node = node.parent
        return tuple(reversed(out))


@dataclass
class Element:
    tag: str
    furniture: bool
    #: Number of an element that a hint or its tag makes furniture unless it holds the page's text; none otherwise.
    hinted: int | None
    #: Its path: that of the nearest block tag, itself included.
    node: Path
    #: The innermost hinted element, region and article around its text, itself included.
    within: int
    region: int
    article: int
    #: Whether its text stands in a header outside of any region.
    header: bool


@dataclass
class TextBlock:
    """A run of text between block tags."""

    node: Path
    text: str
    links: int
    furniture: bool
    #: The region it stands in: 2 an article, 1 the main part, 0 neither.
    region: int
    #: The innermost article around it, by number; -1 for none.
    article: int = -1
    #: The innermost hinted element around it, by number; -1 for none.
    within: int = -1

    @property
    def path(self) -> tuple[str, ...]:
        """Its root-to-leaf tag path."""
        return self.node.tags()


def _furniture(tag: str, attributes: str) -> bool:
    """Whether markup hides an element or its tag is never content."""
    if tag in FURNITURE:
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    return False


def _names_furniture(name: str) -> bool:
    """Whether the parts of a class, id or role all speak of furniture, at least one of them plainly."""
    parts = [w.lower() for w in _NAME.findall(name)]
    return any(w in HINTS for w in parts) and all(w in HINTS or w in PLAIN or w.isdigit() for w in parts)


def _hinted(tag: str, attributes: str) -> bool:
    """Whether an element is a form or its names hint at furniture."""
    if tag == "form":
        return True
    if tag in UNNAMED:
        return False
    return any(m[1].lower() in ("class", "id", "role") and any(map(_names_furniture, (m[2] or m[3] or m[4] or "").split()))
               for m in _ATTRIBUTE.finditer(attributes))


def _judge_hints(out: list[TextBlock], parents: list[int]) -> None:
    """Blocks in hinted elements are furniture, but for elements that hold most of the page's text outside of links
    and furniture, and all of the articles and main parts if there are some (three quarters of the text if not).

    ``parents`` are the next hinted elements around each; an inner one has the larger number.
    """
    held, marked = [0] * len(parents), [0] * len(parents)
    total = regions = 0
    for b in out:
        if not b.furniture:
            plain = len(b.text) - b.links
            total += plain
            regions += b.region > 0
            if b.within >= 0:
                held[b.within] += plain
                marked[b.within] += b.region > 0
    for e in range(len(parents) - 1, -1, -1):
        if parents[e] >= 0:
            held[parents[e]] += held[e]
            marked[parents[e]] += marked[e]
    fine = []
    for e, parent in enumerate(parents):
        wraps = marked[e] == regions and 2 * held[e] > total if regions else 4 * held[e] > 3 * total
        fine.append(wraps and (parent < 0 or fine[parent]))
    for b in out:
        b.furniture = b.furniture or b.within >= 0 and not fine[b.within]


def _empty(attributes: str) -> bool:
    """Whether a tag ends in a slash that is not the end of a bare attribute value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"'>]*/$", attributes[attributes.rfind("=") :])


def blocks(page: str) -> list[TextBlock]:
    """All text blocks of a page in order, furniture included. Open tags may lack their end, as browsers allow."""
    root = Path(0, None, "")
    known: dict[tuple[int, str], Path] = {}
    stack = [Element("", False, None, root, -1, 0, -1, False)]
    #: Places of the open tags in the stack, by name, and of all open block tags.
    opened: dict[str, list[int]] = {}
    block_places: list[int] = []
    parents: list[int] = []
    out: list[TextBlock] = []
    text: list[str] = []
    links = hidden = articles = 0

    def flush() -> None:
        nonlocal links
        whole = " ".join("".join(text).split())
        if whole:
            top = stack[-1]
            out.append(TextBlock(top.node, whole, min(links, len(whole)), hidden > 0 or top.header and not top.region, top.region, top.article, top.within))
        text.clear()
        links = 0

    def close(index: int) -> None:
        nonlocal hidden
        if any(e.tag in BLOCKS or e.furniture or e.hinted is not None for e in stack[index:]):
            flush()
        while len(stack) > index:
            e = stack.pop()
            opened[e.tag].pop()
            hidden -= e.furniture
            if e.tag in BLOCKS:
                block_places.pop()

    def push(tag: str, furniture: bool, hinted: bool) -> None:
        nonlocal hidden, articles
        top, node = stack[-1], stack[-1].node
        if tag in BLOCKS:
            key = (node.number, tag)
            node = known.get(key) or known.setdefault(key, Path(len(known) + 1, node, tag))
            block_places.append(len(stack))
        number = None
        if hinted:
            number = len(parents)
            parents.append(top.within)
        opened.setdefault(tag, []).append(len(stack))
        hidden += furniture
        articles += tag == "article"
        stack.append(Element(
            tag, furniture, number, node, top.within if number is None else number,
            2 if tag == "article" else max(top.region, tag == "main"), articles if tag == "article" else top.article, top.header or tag == "header"))

    def add(raw: str) -> None:
        nonlocal links
        decoded = html.unescape(raw) if "&" in raw else raw
        text.append(decoded)
        if opened.get("a"):
            links += len(decoded.strip())

    def nearest(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        if m[2] is None:
            opening = m[0]
            closing = "-->" if opening == "<!--" else ">"
            end = page.find(closing, m.end() - (2 if page.startswith("<!-->", m.start()) else 0))
            at = len(page) if end < 0 else end + len(closing)
            continue
        rest = _REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            break  # an unfinished tag ends the page
        tag, attributes = m[2].lower(), page[m.end() : end - 1]
        at = end
        if m[1]:
            if opened.get(tag):
                close(opened[tag][-1])
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW and not (tag == "svg" and _empty(attributes)):  # only svg can be empty, a script's slash means nothing
            stop, at_text = _RAW_END[tag].search(page, at), at
            if not stop:
                break  # what is never closed holds the rest of the page
            at = page.find(">", stop.end()) + 1 or len(page)
            text.append(f" {page[at_text : stop.start()]} " if tag == "xmp" else " ")
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            flush()
            # A block ends an open paragraph, which is then the innermost open block.
            if block_places and stack[block_places[-1]].tag == "p":
                close(block_places[-1])
        if tag in _ENDS:
            kinds, stops = _ENDS[tag]
            stop = nearest(stops)
            while (index := nearest(kinds)) > stop:
                close(index)
        if tag in VOID or tag not in BLOCKS and _empty(attributes):
            continue
        furniture, hinted = _furniture(tag, attributes), _hinted(tag, attributes)
        if furniture or hinted:
            flush()
        push(tag, furniture, hinted)
    flush()
    _judge_hints(out, parents)
    return out


def _measures(found: list[TextBlock]) -> dict[str, np.ndarray]:
    """Per block: the fused score of its path, and the path's share of link text, words and marks a node."""
    index: dict[int, int] = {}
    of = np.array([index.setdefault(b.node.number, len(index)) for b in found])
    nodes = np.bincount(of)
    length = np.array([len(b.text) for b in found], float)
    marks = np.bincount(of, [sum(map(b.text.count, PUNCTUATION)) for b in found]) / nodes
    total = np.bincount(of, length)
    smooth = lambda v: np.convolve(np.pad(v[of], len(KERNEL) // 2, mode="edge"), KERNEL, "valid")
    fused = np.bincount(of, smooth(np.log1p(total / nodes)) * (1 + smooth(np.log1p(marks)))) / nodes
    share = np.bincount(of, [b.links for b in found]) / total
    words = np.bincount(of, [b.text.count(" ") + 1 for b in found]) / nodes
    score = np.where(share < MOST_LINKS, fused * (1 - share), 0.0)
    return {"score": score[of], "share": share[of], "words": words[of], "marks": marks[of]}


def path_scores(found: list[TextBlock]) -> dict[tuple[str, ...], float]:
    """Fused score of each path: text and punctuation per node, smoothed over neighbours in page order, less the
    share of link text."""
    return {b.path: float(v) for b, v in zip(found, _measures(found)["score"], strict=True)}


def _weights(found: list[TextBlock]) -> np.ndarray:
    """The score of a block's path for each character outside of links."""
    return _measures(found)["score"] * [len(b.text) - b.links for b in found]


def _winning(found: list[TextBlock]) -> tuple[list[TextBlock], int]:
    """The blocks of the highest region that holds most of the page's score. A region that loses is left out, as cards
    beside the text are. Of several articles one with most of their score wins, else all of them."""
    for region in range(max(b.region for b in found), 0, -1):
        weight = _weights(found)
        inside = np.array([b.region == region for b in found])
        if 2 * weight[inside].sum() >= weight.sum():
            found = [b for b, i in zip(found, inside, strict=True) if i]
            if region == 2:
                numbers = np.array([b.article for b in found])
                held = np.bincount(numbers, _weights(found))
                best = int(held.argmax())
                if 2 * held[best] >= held.sum() > 0:
                    found = [b for b, n in zip(found, numbers, strict=True) if n == best]
            return found, region
        if not inside.all():
            found = [b for b, i in zip(found, inside, strict=True) if not i]
    return found, max(b.region for b in found)


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """Content blocks of a page in page order, one per line. Null and empty pages, and pages of furniture alone,
    give an empty text; what is no markup at all is one block."""
    found = [b for b in blocks(page or "") if not b.furniture]
    if not found:
        return ""
    found, region = _winning(found)
    m = _measures(found)
    if region == 2:
        chosen = (m["share"] < MOST_LINKS) | (m["marks"] > 0) | (m["words"] > MENU_WORDS)
    else:
        chosen = (m["score"] >= threshold * m["score"].max()) & (m["score"] > 0)
    # A heading belongs to the content that follows it.
    for i in range(len(found) - 2, -1, -1):
        if re.fullmatch("h[1-6]", found[i].node.tag) and found[i].links < len(found[i].text) * MOST_LINKS:
            chosen[i] = chosen[i] or chosen[i + 1]
    return "\n".join(b.text for b, c in zip(found, chosen, strict=True) if c)


def extract(pages: DataFrame, text: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns of ``pages``), ``text`` (the main text) and ``n_chars``, its code points.

    White space within a block is one blank. Nothing is cut off. Repeated rows are handled alike; empty tables give
    no rows.
    """
    packed, place = pages.select(F.struct("*").alias("row")), pages.columns.index(text)
    schema = T.StructType([packed.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), threshold) for p in batch.column("row").field(place)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return packed.mapInArrow(run, schema)
