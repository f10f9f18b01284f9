import html as entities
import html.parser
import math
import random
import re
import time

import pytest
from meterloom.llm import extraction
from meterloom.llm.queries import QUERIES

PROSE = "The river rose, slowly; nobody on the bridge noticed. By noon it had reached the mill, and the miller left."
MORE = "Next day, when the water fell, they found the wheel broken. It took weeks to mend, he said."

FURNITURE = """<!DOCTYPE html><html><head><title>River</title><style>p {{x:1}}</style><script>var a="<p>no</p>, never.";</script></head><body class="has-sidebar">
<header><a href="/">Home</a> The daily news, every day.</header><nav><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></nav>
<div id="cookie-banner"><p>We use cookies, as everybody does. Please agree, or leave.</p></div><!-- <p>not this, ever.</p> -->
<div class="top ad"><p>Buy now, pay later. Really, do it!</p></div>{}<div class="sidebar"><p>Popular, today: the mill.</p></div><form><p>Your name, please.</p><input></form>
<section id="comments"><article class="comment"><p>First, as always. Nice text, thanks!</p></article></section>
<footer><p>Copyright, all rights reserved. Contact us, any time.</p></footer></body></html>"""

CASES = {
    "article": (FURNITURE.format(f"<article><header><h1>The  river</h1></header><p>{PROSE}</p><ul><li>one</li><li>two</li></ul><p>{MORE}</p><aside>More, here.</aside></article>"),
                ["The river", PROSE, "one", "two", MORE]),
    "main": (FURNITURE.format(f"<main><h2>A head</h2><p>{PROSE}</p><p>Short one.</p><ul><li><a href=x>See also</a></li><li><a href=y>And this</a></li></ul></main>"), ["A head", PROSE, "Short one."]),
    "divs": (FURNITURE.format(f"<div class=content><h1>T</h1><div><p>{PROSE}<p>{MORE}<br>And a   line.</div></div><div><a href=1>Old</a> <a href=2>New</a></div>"), ["T", PROSE, MORE + " And a line."]),
    "open tags": (f"<article><p><b>{PROSE}<p>{MORE}<li>item", [PROSE, MORE, "item"]),
    "references": ("<article><p>a&nbsp;&amp;&#160;&lt;b&gt; &copy &eacute;&#x20AC; &unknown; x</article>", ["a & <b> © é€ &unknown; x"]),
    "no markup": ("just  text,\n no tags", ["just text, no tags"]),
    "null": (None, []), "empty": ("", []), "blank": (" \n ", []), "only furniture": ("<nav>menu, here</nav><footer>foot.</footer>", []),
    "broken tag": (f"<p>{PROSE}</p><p class='x", [PROSE]), "open script": (f"<p>{PROSE}</p><script>if (a<b) x", [PROSE]), "less than": ("<article><p>1 < 2 and 3<4, or so.</p></article>", ["1 < 2 and 3<4, or so."]),
    "hidden": (f"<article><p hidden>secret, it is.</p><p style='display: none'>gone, too.</p><p>{PROSE}</p></article>", [PROSE]),
    "table": (f"<article><table><tr><th>k<td>v, w.<tr><td>x<td>y</table><p>{PROSE}</article>", ["k", "v, w.", "x", "y", PROSE]),
    "case": (f"<ARTICLE><P>{PROSE}</P><SCRIPT>no</script ><P>{MORE}</ARTICLE>", [PROSE, MORE]),
    "quoted": (f"<article><p title=\"a > b\" data-x='<p>'>{PROSE}</p></article>", [PROSE]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_layouts(name):
    page, want = CASES[name]
    assert extraction.main_text(page) == "\n".join(want)


def test_path_scores_by_hand():
    found = extraction.blocks("<body><p>ab, c.</p><p>def</p><div><a href=x>link</a></div></body>")
    assert [(b.path, b.text, b.links) for b in found] == [(("body", "p"), "ab, c.", 0), (("body", "p"), "def", 0), (("body", "div"), "link", 4)]
    scores = extraction.path_scores(found)
    import math
    ratio = [math.log1p(9 / 2)] * 2 + [math.log1p(4)]
    marks = [math.log1p(2 / 2)] * 2 + [0.0]
    smooth = lambda v: [sum(w * v[min(2, max(0, i + d))] for d, w in zip((-2, -1, 0, 1, 2), extraction.KERNEL)) for i in range(3)]
    fused = [r * (1 + m) for r, m in zip(smooth(ratio), smooth(marks))]
    assert scores["body", "p"] == pytest.approx(sum(fused[:2]) / 2)
    assert scores["body", "div"] == 0.0


@pytest.mark.parametrize("page", ["<" * 200_000, "<p" * 100_000, "<a href='" * 50_000, "<div>" * 3000 + "x", "&" * 200_000, "<!--" * 100_000, "<script>" * 50_000, 'x="' * 99_999])
def test_odd_pages_take_little_time(page):
    begin = time.time()
    extraction.main_text(page)
    assert time.time() - begin < 20


def test_all_pages(spark, folder):
    """Every page of the table, against the text of its article cut out with patterns."""
    table = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op4_tag_path_extraction"](spark, folder).collect()
    assert len(got) == len(table)
    for r in got:
        body = re.search("<article>(.*)</article>", table[r.page_id].html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("</?b>", "", p)).split()) for p in re.split(r"</?(?:h1|p|br)>", body)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == table[r.page_id].url


def test_rows_are_kept(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, CASES["main"][0], "b"), (1, "", "c"), (1, "", "c")], "page_id long, html string, text string")
    got = [(r.row.page_id, r.row.text, r.n_chars) for r in extraction.extract(df).collect()]
    assert got == [(1, "a", 0), (None, "b", len("\n".join(CASES["main"][1]))), (1, "c", 0), (1, "c", 0)]
    assert extraction.extract(df.limit(0)).collect() == []


LONG = "This is a long sentence of the text, with a comma, and it goes on for some time, as running text does."


@pytest.mark.parametrize("outer", ["div", "main"])
def test_cards_beside_the_text(outer):
    cards = "".join(f"<article><h3>Card {k}</h3><p>A few words, {k}.</p></article>" for k in range(4))
    page = f"<body><{outer}><h1>Title</h1>" + f"<p>{LONG}</p>" * 6 + f"</{outer}><div>{cards}</div></body>"
    got = extraction.main_text(page)
    assert got.count(LONG) == 6 and "Card" not in got
    inside = "<body><main><h1>Title</h1>" + f"<p>{LONG}</p>" * 6 + f"{cards}</main></body>"
    assert extraction.main_text(inside).count(LONG) == 6


@pytest.mark.parametrize("start, end", [
    ("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div class='with-sidebar'><article>", "</article></div>"),
    ("<article class='post tag-social'>", "</article>"), ("<form action=x><article>", "</article></form>"),
    ("<form><div class='has-sidebar'><main>", "</main></div></form>"), ("<div class='with-sidebar'>", "</div>")])
def test_wrappers_with_hints_keep_the_text(start, end):
    text = f"<p>{LONG}</p>" * 3
    side = "<div class='sidebar'><p>Some words, beside.</p></div>"
    comments = "<div class='comments'><p>Nice, thanks.</p></div>"
    assert extraction.main_text(f"<body>{start}{text}{comments}{end}{side}</body>") == "\n".join([LONG] * 3)


def test_math_and_xmp_are_text():
    page = f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><xmp><b>raw</b></xmp></article>"
    got = extraction.main_text(page)
    assert "x=1 holds." in got and "<b>raw</b>" in got


PROBED = {
    "script with a slash": (f"<p>{PROSE}</p><script src=/js/>var a=1;</script><p>{MORE}</p>", [PROSE, MORE]),
    "reference list": (f"<article><p>{PROSE}</p><ul><li><a href=1>Ref one, a paper</a></li><li><a href=2>Ref two, a book</a></li></ul></article>",
                       [PROSE, "Ref one, a paper", "Ref two, a book"]),
    "menu in the article": (f"<article><p>{PROSE}</p><ul><li><a href=1>News</a></li><li><a href=2>Sport</a></li></ul></article>", [PROSE]),
    "names in the article": (
        f"<article><p class=byline>By A. Smith</p><p>{PROSE} <span class='search-term'>mill</span> here.</p><div class='share-price'>Price, 5.</div>"
        "<blockquote class='comment'><p>A quote, said he.</p></blockquote><div class='related-posts'><p>Read this, too.</p></div></article>",
        ["By A. Smith", PROSE + " mill here.", "Price, 5.", "A quote, said he."]),
    "comments as articles": (f"<article><p>{PROSE}</p></article><article class='c'><p>Nice one, thanks.</p></article>", [PROSE]),
    "comments as inner articles": (f"<article><p>{PROSE}</p><article><p>Nice, thanks.</p></article></article>", [PROSE]),
    "articles of equal weight": ("".join(f"<article><p>{PROSE}</p></article>" for _ in range(3)), [PROSE] * 3),
    "empty svg": (f"<article><p>{PROSE}</p><svg/><p>{MORE}</p></article>", [PROSE, MORE]),
    "bare value with a slash": (f"<article><p>{PROSE} <a href=/x/>link</a> tail.</p></article>", [PROSE + " link tail."]),
}


@pytest.mark.parametrize("name", sorted(PROBED))
def test_probed_pages(name):
    page, want = PROBED[name]
    assert extraction.main_text(page) == "\n".join(want)


@pytest.mark.parametrize("part", ["<div>x", "<b>", "<p>a</b>", "<div class='sidebar'>x", "<ul><li>x", "<b><h1>a</h1>", "<ul><div><li>x</li>", "<table><tr><td>", "<article>x", "<a><p>y"])
def test_time_grows_with_length(part):
    def took(n):
        begin = time.process_time()
        extraction.main_text(part * (n // len(part)))
        return time.process_time() - begin

    took(10_000)
    small, large = min(took(60_000) for _ in range(2)), took(600_000)
    assert large < 25 * small + 0.5


class Naive(html.parser.HTMLParser):
    """Blocks of a well-formed page the slow way: every block knows all its open tags."""

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks, self.text, self.links, self.count = [], [], "", 0, 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append({"text": text, "links": min(self.links, len(text)), "open": list(self.open)})
        self.text, self.links = "", 0

    def hinted(self, tag, names):
        if tag in ("form",):
            return True
        if tag in ("span", "a", "b", "blockquote", "main", "body", "html"):
            return False
        def furniture(name):
            parts = re.findall("[A-Za-z][a-z]*|[0-9]+", name)
            return any(p.lower() in extraction.HINTS for p in parts) and all(p.lower() in extraction.HINTS | extraction.PLAIN or p.isdigit() for p in parts)
        return any(furniture(n) for n in names.split())

    def handle_starttag(self, tag, attrs):
        hinted = self.hinted(tag, dict(attrs).get("class") or "")
        if tag in extraction.BLOCKS or tag in extraction.FURNITURE or hinted:
            self.flush()
        self.count += 1
        self.open.append((tag, self.count, hinted))

    def handle_endtag(self, tag):
        assert self.open[-1][0] == tag
        if tag in extraction.BLOCKS or tag in extraction.FURNITURE or self.open[-1][2]:
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        self.text += data
        if any(t == "a" for t, _, _ in self.open):
            self.links += len(data.strip())


def naive_text(page):
    found = Naive(page).blocks
    for b in found:
        tags = [t for t, _, _ in b["open"]]
        b["path"] = tuple(t for t in tags if t in extraction.BLOCKS)
        b["region"] = 2 if "article" in tags else 1 if "main" in tags else 0
        b["article"] = next((n for t, n, _ in reversed(b["open"]) if t == "article"), 0)
        b["out"] = any(t in extraction.FURNITURE for t in tags) or ("header" in tags and not b["region"])
        b["hints"] = {n for _, n, h in b["open"] if h}
    seen = [b for b in found if not b["out"]]
    total = sum(len(b["text"]) - b["links"] for b in seen)
    regions = [b for b in seen if b["region"]]

    def wraps(e):
        held = sum(len(b["text"]) - b["links"] for b in seen if e in b["hints"])
        return all(e in b["hints"] for b in regions) and 2 * held > total if regions else 4 * held > 3 * total

    found = [b for b in seen if all(wraps(e) for e in b["hints"])]

    def measure(rows):
        def per(path, f):
            mine = [b for b in rows if b["path"] == path]
            return sum(map(f, mine)) / len(mine)

        ratio = [math.log1p(per(b["path"], lambda c: len(c["text"]))) for b in rows]
        marks = [math.log1p(per(b["path"], lambda c: sum(c["text"].count(p) for p in extraction.PUNCTUATION))) for b in rows]
        at = lambda v, i: sum(w * v[min(len(v) - 1, max(0, i + d))] for d, w in zip((-2, -1, 0, 1, 2), extraction.KERNEL, strict=True))
        fused = [at(ratio, i) * (1 + at(marks, i)) for i in range(len(rows))]
        for b in rows:
            b["fused"] = sum(f for f, c in zip(fused, rows, strict=True) if c["path"] == b["path"]) / sum(c["path"] == b["path"] for c in rows)
            b["share"] = per(b["path"], lambda c: c["links"]) / per(b["path"], lambda c: len(c["text"]))
            b["score"] = b["fused"] * (1 - b["share"]) if b["share"] < 0.6 else 0.0
            b["words"], b["marks"] = per(b["path"], lambda c: len(c["text"].split())), per(b["path"], lambda c: sum(c["text"].count(p) for p in extraction.PUNCTUATION))
        return [b["score"] * (len(b["text"]) - b["links"]) for b in rows]

    if not found:
        return ""
    chosen = None
    for region in (2, 1):
        if not any(b["region"] == region for b in found):
            continue
        weight = measure(found)
        if 2 * sum(w for w, b in zip(weight, found, strict=True) if b["region"] == region) >= sum(weight):
            found = chosen = [b for b in found if b["region"] == region]
            break
        if any(b["region"] < region for b in found):
            found = [b for b in found if b["region"] < region]
    text_region = found[0]["region"] if chosen else max(b["region"] for b in found)
    if text_region == 2 and chosen:
        weight = measure(found)
        held = {n: sum(w for w, b in zip(weight, found, strict=True) if b["article"] == n) for n in sorted({b["article"] for b in found})}
        best = max(held, key=held.get)
        if 2 * held[best] >= sum(held.values()) > 0:
            found = [b for b in found if b["article"] == best]
    measure(found)
    if text_region == 2:
        keep = [b["share"] < 0.6 or b["marks"] > 0 or b["words"] > 4 for b in found]
    else:
        top = max(b["score"] for b in found)
        keep = [b["score"] >= 0.25 * top and b["score"] > 0 for b in found]
    for i in range(len(found) - 2, -1, -1):
        if found[i]["path"] and re.fullmatch("h[1-6]", found[i]["path"][-1]) and found[i]["links"] < 0.6 * len(found[i]["text"]):
            keep[i] = keep[i] or keep[i + 1]
    return "\n".join(b["text"] for b, k in zip(found, keep, strict=True) if k)


def random_page(rng, depth=0):
    """Well-formed markup with menus, articles, names and prose."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if depth > 4 or kind < 0.35:
            words = " ".join(rng.choices(["river", "mill,", "bridge.", "night", "he", "said:", "no;", "&amp;"], k=rng.randrange(1, 30)))
            out.append(f"<p>{words}</p>" if rng.random() < 0.8 else f"<h2>{words}</h2>")
        elif kind < 0.45:
            out.append("<ul>" + "".join(f"<li><a href=x>{rng.choice(['News', 'Sport', 'A long one, with a mark', 'Six words that have no marks'])}</a></li>" for _ in range(rng.randrange(1, 4))) + "</ul>")
        elif kind < 0.5:
            out.append(f"<b class='ad'>loose {rng.randrange(9)} text</b>")
        else:
            tag = rng.choice(["div", "section", "article", "main", "aside", "nav", "form", "blockquote", "header", "footer", "div", "div"])
            name = rng.choice(["", "", " class='sidebar'", " class='related-posts'", " class='share-price'", " class='comments x'", " class='layout has-sidebar'", " class='ad'"])
            out.append(f"<{tag}{name}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_equals_the_slow_version():
    rng = random.Random(11)
    texts = 0
    for _ in range(600):
        page = "<html><body>" + random_page(rng) + "</body></html>"
        got = extraction.main_text(page)
        assert got == naive_text(page), page
        texts += bool(got)
    assert texts > 400
