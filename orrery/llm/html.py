"""Main text of HTML pages: flat text blocks, their and their neighbours' word counts and link densities, and a decision tree.

A page is read once, from tag to tag, into flat blocks of text: what stands between two block tags.
A block's features are its words, the share of them inside links, both of the block before and after,
whether it is a heading, and what the containers around it say: the zone of the innermost telling tag
(article and main, or nav, aside, footer, form and the like), a hint from the names of classes and
ids, whether a name tells of comments, and the share of the page's words that the container of a
doubtful zone or hint holds. So a layout called "sidebar-right" or a form around a whole page is told
from a side bar by what is in it. A decision tree (Gini splits) is trained on the blocks of the
labelled pages below and decides alone, but for containers that aren't shown at all.

Defined results: a null or empty page has the empty text. Markup that is cut off or never closed is
read as far as it goes; a quote that isn't closed before its tag ends is a plain character. Repeated
rows give repeated results.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)

# Tags, and the words of names that hint at what a container holds.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "option", "button", "head", "object", "canvas", "math"}
BLOCK = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = BLOCK - set("p hr h1 h2 h3 h4 h5 h6 html".split())
CONTENT_TAGS, BOILER_TAGS = {"article", "main"}, {"nav", "aside", "footer", "form", "menu", "dialog"}
COMMENT_WORDS = set("comment comments disqus replies reply respond".split())
HINT_WORDS = COMMENT_WORDS | set(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs consent contentinfo cookie cookies copyright footer foot gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion related recommended search share sharing sidebar side skip social sponsor sponsored subscribe subscription toolbar topbar widget complementary login signup alert".split()
)


@dataclass
class Block:
    text: str
    words: int = 0
    links: float = 0.0
    zone: int = 0
    heading: int = 0
    hint: int = 0
    comment: int = 0
    share: float = 0.0


@dataclass
class Box:
    """What an open container says. box: the container that a doubtful zone or hint comes from, by its number."""

    tag: str = ""
    zone: int = 0
    hint: int = 0
    comment: int = 0
    hidden: bool = False
    box: int = -1


def _hint(names: str) -> tuple[int, int]:
    """2 if the last word of a name hints at boiler, 1 if another one at the front does; and whether it tells of comments."""
    hint = comment = 0
    for name in names.lower().split():
        words = re.split(r"[^a-z]+", name)
        if words[-1] in HINT_WORDS:
            hint = 2
        elif words[0] in HINT_WORDS:
            hint = max(hint, 1)
        comment |= words[-1] in COMMENT_WORDS or words[0] in COMMENT_WORDS
    return hint, int(comment)


def _opened(tag: str, attributes: str, around: Box, number: int) -> Box:
    """The container of a start tag inside another."""
    names, hidden = [], around.hidden
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if key in ("class", "id", "role"):
            names.append(value)
        hidden |= key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(_NONE.search(value))
    hint, comment = _hint(" ".join(names)) if tag not in ("body", "html", "main") else (0, 0)
    comment |= around.comment
    if tag in CONTENT_TAGS or "main" in names:
        return Box(tag, 1, 0, comment, hidden, around.box if comment else -1)
    zone = -1 if tag in BOILER_TAGS or tag == "header" and around.zone != 1 else around.zone
    doubtful = hint > around.hint or zone < around.zone
    return Box(tag, zone, max(hint, around.hint), comment, hidden, number if doubtful else around.box)


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page in order; scripts, styles, other raw parts and hidden containers have none."""
    found: list[Block] = []
    boxes: list[int] = []
    first: list[int] = []
    last: dict[int, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[Box, int]] = []
    now, anchor, heading, hidden, at, page = Box(), False, 0, False, 0, page or ""

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text and not now.hidden and not hidden:
            n = len(text.split())
            found.append(Block(text, n, min(1.0, len(html.unescape(" ".join(linked)).split()) / n), now.zone, heading, now.hint, now.comment))
            boxes.append(now.box)
        parts.clear()
        linked.clear()

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if anchor:
                linked.append(text)

    while m := _TAG.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        ending, tag = m[1], m[2].lower()
        if tag in RAW and not ending:
            if not m[3].endswith("/") and tag != "head":
                over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = over.end() if over else (len(page) if tag in ("script", "style") else at)
            elif tag == "head":
                over = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (over.end() if over[0].startswith("</") else over.start()) if over else at
            take(" ")
        elif tag == "a":
            anchor = not ending
        elif tag == "br":
            take(" ")
        elif tag in BLOCK:
            close()
            hidden = not ending and tag not in CONTAINER and _opened(tag, m[3], now, -1).hidden
            heading = int(not ending and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
            if tag in CONTAINER:
                anchor = False
                if ending:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0].tag == tag:
                            last.update((number, len(found)) for _, number in stack[k:])
                            del stack[k:]
                            break
                elif not m[3].endswith("/"):
                    stack.append((_opened(tag, m[3], now, len(first)), len(first)))
                    first.append(len(found))
                now = stack[-1][0] if stack else Box()
    take(page[at:])
    close()
    upto = np.cumsum([0, *(b.words for b in found)])
    for block, box in zip(found, boxes, strict=True):
        if box >= 0:
            block.share = float((upto[last.get(box, len(found))] - upto[first[box]]) / upto[-1])
    return found


def features(found: list[Block]) -> np.ndarray:
    """A row per block: words, link density, zone, heading, hint, comment, share; words and link density of the block before and after."""
    own = np.array([(b.words, b.links, b.zone, b.heading, b.hint, b.comment, b.share) for b in found], float).reshape(-1, 7)
    edge = np.zeros((1, 2))
    return np.hstack([own, np.vstack([edge, own[:-1, :2]]), np.vstack([own[1:, :2], edge])]) if len(found) else np.zeros((0, 11))


# The labelled pages: a number stands for so many words, ~ before it for so many linked ones; blocks that are content begin with +.
LABELLED = [
    "<nav><ul><li>~1<li>~1<li>~2</ul></nav><div class=ad>9</div><article><h1>+8</h1><p>+40<p>+3<p>+120<p>+1</article><footer>9</footer>",
    "<nav><a>~1</a></nav><article><h2>+5</h2><p>+12<p>+2<ul><li>+4<li>+7<li>+~2</ul><blockquote>+30</blockquote><div class=promo>11</div><p>+60 ~4</article><footer>30</footer><div id=cookie>20</div>",
    "<header>~3</header><div>~2</div><div>~2</div><main><h1>+4</h1><p>+25<pre>+50</pre><table><tr><td>+2<td>+3<tr><td>+1<td>+9</table><p>+14</main><aside><h3>2</h3><p>40<ul><li>~6<li>~7</ul></aside><footer><p>60<p>~4</footer>",
    "<article><h1>+6</h1><p>+1<p>+80<div class='ad-slot'>12</div><p>+70<aside>5</aside><p>+4</article><section id=comments><h3>2</h3><article><p>14</article><article><p>90</article><article><p>30</article></section>",
    "<div class='page layout sidebar-right'><div class='menu'><ul><li>~1<li>~1<li>~1</ul></div><div class='post'><h1>+7</h1><p>+90<p>+40<p>+3</div><div class='sidebar'><h4>2</h4><p>35<p>~5</div></div><div class='footer'>12</div>",
    "<div id=wrapper class='no-sidebar'><div><div class='elementor-widget-container'><h1>+5</h1><p>+66<p>+20<p>+2<p>+110</div></div></div><div class='site-footer'>25 ~6</div>",
    "<article><div class='elementor-widget-container'><p>+45<p>+7</div><div class='widget'><p>16</div></article>",
    "<form id=aspnet><div>~1</div><div>~1</div><div><h1>+6</h1><p>+75<p>+9<p>+130</div><div>~4</div></form>",
    "<article><p>+18<p>+6<form><label>3</label><p>8</form></article><form><p>12<p>3</form>",
    "<p>~3 1<p>~2 1<p>~4<h1>+9</h1><p>+55<p>+80 ~6<p>+31<p>+8<p>+64<p>~5<p>~6 1<p>7",
    "<div>~1</div><div>~1</div><div>~1</div><div><p>+33<p>+48<p>+5<p>+27 ~2</div><div>~7 2</div><div>~8</div><div>4</div>",
    "<header class=masthead><h1>~3</h1><p>6</header><div class=content><header><h1>+8</h1><p>+11</header><p>+140<p>+22<p>+1</div><div class='related'><h3>2</h3><ul><li>~6<li>~9</ul></div><footer>15</footer>",
    "<main><div class='breadcrumbs'><a>~2</a> <a>~3</a></div><h1>+5</h1><p>+44 ~3<p>+52<div class='share-buttons'>~4</div><div class='related-posts'><h3>2</h3><p>~8<p>~9</div></main>",
    "<article class='sidebar-none has-banner'><h1>+3</h1><p>+70<p>+15<figure><figcaption>+9</figcaption></figure><p>+33</article>",
    "<div class='banner-layout'><article><p>+20<p>+100</article></div><div class=newsletter><h3>4</h3><p>18</div>",
    "<body class='single sidebar'><div class='notice'>14</div><div class='text'><p>+60<p>+60<p>+10</div><div class='comments'><p>50<p>20<p>75</div></body>",
    "<article><h1>+7</h1><p>+15</article><div id=comments><p>60<p>130<p>45</div><footer><p>22</footer>",
    "<article><p>+6<p>+9<p>+5</article><aside><p>70<p>55</aside><nav>~40</nav>",
    "<article><p>+200</article>", "<main><p>+12</main>", "<p>+90", "<div><p>+25<p>+35</div>", "<nav>~9</nav><footer>8</footer>", "<ul><li>~2<li>~3<li>~2</ul>",
    "<div class=side><p>30<p>25</div><div class=body><p>+90<p>+70</div><div class=foot>10</div>",
    "<article><h1>+6</h1><ul><li>+~6<li>+~5 3<li>+~9</ul><p>+18</article>",
    "<div class='cookie-notice'>22 ~2</div><div class=main><h1>+4</h1><p>+38<p>+62<p>+3<p>+7</div><div class='widget-area'><p>28<p>~3</div>",
    "<nav>~1</nav><div class=ad>9</div><article><p>+400<p>+300<div class=ad>8</div><p>+500</article><footer>7</footer>",
    "<nav>~1</nav><div class=ad>9</div><article><h1>+9</h1><p>+1</article><footer>12</footer>",
    "<div class=ad>9</div><main><h1>+4</h1><p>+2<p>+6</main><footer>30</footer>",
    "<header>5</header><article><p>+250</article><div class=share>~3</div><footer>6</footer>",
    "<div class=top>~1</div><div class=ad>12</div><div class=entry><h1>+6</h1><p>+150<p>+90</div><div class=footer>6</div>",
    "<dialog>18</dialog><article><p>+50<div class=ad>5</div><p>+35<div class=ad>30</div><p>+3<div class=advertisement>1</div></article><footer>&copy; 2</footer>",
]

Node = tuple  # (feature, threshold, node below or at it, node above it), or the share of content in a leaf


SIZES = [(a, b) for a in (0.4, 1, 4, 12) for b in (0.5, 1, 2)]  # the words of paragraphs and of the rest, as multiples


def labelled_rows(pages: list[str], sizes: list[tuple[float, float]] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages, each page in several sizes."""
    x, y = [], []
    for of_content, of_rest in sizes:

        def words(m: re.Match) -> str:
            n = int(m[3])
            n = max(1, round(n * (of_content if m[1] and n > 10 and not m[2] else of_rest if n > 3 and not m[1] else 1)))
            text = " ".join(["+w" if m[1] else "w"] * n)
            return f"<a>{text}</a>" if m[2] else text

        for page in pages:
            found = blocks(re.sub(r"(?<=[>\s])(\+?)(~?)(\d+)(?=[<\s]|$)", words, page))
            y += ["+" in b.text for b in found]
            x.append(features(found))
    return np.vstack(x), np.array(y, float)


def grown(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 12) -> Node | float:
    """A tree of Gini splits with `least` rows in each leaf; ties go to the first feature and the least threshold."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) - 1e-12, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            if min(low.sum(), (~low).sum()) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            impurity = low.mean() * 2 * a * (1 - a) + (1 - low.mean()) * 2 * b * (1 - b)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    _, f, t = best
    if f is None:
        return share
    low = x[:, f] <= t
    return f, t, grown(x[low], y[low], depth - 1, least), grown(x[~low], y[~low], depth - 1, least)


@functools.lru_cache(1)
def tree() -> Node:
    return grown(*labelled_rows(LABELLED))


def is_content(row: np.ndarray, node: Node | float) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node > 0.5


def main_text(page: str | None) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_content(row, tree()))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            texts = [main_text(page) for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
