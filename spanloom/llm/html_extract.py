"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier on each block's place (elements around it, their class and id words), links and
length gives the cost of calling it content and of calling it boilerplate, its terminal capacities; neighbours on the page, and neighbours among the
children of one element, pay for different labels, less the further apart they are in the tree. The labelling of least total cost is a minimum cut.

Marks are costs, not verdicts: a mark weakens with each level between it and the block, counts for less the more of the page's text it
holds (a wrapper is no sidebar), and loses most of its weight at an article or main element inside it, unless it names reader comments. Paragraphs of an article
are weak on their own and strong together, so the cut decides on them. Blocks whose own costs outweigh all their ties are settled first (they
are so in every minimum cut); the others go through the maximum flow.

The weights are fixed and listed here; nothing is trained, since no page carries labels.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SLICE_CHARS, slices

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: The rest of a tag, with quoted values that may hold its end mark.
REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
HINTS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)\b\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template title textarea iframe svg math object audio video canvas select".split())
RAW_END = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that go on within a line; all others part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Open elements that an opening tag ends.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARTS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that part a page into regions, as all that bear a mark do; a step over their edge counts as several.
REGIONS = frozenset("article main nav aside footer header section form".split())
OUT_ELEMENTS = frozenset("nav footer aside form button menu dialog fieldset header".split())
#: Words of class, id and role that mark what isn't the article (those of reader comments apart), and what is.
OUT_WORDS = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|footer|foot|header|masthead|cookies?|consent|gdpr|notice\w*|alert|popup|modal|overlay"
    r"|related\w*|recommend\w*|share|sharing|social\w*|subscribe|newsletter|signup|login|widget\w*|toolbar|pagination|pager|tags|toc|copyright|legal|complementary|contentinfo|search|dialog)"
)
COMMENT_WORDS = re.compile(r"(?:comments?|commentlist|disqus\w*|repl(?:y|ies)|discussion|responses?)")
IN_WORDS = re.compile(r"(?:article\w*|content|main|post|entry|story|body|text|prose)")
#: A name with one of these tells a state of what it names, not what it is (has-sidebar, banner-on).
STATES = frozenset("has no not with without on off is show hide".split())
#: A header of the article itself, which holds its title.
OWN_HEADER = re.compile(r"^(?:article|post|entry|story)[_-]header$")
#: Terms of the classifier, as log odds of being content.
PRIOR, IN_ARTICLE, IN_MAIN, MARKED_IN, HEADING, LINKS, LONG, SENTENCE = -0.6, 0.9, 0.9, 0.9, 0.4, -4.0, 1.2, 0.5
OUT_ELEMENT, OUT_NAME, OUT_PART = 9.0, 8.0, 5.0
#: What a mark keeps at each level down, and at an article or main element.
DEEPER, RESET = 0.9, 0.2
#: Ties of neighbours on the page and under one parent, at no distance, and what a step over a region's edge adds to the distance.
ADJACENT, SIBLING, REGION_STEP = 6.0, 4.0, 4
#: Legal notices; the longer the block, the less they weigh, and inside an article, which may quote one, the ties decide.
NOTICE = re.compile(r"(?i)^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b|\b(?:cookie|privacy) policy\b")
NOTICE_COST, NOTICE_INSIDE, NOTICE_CHARS = -5.0, -1.5, 100


class Element:
    __slots__ = ("chars", "comment", "depth", "held", "inside", "mark", "marks_comment", "name", "out", "own_in", "parent", "skip")

    def __init__(self, name: str, attrs: str, parent: Element | None) -> None:
        self.name, self.parent = name, parent
        self.skip = parent.skip if parent else False
        #: Whether this is an article or main element or lies inside one.
        self.held = name in ("article", "main") or (parent.held if parent else False)
        self.chars, self.mark, self.own_in, self.marks_comment = 0, 0.0, 0.0, False
        words: list[str] = []
        if attrs:
            marks = {k.lower(): (v or "").strip("\"'") for k, v in HINTS.findall(attrs)}
            if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or HIDDEN.search(marks.get("style", "").lower()):
                self.skip = True
            words = " ".join(marks.get(k, "") for k in ("class", "id", "role", "itemprop")).split()
        if name == "article":
            self.own_in = IN_ARTICLE
        elif name == "main":
            self.own_in = IN_MAIN
        if name in OUT_ELEMENTS and not (name == "header" and parent and parent.held):
            self.mark = OUT_ELEMENT
        if name not in ("body", "html"):
            for word in words:
                self._read(word)
        self.depth = parent.depth + 1 + REGION_STEP * (name in REGIONS or self.mark > 0) if parent else 0

    def _read(self, word: str) -> None:
        parts = [p.lower() for p in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", word) if p]
        if OWN_HEADER.match(word.lower()) or STATES.intersection(parts):
            return
        hits = [bool(OUT_WORDS.fullmatch(p)) for p in parts]
        if any(COMMENT_WORDS.fullmatch(p) for p in parts):
            self.mark, self.marks_comment = max(self.mark, OUT_NAME), True
        elif any(hits):
            # An article may be named after its subject; its name alone doesn't put it out.
            if self.name not in ("article", "main"):
                self.mark = max(self.mark, OUT_NAME if hits[-1] or all(hits) else OUT_PART)
        elif any(IN_WORDS.fullmatch(p) for p in parts):
            self.own_in = max(self.own_in, MARKED_IN)

    def weigh(self, total: int) -> None:
        """Evidence from this element and those around it; parents come first."""
        share = self.chars / total if total else 0.0
        own = self.mark * (1 - share * share)
        up = self.parent
        out, comment, inside = (up.out * DEEPER, up.comment * DEEPER, up.inside) if up else (0.0, 0.0, 0.0)
        if self.name in ("article", "main"):
            out *= RESET
        self.inside = max(inside, self.own_in)
        self.out, self.comment = (out, max(comment, own)) if self.marks_comment else (max(out, own), comment)


class Block:
    __slots__ = ("heading", "links", "odds", "parent", "text")

    def __init__(self, text: str, links: int, parent: Element, heading: bool) -> None:
        self.text, self.links, self.parent, self.heading, self.odds = text, links, parent, heading, 0.0

    def weigh(self) -> None:
        n, p = len(self.text), self.parent
        odds = PRIOR + p.inside - max(p.out, p.comment) + HEADING * self.heading
        odds += LINKS * (self.links / n) ** 2 + LONG * min(n, 400) / 400 + SENTENCE * (self.text[-1] in ".!?…\"'”»")
        if NOTICE.search(self.text):
            odds += (NOTICE_INSIDE if p.inside else NOTICE_COST) * NOTICE_CHARS / (NOTICE_CHARS + n)
        self.odds = odds


def tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text before each tag with the tag's name, whether it closes, and its attributes; the rest comes with an empty name.

    Each character is read a bounded number of times: a quote that never ends, or an end mark that never comes, is looked for once.
    """
    at, size, text_from, quotes = 0, len(html), 0, True
    last = html.rfind(">")
    while True:
        at = html.find("<", at)
        if at < 0 or at > last:
            yield html[text_from:], "", False, ""
            return
        head = html[at + 1 : at + 2]
        if head in ("!", "?"):
            if html.startswith("<!--", at) or html.startswith("<![CDATA[", at):
                mark = "-->" if html[at + 2] == "-" else "]]>"
                end = html.find(mark, at + 4)
                end = size if end < 0 else end + len(mark)
            else:
                end = html.find(">", at) + 1
            yield html[text_from:at], "!", False, ""
            at = text_from = end
            continue
        m = NAME.match(html, at + 1)
        if not m:
            at += 1
            continue
        rest = REST.match(html, m.end()) if quotes else None
        if rest is None:
            quotes = False
        end = rest.end() if rest else html.find(">", m.end()) + 1
        name = m[1].lower()
        yield html[text_from:at], name, head == "/", html[m.end() : end - 1]
        if name in RAW and head != "/" and not (html[end - 2] == "/" and name in ("svg", "math", "iframe")):
            over = RAW_END[name].search(html, end)
            end = over.end() if over else size
        at = text_from = end


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in page order, white space made one space and references decoded, empty ones left out."""
    blocks: list[Block] = []
    root = Element("", "", None)
    elements = [root]
    top = root
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = in_link = 0
    heading = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not top.skip:
                parent = top
                while parent.name in INLINE and parent.parent and not parent.mark:
                    parent = parent.parent
                blocks.append(Block(text, min(linked, len(text)), parent, heading))
                parent.chars += len(text)
            parts.clear()
        linked = 0

    def close(node: Element) -> Element:
        """``node`` and all that is open inside it."""
        nonlocal top
        while top is not node:
            opened[top.name] -= 1
            top = top.parent
        opened[node.name] -= 1
        top = node.parent
        return top

    for text, name, closing, attrs in tags(html):
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        if not name or name == "!" or name in RAW:
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if closing:
            if opened.get(name):
                node = top
                if name in INLINE:
                    # A block that stands open between isn't closed by an inline end tag.
                    while node.name in INLINE and node.name != name:
                        node = node.parent
                else:
                    while node.name != name:
                        node = node.parent
                if node.name == name:
                    if name in INLINE and node.mark:
                        flush()
                    close(node)
            in_link = max(0, in_link - 1) if name == "a" else in_link if name in INLINE else 0
            if name[0] == "h" and name[1:].isdigit():
                heading = False
            continue
        if name in PARTS_P and opened.get("p"):
            node = top
            while node.name in INLINE:
                node = node.parent
            if node.name == "p":
                close(node)
        if name in ENDED_BY:
            node = top
            while node.name in INLINE or node.name == "p":
                node = node.parent
            while node.name in ENDED_BY[name]:
                node = close(node)
        child = Element(name, attrs, top)
        if name in INLINE and child.mark or child.skip and not top.skip:
            flush()
        if not attrs.rstrip().endswith("/") or name not in INLINE:
            elements.append(child)
            opened[name] = opened.get(name, 0) + 1
            top = child
        in_link += name == "a"
        if name[0] == "h" and name[1:].isdigit():
            heading = True
    flush()
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
    for e in elements:
        e.weigh(root.chars)
    for b in blocks:
        b.weigh()
    return blocks


def tree_distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree, those over the edge of a region weighed as several."""
    start = a.depth + b.depth
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return start - 2 * a.depth


def ties(blocks: list[Block]) -> list[dict[int, float]]:
    """For each block the weights of its ties: neighbours on the page, and neighbours under one element, those with marks and those without apart."""
    out: list[dict[int, float]] = [{} for _ in blocks]
    last: dict[tuple[int, bool], int] = {}
    for i, b in enumerate(blocks):
        own: dict[int, float] = {}
        if i:
            own[i - 1] = ADJACENT / (1 + tree_distance(blocks[i - 1].parent, b.parent) ** 2)
        above = (id(b.parent.parent or b.parent), b.parent.mark > 0)
        if (j := last.get(above)) is not None:
            own[j] = own.get(j, 0.0) + SIBLING / (1 + tree_distance(blocks[j].parent, b.parent) ** 2)
        last[above] = i
        for j, w in own.items():
            out[i][j] = w
            out[j][i] = w
    return out


def minimum_cut(odds: list[float], tied: list[dict[int, float]]) -> list[bool]:
    """Labels (True: content) of least cost; ties of equal cost go to boilerplate.

    Calling block i boilerplate costs max(odds, 0), calling it content max(-odds, 0), and parting i and j tied[i][j].
    """
    n = len(odds)
    odds = list(odds)
    label: list[bool | None] = [None] * n
    weight = [sum(t.values()) for t in tied]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) > weight[i]:
            label[i] = odds[i] > 0
            for j, w in tied[i].items():
                if label[j] is None:
                    weight[j] -= w
                    odds[j] += w if label[i] else -w
                    todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        content = _flow({i: odds[i] for i in left}, {i: {j: w for j, w in tied[i].items() if label[j] is None} for i in left})
        for i in left:
            label[i] = i in content
    return [bool(x) for x in label]


def _flow(odds: dict[int, float], tied: dict[int, dict[int, float]]) -> set[int]:
    """Source side of a minimum cut, by shortest augmenting paths in layers."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(w) for i, w in tied.items()} | {s: {}, t: {}}
    for i, o in odds.items():
        a, b = (s, i) if o > 0 else (i, t)
        cap[a][b] = abs(o)
        cap[b].setdefault(a, 0.0)
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if t not in level:
            return {i for i in level if i >= 0}
        edges = {a: iter(list(w)) for a, w in cap.items()}
        path = [s]
        while path:
            a = path[-1]
            if a == t:
                most = min(cap[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    cap[x][y] -= most
                    cap[y][x] = cap[y].get(x, 0.0) + most
                full = next(i for i, (x, y) in enumerate(zip(path, path[1:], strict=False)) if cap[x][y] <= 1e-12)
                del path[full + 1 :]
                continue
            for b in edges[a]:
                if cap[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
                if path:
                    level[a] = -9


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    blocks = blocks_of(html or "")
    labels = minimum_cut([b.odds for b in blocks], ties(blocks))
    return " ".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text`` in place of ``html``; a column of that name is replaced.

    A null or empty page, and one without content, has the empty text. Markup that is broken is read as far as it makes sense, never
    refused. Each page is judged alone, so repeated rows agree.
    """
    own = [f for f in pages.schema.fields if f.name not in (html, text)]
    schema = T.StructType([*own, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(html).to_pylist()
            kept = batch.select([f.name for f in own])
            for a, b in slices([len(x or "") for x in source], SLICE_CHARS):
                texts = pa.array([main_text(x) for x in source[a:b]], pa.string())
                yield pa.RecordBatch.from_arrays([*kept.slice(a, b - a).columns, texts], [*kept.schema.names, text])

    return pages.select(*[f.name for f in own], html).mapInArrow(run, schema)


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
