"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes a chain of text blocks.  A linear classifier gives each block a cost for either
label: from its words, links, sentence end and heading, from the share of the page's
prose that stands in the same element, and, as one bounded term, from what the tags and
names of the elements around it say for an article or for boilerplate.  The costs become
the capacities to the two terminals.  Smoothness edges join blocks that are neighbours in
the page or in the DOM.  The minimum cut labels all blocks; the text is that of the content
blocks.  Without any telling tag or name the text, the links and the DOM decide alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendersift.llm.common import free_name, read_table

#: Weights of the classifier of blocks; a positive sum speaks for content.
WEIGHTS = {"bias": -1.5, "words": 0.8, "links": -4.0, "sentence": 0.5, "heading": 1.5, "rights": -3.0}
#: The most that words, sentence end and heading add up to, and the weight of the share of prose in the block's parent, against half of it.
PROSE, SHARE = 2.5, 3.0
#: The term of tags and names: within an article, within boilerplate, within an element one of whose names holds a boilerplate word among others, and outside of all articles of a page that has one.
GOOD, BAD, DOUBT, OUTSIDE = 4.5, -4.5, -1.0, -2.5
#: Capacity between neighbours one DOM step apart, and between blocks of one parent.
NEAR, SIBLING = 1.2, 0.6
BORDER = 4
#: An element with this share of the page's words outside links holds the page rather than a part of it.
MOST = 0.5

_RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<({_RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^<>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b|(display\s*:\s*none)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr input nobr math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle semantics".split())
_BAD_TAGS = frozenset("nav footer aside form button select option menu dialog noscript template svg object canvas audio video applet".split())
_BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer foot masthead topbar toolbar comment comments respond reply replies disqus discussion"
    " share sharing social related recommended recommendations newsletter subscribe signup login search searchform pager pagination widget widgets skip form complementary contentinfo".split()
)
#: Words that names of boilerplate are put together with; a name with any other word besides leaves a doubt only: search-methods, cookie-recipe.
_PLAIN_NAMES = frozenset(
    "site page main top bottom left right head bar box wrap wrapper wrapping container inner outer block area section region row col column columns panel item items list lists link links entry entries post posts article articles story stories"
    " content text body button buttons icon icons form field input header title label more all new latest news popular mobile desktop primary secondary global local js id ui el view feed thread author user".split()
)
_GOOD_NAMES = frozenset("article articlebody content post entry story main".split())
#: A name with one of these says how the page is laid out or set, not what the element is: with-sidebar, comment-open.
_SETTINGS = frozenset("with has have no without is not open opened closed enabled disabled allowed on off layout supported free count".split())
_HEADINGS = frozenset("h1 h2 h3 h4".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = frozenset("html body div section article main table ul ol dl td th aside nav header footer form blockquote".split())
_RIGHTS = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)


class Block:
    """node and parent: numbers of the element that holds the text and of the one around it; region: the innermost element around it whose tag or names tell something."""

    __slots__ = ("text", "node", "parent", "region", "words", "linked", "heading")

    def __init__(self, text: str, node: int, parent: int, region: int, words: int, linked: int, heading: bool):
        self.text, self.node, self.parent, self.region, self.words, self.linked, self.heading = text, node, parent, region, words, linked, heading


class Region:
    __slots__ = ("above", "tag", "good", "bad", "doubt", "first", "prose")

    def __init__(self, above: int, tag: str, good: bool, bad: bool, doubt: bool):
        self.above, self.tag, self.good, self.bad, self.doubt, self.first, self.prose = above, tag, good, bad, doubt, False, 0


class Page:
    """The text blocks in order, the regions (0 stands for what is outside all others), and of each element its parent and depth."""

    __slots__ = ("blocks", "regions", "above", "depth")

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.regions = [Region(-1, "", False, False, False)]
        self.above, self.depth = [0], [0]

    def apart(self, a: int, b: int) -> int:
        """Steps between two elements."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, steps = self.above[a], steps + 1
        return steps


def _evidence(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element's tag and names speak for an article, for boilerplate, or leave a doubt."""
    good, doubt = tag in ("article", "main"), False
    bad = tag in _BAD_TAGS or tag == "header" and not in_article
    for m in _ATTRIBUTE.finditer(attributes or ""):
        if m[5] or m[6]:
            bad = True
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            pieces = {x.lower() for x in _NAME.findall(name)}
            if pieces & _SETTINGS:
                continue
            if pieces & _BAD_NAMES or "header" in pieces and not in_article:
                alone = pieces <= _BAD_NAMES | _PLAIN_NAMES
                bad, doubt = bad or alone, doubt or not alone
            elif pieces & _GOOD_NAMES:
                good = True
    return (False, False, False) if tag in ("html", "body") else (good, bad, doubt)


def parsed(page: str) -> Page:
    """The blocks, regions and elements of a page; inline tags don't end a block, all other tags do.  Takes time in proportion to the page, however deep its elements stand."""
    out, first, opened = Page(), {}, Counter()
    # Open elements: tag, node of the innermost block element, region, whether in an article.
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    tags = [""]  # of the block elements
    parts: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            size, node, region = text.count(" ") + 1, stack[-1][1], stack[-1][2]
            out.blocks.append(Block(text, node, out.above[node], region, size, min(size, linked), tags[node] in _HEADINGS))
            out.regions[region].prose += size - min(size, linked)
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if opened["a"]:
            linked += len(text.split())

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[2] or m[5])
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag and not (inline and stack[k][0] in _STOPS):
                    k -= 1
                if stack[k][0] == tag:
                    close(k)
            continue
        if tag in _VOID:
            continue
        if not inline:
            ends = _CLOSES.get(tag, ("p",))
            if any(opened[x] for x in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in _STOPS:
                        break
        _, node, region, in_article = stack[-1]
        good, bad, doubt = _evidence(tag, m[4] or m[7], in_article)
        if good or bad or doubt:
            out.regions.append(Region(region, tag, good, bad, doubt))
            region = len(out.regions) - 1
        if not inline:
            out.above.append(node)
            out.depth.append(out.depth[node] + 1)
            tags.append(tag)
            node = len(tags) - 1
        if tag in ("article", "main", "h1"):
            first.setdefault("h1" if tag == "h1" else "article", region)
        stack.append((tag, node, region, in_article or good))
        opened[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    r = first.get("article", first.get("h1", -1))
    while r >= 0:  # the regions around the page's first article, else around its first h1
        out.regions[r].first = True
        r = out.regions[r].above
    if not first:
        for x in out.regions:
            x.first = x.tag == "form"
    for x in reversed(out.regions[1:]):
        out.regions[x.above].prose += x.prose
    return out


def evidence(page: Page) -> list[float]:
    """The term of tags and names of the blocks in each region.

    A region that holds most of the page and its first article (first h1, if it has none)
    is no boilerplate, as its names are those of a page's layout, and neither is a form that holds
    most of a page with neither.  Signs of an article inside of boilerplate are void.
    """
    regions, whole = page.regions, page.regions[0].prose
    good, bad, doubt = [False], [False], [False]
    for r in regions[1:]:
        layout, up = r.first and r.prose >= MOST * whole, r.above
        bad.append(bad[up] or r.bad and not layout)
        good.append(good[up] or r.good and not bad[-1])
        doubt.append(doubt[up] or r.doubt and not layout)
    out = [BAD if b else (GOOD if g else 0.0) + (DOUBT if d else 0.0) for g, b, d in zip(good, bad, doubt, strict=True)]
    if any(good[b.region] and not bad[b.region] for b in page.blocks):
        out = [v if g or b else v + OUTSIDE for v, g, b in zip(out, good, bad, strict=True)]
    return out


def text_cost(b: Block) -> float:
    """The classifier's sum for what a block itself holds."""
    w = WEIGHTS
    prose = w["words"] * math.log1p(b.words) + w["sentence"] * (b.text[-1] in ".!?") + w["heading"] * (b.heading and not b.linked)
    sum_ = w["bias"] + min(prose, PROSE - w["bias"]) + w["links"] * b.linked / b.words
    return sum_ + (w["rights"] if b.words < 40 and _RIGHTS.search(b.text) else 0.0)


def graph(page: Page) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The blocks' costs, and their smoothness edges: to the next one by DOM distance (a region's border counts as BORDER steps), and to the last one of the same parent and region."""
    found, term = page.blocks, evidence(page)
    held: Counter = Counter()
    for b in found:
        held[b.parent] += b.words - b.linked
    whole = max(1, sum(held.values()))
    costs = [text_cost(b) + term[b.region] + SHARE * (held[b.parent] / whole - 0.5) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            edges.append((i - 1, i, NEAR / (1 + page.apart(a.node, b.node) + BORDER * (a.region != b.region))))
        place = (b.parent, b.region)
        if place in last:
            edges.append((last[place], i, SIBLING))
        last[place] = i
    return costs, edges


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels with the least sum of costs of wrong labels and of cut edges; True stands for costs above 0.

    A node whose cost exceeds all its edges keeps its sign; its edges move to the
    terminals of its neighbours.  For the rest all shortest augmenting paths of one length
    are filled at once, so long pages need few rounds.
    """
    n, near = len(costs), [[] for _ in costs]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    left = [sum(c for _, c in x) for x in near]
    costs, label = list(costs), [None] * n
    sure = [i for i in range(n) if abs(costs[i]) > left[i]]
    while sure:
        i = sure.pop()
        if label[i] is not None:
            continue
        label[i] = costs[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                left[j] -= c
                costs[j] += c if label[i] else -c
                if abs(costs[j]) > left[j] + 1e-12:
                    sure.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if not open_:
        return label
    source, sink = n, n + 1
    flow: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in open_:
        if costs[i] > 0:
            flow[source][i], flow[i][source] = costs[i], 0.0
        else:
            flow[i][sink], flow[sink][i] = -costs[i], 0.0
        for j, c in near[i]:
            if label[j] is None:
                flow[i][j] = flow[i].get(j, 0.0) + c
    while True:
        depth, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in flow[i].items():
                if c > 1e-12 and j not in depth:
                    depth[j] = depth[i] + 1
                    queue.append(j)
        if sink not in depth:
            break
        arcs, at = {i: [j for j in flow[i] if depth.get(j) == depth[i] + 1] for i in depth}, dict.fromkeys(depth, 0)
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:], strict=False))
                most = min(flow[a][b] for a, b in steps)
                for a, b in steps:
                    flow[a][b] -= most
                    flow[b][a] = flow[b].get(a, 0.0) + most
                del path[next(k for k, (a, b) in enumerate(steps) if flow[a][b] <= 1e-12) + 1 :]
                continue
            mine = arcs[i]
            while at[i] < len(mine) and flow[i][mine[at[i]]] <= 1e-12:
                at[i] += 1
            if at[i] < len(mine):
                path.append(mine[at[i]])
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1
    for i in open_:
        label[i] = i in depth
    return label


def labelled(page: str) -> list[tuple[Block, bool, float, float]]:
    """Each block of a page, whether it is content, its own cost, and the term of tags and names in it."""
    made = parsed(page)
    costs, edges = graph(made)
    term = evidence(made)
    return [(b, keep, c, term[b.region]) for b, keep, c in zip(made.blocks, min_cut(costs, edges), costs, strict=True)]


def main_text(page: str) -> str:
    """The content blocks of a page, joined by line ends."""
    return "\n".join(b.text for b, keep, _, _ in labelled(page) if keep)


def extracted(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of each whole page in the column text.

    Null and empty pages, and pages without content, give the empty text.  A column of
    pages that has the result's name (in any case) is replaced, all others stay as they
    are; repeated rows give equal texts, and no page none.
    """
    page = free_name(pages, "page_html")
    rows = pages.withColumn(page, F.coalesce(F.col(source).cast("string"), F.lit(""))).drop(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # smaller batches leave sooner
                part = batch.slice(lo, 500)
                made = pa.array([main_text(x.as_py()) for x in part.column(page)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, text])

    return rows.mapInArrow(run, f"{fields}, `{text}` string").drop(page)


def query(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
