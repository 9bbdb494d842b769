"""Main text of web pages by minimum-cut labelling of their blocks (operator 2).

A page is cut into blocks of text. A linear classifier of words, links, sentence marks and place gives each block a cost for
being taken as boilerplate and one for being taken as content: the capacities of its edges to the two terminals. Names and
classes of elements are only part of that evidence. Blocks that follow each other, and the more so the nearer they stand in
the DOM, are joined by smoothness edges, weak ones where their elements say different things. The minimum cut, found by
max-flow, separates content from boilerplate: short lines go with what stands around them.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without end tag; elements whose content is raw text up to their end tag; elements that a page shows as controls or
#: pictures, whose text is none of the page's; inline elements, which don't end a block, like the two before (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
UNSHOWN = frozenset("template svg object math canvas select button".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements that can't stand in a control and so end one that was left open.
OUT_OF_CONTROL = frozenset("p div article section main h1 h2 h3 h4 h5 h6 ul ol table blockquote pre header footer nav aside form".split())
#: An element that one of these begins ends an open element of the same kind (or group).
CLOSES = {"button": {"button"}, "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements and words of class, id or role that mark boilerplate, and those that mark content.
BOILER_TAGS = frozenset("nav footer aside form dialog menu header".split())
BOILER_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"foot|footer|head|header|masthead|comments?|replies|reply|respond|disqus|related|recommend\w*|share|sharing|social|subscribe|newsletter|widget|login|signup|search|pagination|"
    r"pager|toolbar|copyright|legal|disclaimer|skip|hidden|complementary|contentinfo)(?:$|[^a-z])"
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = re.compile(r"(?:^|[^a-z])(?:article|content|story|entry|post-body|post|main|body-text)(?:$|[^a-z])")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+)|(<)", re.S)
ATTRIBUTES = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/>]|\Z))", re.I)
#: Weights of the classifier (log-odds of content): a block without words that matter, each word up to a limit, a sentence's
#: end and each mark inside up to a limit, all text linked, place within or outside an article, heading, hinted as boilerplate.
BASE, PER_WORD, WORDS_MOST, SENTENCE, MARK, MARKS_MOST, LINKS = -0.8, 0.08, 40, 0.6, 0.1, 4, -3.0
IN_CONTENT, OUTSIDE, HEADING, BOILER = 1.5, -1.5, 0.3, -6.0
#: Capacities of smoothness edges: blocks that follow each other, blocks under one parent (halved with each step between them
#: and for another element name), and the factor where one of them is hinted or in an article and the other isn't.
NEXT, NEAR, CONTRAST = 0.5, 1.2, 0.15
#: Steps in the DOM beyond which nearness counts nothing.
STEPS = 8


class Element:
    """An open element: its nearest block-level element (for a block-level one: itself), and what it says of its text."""

    __slots__ = ("name", "parent", "depth", "block", "boiler", "content", "link", "heading")

    def __init__(self, name: str, parent: Element | None, boiler: bool = False, content: bool = False, link: bool = False):
        self.name, self.boiler, self.content, self.link = name, boiler, content, link
        inline = name in INLINE and parent is not None
        self.parent = parent.block if parent else None
        self.depth = self.parent.depth + (not inline) if parent else 0
        self.block = self.parent if inline else self
        self.heading = name in HEADINGS or bool(parent and parent.heading)


class Block:
    __slots__ = ("parts", "linked", "at", "heading")

    def __init__(self, under: Element):
        self.parts: list[str] = []
        self.linked, self.at, self.heading = 0, under.block, under.heading


def blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of every stretch of text between block elements, in page order; time is linear in the page."""
    stack, opened = [Element("", None)], Counter()
    found: list[Block] = []
    now: Block | None = None
    at, end = 0, len(page)
    unshown = 0  # place in the stack of the outermost open element whose text isn't shown
    low = page.lower() if len(page.lower()) == end else page
    ends = {name: low.rfind(f"</{name}") for name in RAW | UNSHOWN}
    while at < end:
        token = TOKEN.match(page, at)
        if token is None:
            break
        at = token.end()
        closing, name, rest, text, lone = token.groups()
        if text or lone:
            if unshown:
                continue
            if now is None:
                now = Block(stack[-1])
                found.append(now)
            text = text or lone
            now.parts.append(text)
            if stack[-1].link:
                now.linked += len(text.strip())
        elif name is None:
            continue
        else:
            name = name.lower()
            if name not in INLINE and name not in RAW and name not in UNSHOWN and not unshown:
                now = None
            if closing:
                while opened[name]:
                    last = stack.pop().name
                    opened[last] -= 1
                    if last == name:
                        break
                unshown = unshown if unshown < len(stack) else 0
                continue
            if name == "br":
                if now is not None and not unshown:
                    now.parts.append(" ")
                continue
            if name in VOID or name == "head":  # what stands in a head isn't text, or tells so itself
                continue
            if name in RAW:
                if ends[name] >= at:
                    close = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = close.end() if close else end
                elif name in ("script", "style"):
                    at = end
                continue
            if unshown and name in OUT_OF_CONTROL and stack[unshown].name in ("button", "select"):
                while len(stack) > unshown:
                    opened[stack.pop().name] -= 1
                unshown, now = 0, None
            while len(stack) > 1 and stack[-1].name in INLINE and name not in INLINE and name not in UNSHOWN:
                opened[stack.pop().name] -= 1  # a block element ends inline ones that were left open
            if name in CLOSES and stack[-1].name in CLOSES[name]:
                opened[stack.pop().name] -= 1
                unshown = unshown if unshown < len(stack) else 0
            if name in UNSHOWN and (ends[name] < at or rest.endswith("/")):
                continue  # without an end it would take the rest of the page
            if rest.endswith("/") and name not in INLINE:
                continue
            if name in UNSHOWN and not unshown:
                unshown = len(stack)
            under = stack[-1]
            hints = " ".join((m[1] or m[0]).strip("\"'") if m[0].lower() != "style" else ("hidden" if re.search(r"display\s*:\s*none", m[1]) else "") for m in ATTRIBUTES.findall(rest)).lower() if rest else ""
            inside = name in CONTENT_TAGS or bool(hints and CONTENT_WORDS.search(hints))
            # the header of an article isn't the page's, and the body isn't boilerplate for its class
            own = name in BOILER_TAGS and not (name == "header" and under.content) or bool(hints and name not in ("body", "html", "article", "main") and not inside and BOILER_WORDS.search(hints))
            stack.append(Element(name, under, under.boiler or own, under.content or inside, under.link or name == "a"))
            opened[name] += 1
    out = []
    for block in found:
        words = html.unescape("".join(block.parts)).split()
        if words:
            out.append((" ".join(words), block))
    return out


def evidence(text: str, block: Block, has_content: bool) -> float:
    """The classifier's log-odds of content."""
    score = BASE + PER_WORD * min(text.count(" ") + 1, WORDS_MOST) + LINKS * min(1.0, block.linked / len(text))
    score += SENTENCE * (text[-1] in ".!?\"'”»") + MARK * min(MARKS_MOST, text.count(", ") + text.count(". "))
    score += HEADING * block.heading + BOILER * block.at.boiler
    return score + (IN_CONTENT if block.at.content else OUTSIDE if has_content else 0.0)


def steps_between(a: Element, b: Element) -> int:
    """Elements to climb from both to their common one, up to ``STEPS``; siblings and an element itself are at 2 or fewer."""
    steps = 0
    while a is not b and steps < STEPS:
        if a.depth >= b.depth:
            a, steps = a.parent, steps + 1
        else:
            b, steps = b.parent, steps + 1
    return steps


def smoothness(a: Block, b: Block) -> float:
    """Capacity between blocks that follow each other."""
    x, y = a.at, b.at
    near = NEXT + NEAR * 0.5 ** (max(0, steps_between(x, y) - 2) + (x.name != y.name))
    return near * (CONTRAST if x.boiler != y.boiler or x.content != y.content else 1.0)


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the content side of the minimum cut.

    A node whose terminal capacity is beyond all its edges is on that side in any minimum cut: it is fixed first, and its
    edges become capacities of its neighbours. The rest is solved by shortest augmenting paths.
    """
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    score, fixed, todo = list(score), [None] * n, deque(range(n))
    while todo:
        k = todo.popleft()
        if fixed[k] is None and abs(score[k]) >= sum(near[k].values()):
            fixed[k] = score[k] > 0
            for other, w in near[k].items():
                score[other] += w if fixed[k] else -w
                del near[other][k]
                todo.append(other)
            near[k] = {}
    left = [k for k in range(n) if fixed[k] is None]
    if left:
        inside = _source_side(left, score, near)
        for k in left:
            fixed[k] = k in inside
    return fixed


def _source_side(left: list[int], score: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes of ``left`` on the source's side of the minimum cut, by blocking flows (Dinic)."""
    source, sink = len(score), len(score) + 1
    room: dict[int, dict[int, float]] = {k: dict(near[k]) for k in left} | {source: {}, sink: {}}
    for k in left:
        a, b = (source, k) if score[k] > 0 else (k, sink)
        room[a][b] = abs(score[k])
        room[b].setdefault(a, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, most in room[a].items():
                if most > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return set(level) - {source}
        arcs = {k: iter(list(room[k])) for k in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                for n, (x, y) in enumerate(zip(path, path[1:])):
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0.0) + flow
                first = next(n for n, (x, y) in enumerate(zip(path, path[1:])) if room[x][y] <= 1e-9)
                for x in path[first + 1 :]:  # what lies beyond the full edge may be tried again from elsewhere
                    arcs[x] = iter(list(room[x]))
                del path[first + 1 :]
                continue
            onward = next((b for b in arcs[a] if level.get(b) == level[a] + 1 and room[a][b] > 1e-9), None)
            if onward is None:
                level[a] = -1
                path.pop()
            else:
                path.append(onward)


def labelled(page: str, smooth: bool = True) -> list[tuple[str, bool, bool]]:
    """(text, whether it is content, whether its own score says so) of the page's blocks; without ``smooth``, edges are left out."""
    found = blocks(page)
    has_content = any(b.at.content and not b.at.boiler for _, b in found)
    score = [evidence(text, block, has_content) for text, block in found]
    edges = [(k, k + 1, smoothness(found[k][1], found[k + 1][1])) for k in range(len(found) - 1)]
    last: dict[int, int] = {}
    for k, (_, block) in enumerate(found):  # blocks of one parent, also across what stands between
        if (j := last.get(id(block.at.parent))) is not None and j < k - 1:
            edges.append((j, k, smoothness(found[j][1], block) - NEXT * (CONTRAST if block.at.boiler != found[j][1].at.boiler else 1.0)))
        last[id(block.at.parent)] = k
    kept = min_cut(score, [(a, b, max(0.0, w)) for a, b, w in edges] if smooth else [])
    return [(text, k, own > 0) for (text, _), k, own in zip(found, kept, score)]


def main_text(page: str) -> str:
    """The page's content blocks, joined by newlines; a page without any tag is its own text, white space made single."""
    if "<" not in page:
        return " ".join(html.unescape(page).split())
    return "\n".join(text for text, kept, _ in labelled(page) if kept)


def main_texts(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text (empty if none), n_chars (code points).

    Null and empty pages have an empty text. Broken pages are read to their end, in time that grows with their length: a head
    needs no end, elements whose text isn't shown (controls, pictures, objects) only count as such if they end somewhere, and only
    scripts and styles without an end take the rest of a page. Pages without tags are plain text. Repeated rows give repeated rows, other columns are ignored, an empty table
    gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(page) if page else "" for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
