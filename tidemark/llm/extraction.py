"""Main text of web pages by scoring the element tree.

Each block of text gives points for being there, for its commas and for its length, in full to the element that holds it,
by half to the next one above, and less further up.  An element's points are discounted by the share of its text
that lies in links, and changed a little by its name.  The best container is kept with all of the article around it;
where no element says that it is one, with those siblings that score well too, or are headings and prose.  What is left
of them after menus, comments and the like are taken out is the text, block by block in page order.

Tags and names of classes only raise a doubt: an element that holds (nearly) all of a page's text is kept against them,
and where they would leave no text they count for less.  A word that only qualifies another one, as in share-story, is
outweighed by prose.  Comments are known by names and by their shape, and go however long they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._arrow import prepare

# fixed values: elements by what HTML says of them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol dl table td th div section article main body aside blockquote form button".split())
# elements that hold no text of an article, and those that an article's text is hardly ever in
NEVER = frozenset("script style title textarea iframe noembed noframes xmp head noscript template button select input label svg canvas object audio video map".split())
ASIDE = frozenset("nav footer aside form fieldset menu dialog".split())
# names of classes, ids and roles: of what stands beside articles, of articles, and words by which a name tells a state
BAD = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies dialog disclaimer discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies responses search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
GOOD = frozenset("article body content entry main page post story text blog".split())
TALK = frozenset("comment comments discussion disqus replies responses".split())
# words that say little before another one, as in share-story
WEAK = frozenset("banner form header login masthead menu nav navigation notification page popup recommended related search share sharing social tags toolbar widget".split())
STATES = frozenset("has have with without no is open opened closed on off enabled disabled status count".split())
#: Share of a page's text that an element must hold to be kept against its tag or whole name, against a part of its name, and
#: against a weak part, if links are less than LINKS of it.  Less than OTHER beside comments is no page of its own.
HOLDS, HOLDS_DOUBTFUL, HOLDS_WEAK, LINKS, OTHER = 0.95, 0.8, 0.25, 0.25, 0.01
#: What a name does to an element's worth, and the share of the best worth from which a sibling is kept.
BETTER, DOUBTFUL, SIBLING = 1.2, 0.6, 0.2
#: Elements around a block that get points of it.
LEVELS = 6
PROSE = frozenset("p blockquote pre ul ol dl table figure h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
INSIDE = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Character references beyond any code point, and leading zeros, which cost time only.
ZEROS, LONG_REFERENCE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}+;?")
REPLY = re.compile(r"\b(?:reply|permalink)\b", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """doubt: 3 for what never holds text, 2 for tags and whole names of what is beside articles, 1 for such a part of a name;
    weak: a part that says little; talk: comments, by name or by their lines to reply."""

    __slots__ = ("tag", "parent", "parts", "doubt", "weak", "talk", "shape", "answered", "bad", "good", "points", "chars", "linked", "mass", "tied")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.parts = tag, parent, []
        self.points, self.chars, self.linked, self.mass, self.tied = 0.0, 0, 0, 0, 0
        self.weak, self.talk, self.answered, self.shape = False, False, False, tag
        self.good, self.bad = tag in ("article", "main"), False
        self.doubt = 3 if tag in NEVER else 2 if tag in ASIDE else 0
        if attributes and tag not in ("html", "body") and self.doubt < 3 and TELLING.search(attributes):
            self.name(attributes)

    def name(self, attributes: str) -> None:
        whole: set[str] = set()
        doubtful, strong = False, False
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
                self.doubt = 3
                return
            if key == "class":
                self.shape = f"{self.tag} {value}"
            if key in ("class", "id", "role"):
                for name in value.split():
                    words = [w.lower() for w in NAMES.findall(name)]
                    whole.add(name.lower())
                    if not STATES.intersection(words):
                        said = BAD.intersection(words)
                        doubtful |= len(words) > 1 and bool(said)
                        strong |= len(words) > 1 and bool(said) and (words[-1] in BAD or not said <= WEAK)
                        self.talk |= not TALK.isdisjoint(words)
                    self.good |= bool(words) and GOOD.issuperset(words)
        named = not BAD.isdisjoint(whole)
        if self.tag in ("article", "main"):
            named = doubtful = False
        self.weak = not named and not strong
        self.doubt = max(self.doubt, (1 if self.good else 2) if named else 1 if doubtful and not self.good else 0)


class Open:
    """The elements that are open, by depth and by tag, so that no question about them walks through them."""

    def __init__(self, root: Node):
        self.path, self.by_tag = [root], defaultdict(list, {root.tag: [0]})
        self.block, self.scope = [0], [-1]  # the depths of the innermost block and scope, at each depth

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.by_tag[node.tag].append(depth)
        self.path.append(node)
        self.block.append(depth if node.tag in BLOCK else self.block[-1])
        self.scope.append(depth if node.tag in SCOPE else self.scope[-1])

    def close(self, depth: int) -> None:
        """Closes what is open from a depth on; the root stays."""
        for node in self.path[: max(depth, 1) - 1 : -1]:
            self.by_tag[node.tag].pop()
        for held in (self.path, self.block, self.scope):
            del held[max(depth, 1) :]

    def last(self, tags: Iterable[str]) -> int:
        """The depth of the innermost open element with such a tag; -1 without one."""
        return max((d[-1] for t in tags if (d := self.by_tag.get(t))), default=-1)

    def first_after(self, tags: Iterable[str], depth: int) -> int | None:
        """The depth of the outermost open element with such a tag below a depth."""
        return min((d[k] for t in tags if (d := self.by_tag.get(t)) and (k := bisect_right(d, depth)) < len(d)), default=None)


def tree(html: str) -> list[Node]:
    """The elements of a page, the root first and each after its parent; wrongly nested tags are mended as browsers mostly do.

    Each step is bounded by what it reads: a tag's end is looked for once, quotes are no more trusted up to where a tag was not
    closed because of one, and open elements are found by tag.
    """
    root = Node("html", None, "")
    nodes, opened, at = [root], Open(root), 0
    last_end, broken = html.rfind(">"), -1
    while at < len(html):
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            opened.path[-1].parts.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        if at > last_end:  # no tag ends from here on
            opened.path[-1].parts.append(html[m.start() :])
            break
        end = INSIDE.match(html, at).end() if at >= broken else -1
        if end < 0 or html[end : end + 1] != ">":
            broken, end = max(broken, end), html.find(">", at)
        attributes, at = html[at:end], end + 1
        tag = m[2].lower()
        if m[1]:
            depth = opened.last([tag])
            # an inline end tag doesn't close blocks
            if depth > 0 and (tag in BLOCK or depth > opened.block[-1]):
                opened.close(depth)
            continue
        if tag in ("html", "body") and len(opened.path) == 1:
            continue
        if tag in BLOCK and (depth := opened.last(["p"])) > opened.scope[-1]:
            opened.close(depth)
        if tag in CLOSES and (depth := opened.first_after(CLOSES[tag], max(opened.last(SCOPE - CLOSES[tag]), 0))) is not None:
            opened.close(depth)
        child = Node(tag, opened.path[-1], attributes)
        nodes.append(child)
        opened.path[-1].parts.append(child)
        if tag in RAW:
            found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at, last_end + 1)
            at = found.end() if found else len(html)
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
            opened.push(child)
    return nodes


def blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(holder, text, characters in links) of each block of text below `top`, in page order, without what is bad."""
    buffer: list[str] = []
    links = 0
    stack: list[tuple[Node, int, int]] = [(top, 0, 0)]

    def flush(holder: Node):
        nonlocal links
        text = " ".join(unescape("".join(buffer)).split())
        buffer.clear()
        told, links = links, 0
        return (holder, text, min(told, len(text))) if text else None

    holders = [top]
    while stack:
        node, i, inside = stack.pop()
        while i < len(node.parts):
            part = node.parts[i]
            i += 1
            if isinstance(part, str):
                buffer.append(part)
                if inside:
                    links += len(" ".join(part.split()))
                continue
            if part.bad:
                if part.tag in BLOCK and (b := flush(holders[-1])):
                    yield b
                continue
            if part.tag in VOID:
                if part.tag == "hr":
                    if b := flush(holders[-1]):
                        yield b
                elif part.tag == "br":
                    buffer.append(" ")
                continue
            if part.tag in BLOCK:
                if b := flush(holders[-1]):
                    yield b
                holders.append(part)
            stack.append((node, i, inside))
            node, i, inside = part, 0, inside or part.tag == "a"
        if node.tag in BLOCK or node is top:
            if b := flush(holders[-1]):
                yield b
            if node is not top:
                holders.pop()


def add_up(nodes: list[Node], *names: str) -> None:
    """Adds each element's numbers to its parent's, from the leaves up."""
    for node in reversed(nodes[1:]):
        for name in names:
            setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))


def weigh(nodes: list[Node]) -> None:
    """Gives all elements the characters of their blocks, in links and outside, and finds comments by their shape: siblings of one
    shape that mostly hold a short line to reply."""
    for holder, text, links in blocks(nodes[0]):
        holder.mass += len(text) - links
        holder.tied += links
        holder.answered |= len(text) <= 80 and bool(REPLY.search(text))
    add_up(nodes, "mass", "tied", "answered")
    alike, answered = defaultdict(Counter), defaultdict(Counter)
    for n in nodes[1:]:
        if n.mass and n.tag in BLOCK:
            alike[n.parent][n.shape] += 1
            answered[n.parent][n.shape] += n.answered > 0
    for parent, shapes in answered.items():
        if any(k >= 2 and 3 * k >= 2 * alike[parent][shape] for shape, k in shapes.items()):
            for x in parent.parts:
                if isinstance(x, Node) and shapes[x.shape] >= 2:
                    x.talk = True


def condemn(root: Node, holds: float) -> None:
    """Marks as bad what never holds text, comments beside anything else, and doubtful elements that hold less than such a share
    of the page's other text."""
    talk, stack = 0, [root]
    while stack:
        for x in stack.pop().parts:
            if isinstance(x, Node):
                if x.talk:
                    talk += x.mass
                else:
                    stack.append(x)
    aside = talk > 0 and root.mass - talk >= OTHER * root.mass
    mass, stack = root.mass - talk if aside else root.mass, [root]
    while stack:
        for x in stack.pop().parts:
            if isinstance(x, Node):
                limit = holds if x.doubt == 2 else min(holds, HOLDS_DOUBTFUL)
                if x.weak and x.tied < LINKS * (x.mass + x.tied):
                    limit = min(holds, HOLDS_WEAK)
                x.bad = x.doubt == 3 or x.talk and aside or x.doubt > 0 and x.mass < limit * mass
                if not x.bad:
                    stack.append(x)


def density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def worth(n: Node) -> float:
    return n.points * (1 - density(n)) * (BETTER if n.good else DOUBTFUL if n.doubt else 1.0)


def score(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[Node]:
    """Gives each block's points to the elements around it, fewer the further they are; the elements that hold any block."""
    for holder, text, links in found:
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        if holder.tag in HEADINGS or holder.tag in ("li", "th", "dt"):
            points *= 0.25
        holder.chars += len(text)
        holder.linked += links
        node = holder
        # a paragraph is no container itself
        if holder.tag not in ("div", "section", "article", "main", "body", "html", "td", "center"):
            node = holder.parent or holder
        for level in range(LEVELS):
            node.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            node = node.parent
            if node is None:
                break
    add_up(nodes, "chars", "linked")
    return [n for n in nodes if n.points > 0]


def main_text(html: str) -> str:
    nodes = tree(LONG_REFERENCE.sub("\ufffd", ZEROS.sub("&#", html)))
    root = nodes[0]
    condemn(root, -1)
    weigh(nodes)
    found: list = []
    for holds in (HOLDS, 0.5, -1):  # with less severity where nothing is left
        condemn(root, holds)
        found = list(blocks(root))
        if sum(len(text) - links for _, text, links in found) > (1 - HOLDS) * (root.mass - sum(n.mass for n in nodes if n.talk and n.bad)):
            break
    if not found:
        return ""
    best = max(score(nodes, found), key=worth)
    # an article's headline and short parts stand beside its best container, but within the article
    around, node = [], best
    while node is not None and node.tag not in ("html", "body"):
        around.append(node)
        node = node.parent
    named = [n for n in around if n.tag == "article"] or [n for n in around if n.tag == "main"] or list(takewhile(lambda n: n.good, around))
    if named:
        return "\n".join(text for _, text, _ in blocks(named[-1]))
    kept = []
    for part in best.parent.parts if best.parent is not None else [best]:
        if part is best:
            kept.append(part)
        elif isinstance(part, Node) and not part.bad and part.chars and density(part) < 0.25:
            if part.tag in PROSE or part.points > 0 and worth(part) >= SIBLING * worth(best):
                kept.append(part)
    return "\n".join(text for k in kept for _, text, _ in blocks(k))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null html is empty, and so is the text where no block is found.  Null urls stay null; repeated rows give repeated rows;
    markup of any length and with any errors gives some text.  Other columns are ignored; an empty frame stays empty.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
