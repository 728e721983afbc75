"""Main text of web pages by minimum-cut labelling.

A page is read once, from left to right, into text blocks in page order, each with its path in the tree. A logistic
classifier, fitted here on pages that a generator lays out (`pages_of.py` holds it), gives every block a cost of being
called content and a cost of being called boilerplate. The costs are the capacities of its edges to source and sink;
blocks that follow one another and blocks near in the tree get edges of smoothness, weak where a region such as a menu
or a comment list begins or ends. The minimum cut of this graph, found by maximum flow, separates content from
boilerplate.

The classifier sees tags, roles and names around a block, its length, punctuation and share of linked text, and whether
it lies in the page's principal element: the article or main element with most unlinked words, or, without one, the
element whose paragraphs have most. What the principal element lies in (a form around the whole page, a wrapper with an
unlucky name) says nothing against it.

Scripts, styles, comments, the head, the fields of forms and what is never shown hold no text blocks; formulas, drawings
and fallbacks of objects are text like any other. Character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by an empty line. Null and empty html, and pages without text, give an empty
text. Unclosed and stray tags are accepted, as browsers do; a quote that is never closed ends with its tag. Very long
and very deep pages are read whole, in time that grows in proportion. Rows are never merged or dropped; repeated rows
are read each for themselves. An empty table gives an empty result. Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SKIP = re.compile(r"[\s/]+")
ATTRIBUTE_NAME = re.compile(r"[^\s/>=]+")
EQUALS = re.compile(r"\s*=\s*")
BARE_VALUE = re.compile(r"[^\s>]*")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements whose content is read up to their end tag and is no text of the page.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
#: Elements whose text is never shown or belongs to a form's field.
MUTE = {"select", "datalist", "button", "annotation", "annotation-xml", "desc", "metadata", "defs"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that interrupt a run of text; others, but for those with a hyphen in their name, don't.
BLOCK = set(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav "
    "noscript ol optgroup option p plaintext pre search section summary table tbody td template tfoot th thead tr ul xmp".split()
)
#: Elements that do not end an open paragraph.
WITHIN_P = {"body", "html", "head", "caption", "colgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "option", "optgroup", "noscript", "template"}
#: Open elements that a start tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
#: Elements that an end tag does not reach beyond, unless it is of one of them, and tags that end a mute element.
BORDERS = ("td", "th", "caption", "table", "template")
UNMUTE = {"article", "main", "section", "header", "footer", "nav", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: What an element says of the text in it, one bit each.
FLAGS = ("nav", "footer", "aside", "header", "form", "dialog", "noscript", "address", "hidden", "bad_name", "comment_name", "header_name", "article", "main", "principal", "good_name", "body_mark", "within")
BIT = {k: 1 << i for i, k in enumerate(FLAGS)}
TAG_FLAGS = {
    "nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "header": "header", "form": "form", "fieldset": "form", "search": "form", "dialog": "dialog", "noscript": "noscript", "address": "address",
    "article": "article", "main": "main", "template": "hidden", "head": "hidden",
}
ROLE_FLAGS = {
    "navigation": "nav", "menu": "nav", "menubar": "nav", "contentinfo": "footer", "complementary": "aside", "banner": "header", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog",
    "article": "article", "main": "main",
}
#: Flags that begin a region: no smoothness across its border.
REGION = sum(BIT[k] for k in ("nav", "footer", "aside", "form", "dialog", "noscript", "hidden", "bad_name", "comment_name"))
COMMENT_NAME = re.compile(r"comment|repl(?:y|ies)$|respond|disqus|discussion|guestbook")
HEADER_NAME = re.compile(r"^(?:header|heading|head|masthead|topbar|top|hero|title|headline)$")
BAD_NAME = re.compile(
    r"^(?:ad|ads|adv|advert\w*|adsense|adbox|adslot|dfp|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|overlay|newsletters?|subscri\w*|signup|signin|login|register|paywall|"
    r"sidebar\w*|side|aside|widgets?|rail|nav|navbar|navigation|menus?|breadcrumbs?|toolbar|footer|foot|bottom|more|latest|copyright|disclaimer|social\w*|shar(?:e|es|ing)|follow|related\w*|recommend\w*|trending|popular|"
    r"tags?|tagcloud|categories|pagination|pager|search\w*|skip\w*|outbrain|taboola|teasers?|cards?|complementary|contentinfo)$"
)
GOOD_NAME = re.compile(r"^(?:articles?|post|entry|story|main|content|text|prose|body|page|blog)$")
#: A class that tells a page's state ("has-sidebar", "comments-open"), not what the element is.
STATE_NAME = re.compile(r"(?:^|[-_])(?:has|no|with|without|is|hide|show)[-_]|[-_](?:open|closed|enabled|disabled|active)$")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CUE = re.compile(
    r"cookie|subscribe|newsletter|sign (?:up|in)|log ?in|register|read more|related|advertis|sponsored|\bshare|follow us|rights reserved|privacy|terms of|skip to|menu|search|comment|reply|contact us|all posts|tagged|filed under|print|previous|next (?:post|article)",
    re.I,
)
LEGAL = re.compile(r"(?:©|\(c\) |copyright\b|all rights reserved)", re.I)


class Node:
    """An element: its place in the tree, its own flags, and its unlinked words."""

    __slots__ = ("tag", "parent", "number", "depth", "own", "flags", "words", "region")

    def __init__(self, tag: str, parent: Node | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.own = self.flags = self.words = self.region = 0


class Block:
    """A run of text that no block element interrupts, in its nearest block element."""

    __slots__ = ("node", "parts", "linked", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.text = node, [], 0, ""


def names_flag(value: str) -> int:
    """Flags of the words in a class or an id."""
    found = 0
    for name in CAMEL.sub("-", value).lower().split():
        if STATE_NAME.search(name):
            continue
        if COMMENT_NAME.search(name):
            found |= BIT["comment_name"]
            continue
        words = WORD.findall(name)
        good = any(map(GOOD_NAME.match, words))
        if any(map(BAD_NAME.match, words)):
            found |= BIT["bad_name"]
        elif any(map(HEADER_NAME.match, words)):
            found |= BIT["good_name" if good else "header_name"]
        elif good:
            found |= BIT["good_name"]
    return found


def read_tag(page: str, pos: int) -> tuple[list[tuple[str, str]], bool, int]:
    """(attributes, whether it closes itself, end) of the tag whose name ends at pos."""
    found, n = [], len(page)
    while True:
        m = SKIP.match(page, pos)
        slash = bool(m) and m[0].endswith("/")
        pos = m.end() if m else pos
        if pos >= n or page[pos] == ">":
            return found, slash, min(pos + 1, n)
        if page[pos] == "<":  # the tag before was never closed
            return found, False, pos
        m = ATTRIBUTE_NAME.match(page, pos)
        name, pos = (m[0].lower(), m.end()) if m else ("", pos + 1)
        m = EQUALS.match(page, pos) if m else None
        value = ""
        if m:
            pos = m.end()
            quote = page[pos : pos + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, pos + 1)
                stop = page.find(">", pos + 1, end if end >= 0 else n)
                after = page[end + 1 : end + 2]
                if end < 0 or stop >= 0 and (page[end - 1] == "=" or after and not after.isspace() and after not in "/>"):
                    if stop < 0:
                        return found, False, n
                    found.append((name, page[pos + 1 : stop]))  # the quote was never closed: it ends with the tag
                    return found, False, stop + 1
                value, pos = page[pos + 1 : end], end + 1
            else:
                m = BARE_VALUE.match(page, pos)
                value, pos = m[0], m.end()
        if name:
            found.append((name, value))


class Reader:
    """Reads a page into nodes and blocks; the stack of open elements knows the places of every tag."""

    def __init__(self, page: str):
        self.page = page
        self.stack: list[Node] = [Node("", None, 0)]
        self.nodes: list[Node] = [self.stack[0]]
        self.places: dict[str, list[int]] = {}
        self.block_places = [0]
        self.mute = 0
        self.linked = False
        self.blocks: list[Block] = []
        self.open: Block | None = None

    def top(self, tags) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        node = Node(tag, self.stack[-1], len(self.nodes))
        self.places.setdefault(tag, []).append(len(self.stack))
        if is_block(tag):
            self.block_places.append(len(self.stack))
        self.mute += tag in MUTE
        own = BIT.get(TAG_FLAGS.get(tag), 0)
        for name, value in attributes:
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
                own |= BIT["hidden"]
            elif name == "role":
                own |= BIT.get(ROLE_FLAGS.get(value.strip().lower()), 0)
            elif name in ("class", "id") and tag not in ("body", "html"):
                own |= names_flag(value)
            elif name == "itemprop" and value.strip().lower() in ("articlebody", "headline"):
                own |= BIT["body_mark"]
        node.own = own
        self.stack.append(node)
        self.nodes.append(node)

    def pop_to(self, place: int) -> None:
        """Closes the element at this place of the stack and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if self.block_places[-1] == len(self.stack):
                self.block_places.pop()
            self.mute -= node.tag in MUTE

    def put(self, text: str) -> None:
        if not text or self.mute:
            return
        if self.open is None:
            if text.isspace():
                return
            self.open = Block(self.stack[self.block_places[-1]])
        if "&" in text:
            text = entities.unescape(text)
        self.open.parts.append(text)
        if self.linked:
            self.open.linked += len(text.strip())

    def close(self) -> None:
        if self.open is not None:
            self.open.text = SPACE.sub(" ", "".join(self.open.parts)).strip()
            if self.open.text:
                self.blocks.append(self.open)
            self.open = None

    def start(self, tag: str, attributes: list[tuple[str, str]], closed: bool) -> None:
        if tag == "br":
            self.put(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.close()
            return
        if self.mute and tag in UNMUTE:
            self.pop_to(min(self.places[t][0] for t in MUTE if self.places.get(t)))
        block = is_block(tag)
        if block:
            self.close()
            if tag not in WITHIN_P:
                p = self.top(("p",))
                if p > self.top(BORDERS):
                    self.pop_to(p)
                    self.linked = False
            if tag in ENDS:
                same, beyond = ENDS[tag]
                at = self.top(same)
                if at > self.top(beyond):
                    self.pop_to(at)
                    self.linked = False
        if closed and (tag not in BLOCK or "-" in tag):
            return
        if tag == "a":
            self.linked = True
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.linked = False
        block = is_block(tag)
        if block:
            self.close()
        places = self.places.get(tag)
        if not places:
            return
        at = places[-1]
        # an inline end tag closes nothing beyond its block, another one nothing beyond its table cell
        beyond = self.block_places[-1] if not block else 0 if tag in BORDERS or tag in ENDS else self.top(BORDERS)
        if at > beyond:
            self.pop_to(at)

    def read(self) -> Reader:
        page, n, pos = self.page, len(self.page), 0
        data_ends = True
        while pos < n:
            at = page.find("<", pos)
            if at < 0:
                self.put(page[pos:])
                break
            self.put(page[pos:at])
            following = page[at + 1 : at + 2]
            if following == "!" or following == "?":
                if page.startswith("<!--", at):
                    empty = page.startswith((">", "->"), at + 4)
                    end = page.find(">" if empty else "-->", at + 4)
                    pos = n if end < 0 else end + 1 if empty else end + 3
                    continue
                end = page.find("]]>", at) if data_ends and page.startswith("<![CDATA[", at) else -1
                if end >= 0:
                    self.put(entities.escape(page[at + 9 : end]))
                    pos = end + 3
                    continue
                data_ends = data_ends and not page.startswith("<![CDATA[", at)
                end = page.find(">", at)
                pos = end + 1 if end >= 0 else n
                continue
            m = NAME.match(page, at + 2 if following == "/" else at + 1)
            if m is None:
                if following == "/":  # a bogus end tag
                    end = page.find(">", at)
                    pos = end + 1 if end >= 0 else n
                else:
                    self.put("<")
                    pos = at + 1
                continue
            tag = m[0].lower()
            attributes, closed, pos = read_tag(page, m.end())
            if following == "/":
                self.end(tag)
            elif tag in RAW:
                if not (closed and self.places.get("svg")):
                    end = raw_end(tag).search(page, pos)
                    pos = end.end() if end else n
            elif tag == "xmp" or tag == "plaintext":
                self.close()
                end = raw_end(tag).search(page, pos)
                self.put(entities.escape(page[pos : end.start() if end else n]))
                self.close()
                pos = end.end() if end else n
            else:
                self.start(tag, attributes, closed)
        self.close()
        return self


def is_block(tag: str) -> bool:
    return tag in BLOCK or "-" in tag and tag not in MUTE


@functools.lru_cache(maxsize=16)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


#: What the words of an element count for in the choice of the principal one, by what speaks against it.
STANDING = {"hidden": 0.02, "noscript": 0.02, "nav": 0.05, "footer": 0.05, "dialog": 0.05, "comment_name": 0.1, "aside": 0.1, "bad_name": 0.3}


@functools.lru_cache(maxsize=4096)
def standing(flags: int) -> float:
    return math.prod(v for k, v in STANDING.items() if flags & BIT[k])


def weigh(reader: Reader) -> None:
    """Gives every node the unlinked words in it, the flags of all around it, and its region."""
    nodes = reader.nodes
    direct: dict[int, float] = {}
    for b in reader.blocks:
        words = round((b.text.count(" ") + 1) * (1 - min(1.0, b.linked / len(b.text))))
        b.node.words += words
        holder = b.node.parent
        if b.node.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") and holder is not None:
            direct[holder.number] = direct.get(holder.number, 0) + words
            if holder.parent is not None:
                direct[holder.parent.number] = direct.get(holder.parent.number, 0) + words / 2
        elif words > 20:
            direct[b.node.number] = direct.get(b.node.number, 0) + words / 2
    for node in reversed(nodes[1:]):
        node.parent.words += node.words
    for node in nodes[1:]:
        node.flags = node.parent.flags | node.own
    # an element counts for less the more speaks against it; a marked one is preferred to one that only has paragraphs
    marked = {x.number: x.words * standing(x.flags) for x in nodes if x.own & (BIT["article"] | BIT["main"])}
    plain = {i: words * standing(nodes[i].flags) for i, words in direct.items()}
    article = max((i for i in marked if nodes[i].own & BIT["article"]), key=lambda i: (marked[i], -i), default=0)
    if marked:
        most = max(marked, key=lambda i: (marked[i], -i))
        article = article if marked.get(article, 0) * 4 >= marked[most] else most
    other = max(plain, key=lambda i: (plain[i], -i), default=0)
    principal = nodes[article if marked.get(article, 0) * 3 >= plain.get(other, 0) else other]
    if not principal.number:
        principal = None
    around, x = set(), principal
    while x is not None:
        around.add(x.number)
        x = x.parent
    positive = BIT["article"] | BIT["main"] | BIT["good_name"] | BIT["body_mark"]
    for node in nodes[1:]:
        own = node.own & positive if node.number in around else node.own
        if node is principal:
            own |= BIT["principal"] | (0 if node.tag in ("body", "html") else BIT["within"])
        node.flags = node.parent.flags | own
        node.region = node.number if own & REGION else node.parent.region


#: Names of features(), in order. A pair holds where both of its flags do.
PAIRS = tuple((k, "within") for k in ("footer", "header", "bad_name", "header_name", "aside", "comment_name", "form"))
MORE = ("h1", "heading", "p", "item", "quote", "linked", "length", "stops", "ends", "legal", "cue", "long_principal", "outside_h1")
FEATURES = ("bias", *FLAGS, *map("_in_".join, PAIRS), *MORE)


def features(block: Block) -> list[float]:
    """A block's features, in the order of FEATURES."""
    node, text = block.node, block.text
    flags, tag = node.flags, node.tag
    words = text.count(" ") + 1
    linked = min(1.0, block.linked / len(text))
    stops = sum(map(text.count, ".!?;,"))
    out = [1.0, *[float(flags >> i & 1) for i in range(len(FLAGS))]]
    out += [float(flags & BIT[a] and flags & BIT[b] and 1) for a, b in PAIRS]
    inside = bool(flags & BIT["principal"])
    return out + [
        float(tag == "h1"), float(tag in HEADINGS), float(tag == "p"), float(tag in ("li", "td", "th", "dd", "dt", "option")), float(tag in ("blockquote", "pre", "figcaption")),
        linked, min(math.log1p(words), 5) / 5, min(stops / words, 0.5) * (1 - linked), float(text[-1] in ".!?…\"'”»:"),
        float(bool(LEGAL.match(text))), float(words < 25 and bool(CUE.search(text))), float(inside) * min(words, 40) / 40, float(tag == "h1" and not inside),
    ]


def read_page(page: str) -> list[Block]:
    """The text blocks of a page, in order, with what the classifier sees."""
    reader = Reader(page).read()
    weigh(reader)
    return reader.blocks


@functools.lru_cache(maxsize=2)
def fitted(pages: int = 700, seed: int = 11, ridge: float = 2e-5) -> tuple[float, ...]:
    """Weights of the features, by Newton's method on generated pages (a fixed number of them)."""
    from .pages_of import generated

    x, y = [], []
    for page, wanted in generated(seed, pages):
        left = list(wanted)
        for b in read_page(page):
            good = bool(left) and b.text == left[0]
            if good:
                left.pop(0)
            x.append(features(b))
            y.append(good)
        if left:
            raise AssertionError(f"a generated page does not hold {left[0]!r}")
    x, y = np.asarray(x), np.asarray(y, dtype=np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


#: Largest log-odds that a block's own costs may reach; more could not be overruled by any neighbours.
MOST_ODDS = 9.0


def costs(block: Block, weights: tuple[float, ...]) -> tuple[float, float]:
    """(cost of calling the block content, cost of calling it boilerplate): minus the logarithms of the probabilities."""
    odds = max(-MOST_ODDS, min(MOST_ODDS, sum(w * f for w, f in zip(weights, features(block), strict=True))))
    return math.log1p(math.exp(-odds)), math.log1p(math.exp(odds))


def proximity(a: Block, b: Block) -> float:
    """Smoothness between two blocks, by the steps between them in the tree; next to none across a region's border."""
    x, y, steps = a.node, b.node, 0
    if x.region != y.region or (x.flags ^ y.flags) & BIT["principal"]:
        return 0.02
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
        if steps > 8:
            return 0.05
    return 1.6 / (1 + steps)


def minimum_cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes lie on the source's side of a minimum cut. Dinic's maximum flow."""
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # this much flows straight through
        if source[i] > through:
            add(s, i, source[i] - through, 0.0)
        elif sink[i] > through:
            add(i, t, sink[i] - through, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:  # augmenting paths of this level graph, without recursion
            path: list[int] = []
            a = s
            while a != t:
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if cap[e] > eps and level[to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                else:
                    if not path:
                        break
                    level[a] = -1
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(out[a][at[a]])
                a = to[path[-1]]
            if a != t:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


def label(blocks: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """Which blocks are content."""
    both = [costs(b, weights) for b in blocks]
    edges = []
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 0.1 + proximity(blocks[i - 1], b)))
        holder = b.node.parent.number if b.node.parent else -1
        j = last_of.get(holder)
        if j is not None and j < i - 1:  # siblings that others stand between
            edges.append((j, i, proximity(blocks[j], b)))
        last_of[holder] = i
    return minimum_cut(len(blocks), [c[1] for c in both], [c[0] for c in both], edges)


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The article of a page."""
    blocks = read_page(page or "")
    return "\n\n".join(b.text for b, good in zip(blocks, label(blocks, weights or fitted()), strict=True) if good) if blocks else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    weights = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = pa.array([main_text(x, weights) for x in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], [id_col, url_col, "text"])

    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string"
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def op4_html_mincut(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_mincut": op4_html_mincut}
SQL: dict[str, str] = {}
