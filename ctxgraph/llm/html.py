"""Main-text extraction from HTML by tree scoring.

The page is parsed into a tree of elements (with the end tags that HTML implies; a head ends at the first tag or text that
can't stand in one), scripts, styles, comments and the like aside. Boilerplate subtrees are left out: by tag (nav, footer,
aside, ...), by ARIA role, by words in class or id (ad, sidebar, cookie, comment, ...), or hidden; a ``header`` only outside
an article or where it holds no heading. Inside an article or main element such words are evidence only: 2 for one of
``BAD``, 1 for one of ``WEAK`` as well, less 1 if another word of the same name is no usual part of a layout
(share-price, related-work), less 1 if the subtree has text of which less than half stands in links; it goes if any is left.
A form is left out unless the page stands in it: it holds over half of the text, and no article or main element with
text is outside of it.

Every paragraph of 25 characters or more passes points to its ancestors: 1, one for each comma (of any script) and one for
each 100 characters up to 3; the parent gets them whole and each further ancestor half of what the one below it has. The
points of an element are multiplied by 1 - link density, and the best one is the container; of its siblings those are kept
that score a fifth of its points (10 at least), or are paragraphs of their own with few links, as well as headings right
before them. An ``article`` or ``main`` around the container takes its place if it holds no second article of its own
standing. A page of shorter texts alone gives the first article, main or body element, or all of it.

Blocks of text (paragraphs, headings, list items, table cells, preformatted and loose text) come in page order, with
character references decoded, each run of white space one space, trimmed, and joined by two line ends. Null and empty html
and a page without text give an empty string. Ties go to the first container in page order. Rows are kept one for one,
repeated ones alike; a column named as the result is replaced. Pages of any length and depth are read whole in time that
grows with their length: each sign is looked at a bounded number of times, and all passes over the tree are loops. A tag
that never ends is text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, table
from .bpe import _q, portions

#: A tag up to its end. Possessive, so nothing is read twice; quotes count after an equals sign only.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>\x00]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
VOID_END = re.compile(r"(?:^|[\s\"'])/\Z")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")
WORDS = re.compile(r"[a-z]+|\d+")
SPACE = re.compile(r"\s+")
COMMAS = re.compile(r"[,،、，﹐؛;]")
NUMERIC = re.compile(r"&#(?:(\d{8,})|[xX]([0-9a-fA-F]{8,}));?")

#: The content of these is not markup; it ends at their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "head", "nav", "footer", "aside", "button", "select", "option", "datalist", "input", "label", "fieldset", "dialog", "menu", "svg", "math", "canvas", "audio", "video", "object", "embed", "applet", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "status"}
#: In class or id, as words of their own.
BAD = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "promoted", "sidebar", "sidebars", "sidenav", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "banner", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "respond", "replies", "related", "recommended", "recommendations", "trending", "pagination", "pager", "toolbar", "widget", "widgets", "skip", "skiplink", "legal", "copyright", "disclaimer", "outbrain", "taboola", "tags", "taglist", "alert"}
#: Of these the ones that content is often named by, too.
WEAK = {"alert", "banner", "legal", "menu", "menus", "overlay", "replies", "respond", "taglist", "tags", "toolbar", "widget", "widgets"}
LAYOUT = set("area article articles bar block body bottom box btn button buttons card cards col column container content count div entry field fixed flex float form grid group head header heading holder icon icons id inline inner inside item items label large layout left line link links list main message mobile module outer page panel part post posts primary region right row secondary section single site size slot small span text thread title top unit ul user wide wrap wrapper xl".split())
HEADER = {"header", "pageheader", "siteheader", "topbar"}
PARTS = re.compile(r"sidebar|navbar|advert|sponsor|cookie|newsletter|comment(?!ary)|breadcrumb|popup|disqus|promo(?:box|tion)?\b|masthead|footer")
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag of the key closes open elements of the set, up to one of the fence.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
CLOSES_P = BLOCK - {"html", "body"}
SCOPE = {"article", "aside", "blockquote", "body", "div", "fieldset", "figure", "footer", "form", "header", "html", "li", "main", "nav", "section", "table", "td", "th", "ul", "ol", "dl"}
HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "template", "head", "html"}
OWN = {"p", "li", "pre", "td", "th", "dd", "dt", "blockquote", "figcaption"}


class Node:
    __slots__ = ("tag", "parent", "kids", "bad", "doubt", "index", "last", "heading", "inside", "points", "size", "linked", "order", "keep")

    def __init__(self, tag: str, parent: Node | None, index: int):
        self.tag, self.parent, self.index, self.last, self.kids = tag, parent, index, index, []
        self.bad, self.doubt, self.heading, self.inside, self.keep = False, 0, False, False, False
        self.points, self.size, self.linked, self.order = 0.0, 0, 0, -1

    def holds(self, other: Node) -> bool:
        return self.index <= other.index <= self.last


def judge(tag: str, attrs: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is boilerplate by its tag and attributes, and the evidence for it if that isn't sure. ``inside``:
    within an article or main element."""
    if tag in DROP:
        return True, 0
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False, 0
    found = {k.lower(): decoded(a or b or c or "") for k, a, b, c in ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return True, 0
    if found.get("role", "").lower() in ROLES:
        return True, 0
    if tag in ("html", "body", "article", "main"):
        return False, 0
    doubt = 0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        name = CAMEL.sub(r"\1 \2", name).lower()
        words = set(WORDS.findall(name))
        if not inside:
            if words & BAD or words & HEADER or PARTS.search(name):
                return True, 0
        elif words & BAD or PARTS.search(name):
            other = any(not (w in BAD or w in LAYOUT or len(w) == 1 or w.isdigit() or PARTS.search(w)) for w in words)
            doubt = max(doubt, (1 if words & BAD and words & BAD <= WEAK else 2) - other)
    return False, doubt


def parse(html: str) -> list[Node]:
    """The elements in page order, the root first."""
    root = Node("#root", None, 0)
    nodes, stack = [root], [root]
    opened: dict[str, list[int]] = {}  # of each tag the places of its open elements in the stack
    blocks_open, scopes = [], [0]
    at, n, inside, ends, sections = 0, len(html), 0, html.rfind(">"), html.rfind("]]>")

    def close(place: int) -> None:
        nonlocal inside
        while len(stack) > place:
            tag = stack.pop().tag
            opened[tag].pop()
            inside -= tag in ("article", "main")
            if tag in BLOCK:
                blocks_open.pop()
            if tag in SCOPE:
                scopes.pop()

    def last(tag: str) -> int:
        places = opened.get(tag)
        return places[-1] if places else 0

    def text(t: str) -> None:
        if stack[-1].tag == "head" and not t.isspace():
            close(len(stack) - 1)
        stack[-1].kids.append(t)

    while at < n:
        start = html.find("<", at)
        if start < 0 or start > ends:
            text(html[at:])
            break
        if start > at:
            text(html[at:start])
        two = html[start + 1 : start + 2]
        if two in ("!", "?") or two == "/" and not html[start + 2 : start + 3].isalpha():
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = n if end < 0 else end + 3
            else:
                section = start < sections and html.startswith("<![CDATA[", start)
                at = html.find("]]>", start) + 3 if section else html.find(">", start) + 1
            continue
        m = TAG.match(html, start)
        if not m:
            text("<")
            at = start + 1
            continue
        at = m.end()
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(" ")
                continue
            found = last(tag)
            if tag == "p":
                ok = found > scopes[-1]
            elif tag in BLOCK:
                ok = found > 0 and (tag in ("table", "html", "body") or found > last("table"))
            else:
                ok = found > (blocks_open[-1] if blocks_open else 0)  # no inline element closes a block inside it
            if ok:
                close(found)
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at, ends + 1)
            at = m.end() if m else n
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in CLOSES_P and last("p") > scopes[-1]:
            close(last("p"))
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(len(stack) - 1)
        if tag in IMPLIED:
            shut, fence = IMPLIED[tag]
            low = max(map(last, fence), default=0)
            places = [p[k] for t in shut if (p := opened.get(t)) and (k := bisect_right(p, low)) < len(p)]
            if places:
                close(min(places))
        node = stack[-1]
        if tag in VOID and tag != "hr":
            node.kids.append("\n" if tag == "br" else " " if tag in ("img", "input") else "")
            continue
        child = Node(tag, node, len(nodes))
        child.bad, child.doubt = judge(tag, attrs, inside > 0)
        nodes.append(child)
        node.kids.append(child)
        if tag != "hr" and not VOID_END.search(attrs):
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks_open.append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append(child)
            inside += tag in ("article", "main")
    return nodes


def settle(nodes: list[Node]) -> None:
    """Decide on doubtful elements and forms, from the text that stands in them; fill ``last``, ``heading``, ``inside``."""
    for x in nodes[1:]:
        x.inside = x.parent.inside or x.parent.tag in ("article", "main", "section")
    doubtful = any(x.doubt or x.tag == "form" for x in nodes)
    size, linked = [0] * len(nodes), [0] * len(nodes)
    forms, held = [], []
    for x in reversed(nodes):
        i = x.index
        if doubtful:
            size[i] += sum(len(k.strip()) for k in x.kids if isinstance(k, str))
            if x.tag == "a":
                linked[i] = size[i]
            if x.doubt and x.doubt > (linked[i] < size[i] / 2):
                x.bad = True
            if x.tag in ("article", "main") and size[i]:
                held.append(x)
            if x.tag == "form" and not x.bad:
                forms.append(x)
                x.bad = True
        up = x.parent
        if up is not None:
            up.last = max(up.last, x.last)
            up.heading = up.heading or x.heading or x.tag in HEADINGS
            if doubtful and not x.bad:
                size[up.index] += size[i]
                linked[up.index] += linked[i]
    if forms:
        dark = [False] * len(nodes)  # inside of something left out
        for x in nodes[1:]:
            dark[x.index] = dark[x.parent.index] or x.parent.bad
        shown = [f for f in forms if not dark[f.index]]
        total = size[0] + sum(size[f.index] for f in shown)
        for f in shown:
            if size[f.index] * 2 > total and all(f.holds(x) or x.holds(f) for x in held):
                f.bad = False


def decoded(raw: str) -> str:
    """Character references decoded; numbers beyond Unicode, of any length, as U+FFFD."""
    if "&" not in raw:
        return raw
    if "&#" in raw:
        raw = NUMERIC.sub(lambda m: f"&#{'x' if m[2] else ''}{short};" if len(short := (m[1] or m[2]).lstrip("0") or "0") < 8 else "\ufffd", raw)
    return unescape(raw)


def clean(raw: str) -> str:
    return SPACE.sub(" ", decoded(raw)).strip()


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters of it inside links) in page order, without boilerplate."""
    out, run = [], []

    def flush(owner):
        if run:
            text = clean("".join(t for t, _ in run))
            if text:
                out.append((owner, text, min(len(text), sum(len(clean(t)) for t, linked in run if linked))))
            run.clear()

    stack = [(root, iter(root.kids), root, False)]
    while stack:
        node, kids, owner, linked = stack[-1]
        for k in kids:
            if isinstance(k, str):
                run.append((k, linked))
            elif k.bad or k.tag == "header" and not (k.inside and k.heading):
                if k.tag in BLOCK:
                    flush(owner)
            elif k.tag in BLOCK:
                flush(owner)
                stack.append((k, iter(k.kids), k, linked))
                break
            else:
                stack.append((k, iter(k.kids), owner, linked or k.tag == "a"))
                break
        else:
            stack.pop()
            if node is owner:
                flush(owner)
    return out


def weight(x: Node) -> float:
    return x.points * (1 - x.linked / max(1, x.size))


def extract(html: str | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    settle(nodes)
    found = blocks(nodes[0])
    if not found:
        return ""
    for order, (owner, text, linked) in enumerate(found):
        owner.size += len(text)
        owner.linked += linked
        if owner.tag in HEADINGS or len(text) < 25:
            continue
        points = (1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3)) * (1 - linked / len(text))
        node = owner.parent if owner.tag in OWN and owner.parent is not None else owner
        node.points += points
        node.order = order if node.order < 0 else node.order
    for x in reversed(nodes):  # from the leaves up
        up = x.parent
        if up is not None:
            up.size += x.size
            up.linked += x.linked
            up.points += x.points / 2
            if x.order >= 0:
                up.order = x.order if up.order < 0 else min(up.order, x.order)
    scored = [x for x in nodes if x.order >= 0]
    if scored:
        best = max(scored, key=lambda x: (weight(x), -x.order, x.index))
    else:  # short texts only: the article, main or body element, whichever is there
        best = next((x for tag in ("article", "main", "body") for x in nodes if x.tag == tag and not x.bad), nodes[0])
    up = best.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and not any(x.tag == "article" and up.holds(x) and x is not up and not x.holds(best) and not best.holds(x) for x in scored):
        best = up
    best.keep = True
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        kids = [k for k in best.parent.kids if not isinstance(k, str) and not k.bad]
        starts = [k.index for k in kids]
        limit = max(10.0, weight(best) * 0.2)
        ends = {}
        for owner, text, _ in found:
            at = bisect_right(starts, owner.index) - 1
            if at >= 0 and kids[at].holds(owner):
                ends[at] = text
        for at, k in enumerate(kids):
            if weight(k) >= limit:
                k.keep = True
            elif k.tag in ("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure") and k.size and at in ends:
                if k.size > 80 and k.linked / k.size < 0.25 or k.size <= 80 and k.linked == 0 and k.tag == "p" and re.search(r"[.!?。！？][\"'”’)]*\Z", ends[at]):
                    k.keep = True
        for k, after in zip(kids, kids[1:]):
            if (k.tag in HEADINGS or k.tag == "header") and after.keep:
                k.keep = True
    for x in nodes[1:]:
        x.keep = x.keep or x.parent.keep
    return "\n\n".join(text for owner, text, _ in found if owner.keep)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out`` (string, never null): the main text of each page. Other columns but ``html`` pass through."""
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (out, html)]
    schema = pages.select(*map(_q, kept)).withColumn(out, F.lit("")).schema

    def run(batches):
        for b in batches:
            for part in portions(b, html, 8_000_000):
                texts = pa.array([extract(x.as_py()) for x in part.column(html)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [texts], names=[*kept, out])

    return pages.mapInArrow(run, schema)


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
