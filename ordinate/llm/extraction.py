"""HTML extraction with a tree-structured graphical model.

The blocks of a page are the nodes of a tree. Each node is content or not; its own potential comes from its tag,
its names, the length and links of its text, and the share of the page's text and the links below it, and the potential of an
edge says how likely a parent in one state has a child in the other. Both are counted on labelled pages. Sum-product messages pass upward from the
leaves and downward from the root, which gives each block's marginal; blocks of a marginal of THRESHOLD or more
are the page's text.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import random
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts

THRESHOLD = 0.5
#: Pseudo-count of features and of edges; labelled pages made for the default model, and their seed.
SMOOTHING, PAGES, SEED = 0.5, 600, 3
#: Attribute that labels a block of a training page and all below it, 1 or 0.
LABEL = "data-y"

# Elements of HTML by their kind.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template textarea select datalist button iframe svg".split())
TO_THE_END = frozenset("script style".split())
# Elements that end open ones of these kinds, as far as they are not outside one of those.
ENDS = {
    "li": ("li", "ul ol menu"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"),
    "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table"), "thead": ("thead tbody tfoot", "table"),
}
# Elements of a page that says nothing of its parts, if none has names; and those that end without a closing tag.
BARE = frozenset("html head title body p h1 h2 h3 h4 h5 h6 pre blockquote hr center div section".split())
IMPLIED = frozenset("p li dd dt td th tr".split())
SPACED = frozenset("br img input label wbr".split())
CLOSES_P = BLOCKS - frozenset("html head body title".split())

# A quoted value ends at a quote that is followed by what may follow a value, and holds no markup; any other quote is a character like others.
_QUOTED = r"\"[^\"<]*\"(?=[\s/>])|'[^'<]*'(?=[\s/>])"
_TAG = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:{_QUOTED}|[^>])*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    """A block of a page. within, under: its parent's tag and names; texts: its own pieces of text as (order on the page, text)."""

    tag: str
    parent: int
    within: str = ""
    under: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    label: int | None = None
    texts: list[tuple[int, str]] = field(default_factory=list)
    linked: int = 0
    share: float = 0.0
    links: float = 0.0
    bare: bool = False


class _Open:
    """The open blocks, inner ones last; the innermost of a kind is found without a walk."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.at = [0], ["html"], {}

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tags: tuple[str, ...]) -> int:
        """The depth of the innermost of the tags, 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, depth: int) -> None:
        while len(self.tags) > depth:
            self.at[self.tags.pop()].pop()
            self.nodes.pop()


_ENDS = {k: (tuple(a.split()), tuple(b.split())) for k, (a, b) in ENDS.items()}


def parse(page: str) -> list[Node]:
    """The blocks of a page, parents before children; node 0 is the root. Broken and cut-off markup is taken as it comes."""
    nodes = [Node("html", -1)]
    stack = _Open()
    pieces: list[str] = []
    order, at, anchors, end = 0, 0, 0, len(page)
    closed: dict[str, list[int]] = {}

    def flush() -> None:
        nonlocal order
        if pieces:
            if text := " ".join(entities.unescape("".join(pieces)).split()):
                nodes[stack.nodes[-1]].texts.append((order, text))
                order += 1
            pieces.clear()

    def add(text: str) -> None:
        pieces.append(text)
        if anchors:
            nodes[stack.nodes[-1]].linked += len(text)

    def end_of(name: str, start: int) -> int | None:
        """The end of the next closing tag of name; the page is searched once for each name."""
        if name not in closed:
            closed[name] = [m.end() for m in re.finditer(rf"</{name}\s*>", page, re.I)]
        k = bisect.bisect_right(closed[name], start)
        return closed[name][k] if k < len(closed[name]) else None

    def within(start: int, stop: int) -> bool:
        """Whether what lies between two places is within the innermost open block that needs a closing tag."""
        tag = next((t for t in reversed(stack.tags) if t not in IMPLIED), "html")
        depth = 0
        for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page[start:stop], re.I):
            depth += -1 if m[1] else 1
            if depth < 0:
                return False
        return True

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), m[1]
        if not m[4]:  # cut off within the tag
            at = end
            break
        if name in SKIPPED:
            if not closing and not m[3].endswith("/"):
                close = end_of(name, at)
                if name in TO_THE_END:
                    at = close if close is not None else end
                elif close is not None and (name == "textarea" or within(at, close)):  # else it was never closed, and takes nothing with it
                    at = close
            pieces.append(" ")
        elif name == "a":
            anchors = 0 if closing else 1
        elif name not in BLOCKS:
            if name in SPACED:
                pieces.append(" ")
        elif closing:
            flush()
            if depth := stack.last((name,)):
                stack.cut(depth)
        else:
            flush()
            anchors = 0
            if name in CLOSES_P and (depth := stack.last(("p",))):
                stack.cut(depth)
            if name in _ENDS:
                same, within = _ENDS[name]
                if (depth := stack.last(same)) > stack.last(within):
                    stack.cut(depth)
            given = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(m[3])} if m[3] else {}
            words = [w for k in ("class", "id", "role", "aria-label", "itemprop") if k in given for w in _NAME.findall(given[k])]
            label = int(given[LABEL]) if given.get(LABEL) in ("0", "1") else None
            if name == "html":
                nodes[0].names, nodes[0].label = tuple(words), label
            elif name not in VOID:
                nodes.append(Node(name, stack.nodes[-1], stack.tags[-1], nodes[stack.nodes[-1]].names, tuple(dict.fromkeys(words)), label))
                stack.push(len(nodes) - 1, name)
    if at < end:
        add(page[at:end])
    flush()
    _below(nodes)
    return nodes


def _below(nodes: list[Node]) -> None:
    """Sets of each node the share of the page's text that is within it, and of this text the share that is linked."""
    size, linked = [sum(len(t) for _, t in n.texts) for n in nodes], [n.linked for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        size[nodes[k].parent] += size[k]
        linked[nodes[k].parent] += linked[k]
    bare = 4 * linked[0] <= size[0] and all(n.tag in BARE and not n.names for n in nodes)
    for n, x, y in zip(nodes, size, linked):
        n.share, n.links, n.bare = x / max(1, size[0]), y / max(1, x), bare


def features(node: Node) -> list[str]:
    """Tag with parent's tag and whether it has names; its and the parent's names; share of text and links below; of blocks with text, its length and links.

    Of pages that say nothing of their parts, only whether a block is in the head.
    """
    if node.bare:
        return [f"bare={'head' if 'head' in (node.tag, node.within) or node.tag == 'title' else 'text'}"]
    out = [f"tag={node.tag}<{node.within}{'+' if node.names else ''}", *(f"name={w}" for w in node.names), *(f"under={w}" for w in node.under)]
    if node.share:
        out.append(f"below={sum(node.share > x for x in (0.05, 0.2, 0.5, 0.8))},{sum(node.links > x for x in (0.1, 0.5))}")
    if own := sum(len(t) for _, t in node.texts):
        out.append(f"text={min(4, int(math.log(own + 1, 4)))},{min(2, 3 * node.linked // own)}")
    return out


@dataclass
class Model:
    """Log-potentials: of features by state, of edges as [parent state][child state], of the root by state."""

    unary: dict[str, tuple[float, float]]
    edge: tuple[tuple[float, float], tuple[float, float]]
    root: tuple[float, float]


def train(pages: list[str]) -> Model:
    """The model counted on labelled pages: LABEL on a block (or on html) holds for it and all below it, up to another one; without it, the root is no content."""
    seen: dict[str, list[float]] = {}
    edges, states, roots = [[SMOOTHING] * 2, [SMOOTHING] * 2], [SMOOTHING * 2] * 2, [SMOOTHING] * 2
    for page in pages:
        nodes = parse(page)
        state = [0] * len(nodes)
        for k, node in enumerate(nodes):
            state[k] = node.label if node.label is not None else state[node.parent] if k else 0
            states[state[k]] += 1
            for f in features(node):
                seen.setdefault(f, [SMOOTHING, SMOOTHING])[state[k]] += 1
            if k:
                edges[state[node.parent]][state[k]] += 1
            else:
                roots[state[k]] += 1
    unary = {f: tuple(math.log(n / states[s]) for s, n in enumerate(c)) for f, c in seen.items()}
    edge = tuple(tuple(math.log(x / sum(row)) for x in row) for row in edges)
    return Model(unary, edge, tuple(math.log(x / sum(roots)) for x in roots))


def _plus(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(nodes: list[Node], model: Model) -> list[float]:
    """Each node's probability of being content: sum-product messages, upward from the leaves and downward from the root."""
    get, ((e00, e01), (e10, e11)) = model.unary.get, model.edge
    belief = []
    for node in nodes:
        u0 = u1 = 0.0
        for f in features(node):
            if p := get(f):
                u0 += p[0]
                u1 += p[1]
        belief.append([u0, u1])
    belief[0][0] += model.root[0]
    belief[0][1] += model.root[1]
    up = [(0.0, 0.0)] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        b0, b1 = belief[k]
        up[k] = _plus(e00 + b0, e01 + b1), _plus(e10 + b0, e11 + b1)
        parent = belief[nodes[k].parent]
        parent[0] += up[k][0]
        parent[1] += up[k][1]
    out = [0.0] * len(nodes)
    for k, node in enumerate(nodes):
        b = belief[k]
        if k:
            p, own = belief[node.parent], up[k]
            x0, x1 = p[0] - own[0], p[1] - own[1]  # the parent's belief without this child's message
            b[0] += _plus(x0 + e00, x1 + e10)
            b[1] += _plus(x0 + e01, x1 + e11)
        out[k] = 1 / (1 + math.exp(min(700.0, max(-700.0, b[0] - b[1]))))
    return out


def blocks(page: str, model: Model) -> list[tuple[str, float, str]]:
    """(tag, marginal, text) of the page's blocks of text, in their order."""
    nodes = parse(page)
    found = [(order, nodes[k].tag, p, text) for k, p in enumerate(marginals(nodes, model)) for order, text in nodes[k].texts]
    return [x[1:] for x in sorted(found, key=lambda x: x[0])]


def main_text(page: str | None, model: Model) -> str:
    return "\n\n".join(t for _, p, t in blocks(page, model) if p >= THRESHOLD) if page else ""


def extract(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """pages with text and n_chars (its code points), which replace columns of these names.

    A null or empty page has an empty text, and so has one without content. Pages of any length are read whole. Repeated rows are
    treated alike, an empty table stays empty.
    """
    prepare(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.decode("utf-8", "replace") if x is not None else None, sent.value) for x in column.to_pylist()], pa.string())

    return pages.withColumn("text", extracted(texts(html))).withColumn("n_chars", F.char_length("text").cast("bigint"))


# The names that labelled pages give their parts.
CONTENT_NAMES = "content post entry article body story main text prose page single".split()
MENU_NAMES = "nav menu navigation navbar topnav breadcrumb breadcrumbs links tabs pagination pager toc".split()
HEADER_NAMES = "header masthead site top branding logo title bar".split()
FOOTER_NAMES = "footer bottom copyright colophon legal site".split()
SIDE_NAMES = "sidebar side widget related recommended rail aside trending popular archive tags social share sharing".split()
NOTICE_NAMES = "cookie consent notice banner gdpr alert popup modal overlay newsletter message announcement privacy".split()
ADVERT_NAMES = "ad ads advert advertisement adsense sponsor sponsored promo promotion banner".split()
FORM_NAMES = "form search login subscribe signup newsletter contact".split()
COMMENT_NAMES = "comments comment replies reply discussion respond thread disqus reader".split()


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages of made-up words whose content is labelled, in the layouts that sites use."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n r s t".split() for b in "a e i o u".split()]

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def named(names: list[str], much: float = 0.9) -> str:
        if r.random() > much:
            return ""
        chosen = "-".join(r.sample(names, k=r.choice((1, 1, 2)))) + r.choice(("", "", "", f" {r.choice(names)}"))
        return f' {r.choice(("class", "class", "id"))}="{chosen}"'

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b)))

    def menu() -> str:
        tag = r.choice(("nav", "nav", "nav", "div", "ul"))
        inner = links(2, 9) if tag == "ul" else f"<ul>{links(2, 9)}</ul>"
        return f"<{tag}{named(MENU_NAMES, 0.6 if tag == 'nav' else 1)}>{inner}</{tag}>"

    def advert() -> str:
        tag = r.choice(("div", "div", "aside", "section", "p"))
        inner = r.choice((words(2, 30), f"<p>{words(2, 30)}</p>", f'<a href="/">{words(2, 8)}</a>'))
        return f'<{tag}{named(ADVERT_NAMES, 1)} data-y="0">{words(2, 30) if tag == "p" else inner}</{tag}>'

    def notice() -> str:
        tag = r.choice(("div", "div", "section", "p", "dialog"))
        role = r.choice(("", "", ' role="dialog"', ' role="alert"'))
        return f'<{tag}{named(NOTICE_NAMES, 1)}{role} data-y="0">{words(3, 40)}</{tag}>'

    def form() -> str:
        return f'<form{named(FORM_NAMES, 0.7)} data-y="0"><p>{words(1, 8)}</p><label>{words(1, 3)}</label><input type="text"><div>{words(1, 4)}</div></form>'

    def header() -> str:
        tag = r.choice(("header", "header", "div"))
        inner = r.choice((f"<h1>{words(1, 5)}</h1>", f"<p>{words(1, 6)}</p>", f"<div>{words(1, 5)}</div>")) + (menu() if r.random() < 0.4 else "")
        return f"<{tag}{named(HEADER_NAMES, 0.5 if tag == 'header' else 1)}>{inner}</{tag}>"

    def footer() -> str:
        tag = r.choice(("footer", "footer", "footer", "div"))
        inner = r.choice((f"&copy; {words(2, 40)}", f"<p>{words(3, 40)}</p>", f"<ul>{links(2, 6)}</ul><p>{words(2, 12)}</p>", f"&copy; {words(1, 2)} &middot; {words(2, 30)}"))
        return f"<{tag}{named(FOOTER_NAMES, 0.5 if tag == 'footer' else 1)}>{inner}</{tag}>"

    def side() -> str:
        tag = r.choice(("aside", "aside", "div", "section"))
        inner = f"<h3>{words(1, 4)}</h3>" + r.choice((f"<ul>{links(2, 8)}</ul>", f"<p>{words(4, 40)}</p>"))
        return f'<{tag}{named(SIDE_NAMES, 0.5 if tag == "aside" else 1)} data-y="0">{inner}</{tag}>'

    def comments() -> str:
        tag = r.choice(("div", "section", "ol", "aside"))
        one = r.choice(("div", "li", "article")) if tag != "ol" else "li"
        each = "".join(f"<{one}{named(COMMENT_NAMES, 0.8)}><p>{words(2, 60)}</p></{one}>" for _ in range(r.randint(1, 5)))
        return f'<{tag}{named(COMMENT_NAMES, 1)} data-y="0"><h3>{words(1, 3)}</h3>{each}</{tag}>'

    def piece() -> str:
        kind = r.random()
        if kind < 0.68:
            return f"<p>{words(1, 120)}{r.choice(('', '', f' <a href=#>{words(1, 3)}</a> {words(0, 20)}'))}</p>"
        if kind < 0.78:
            return f"<p><b>{words(1, 20)}<br>"
        if kind < 0.88:
            return f"<h{(k := r.randint(2, 4))}>{words(1, 8)}</h{k}>"
        if kind < 0.9:
            return f"<ul>{links(2, 6)}</ul>"
        if kind < 0.93:
            return f"<ul>{''.join(f'<li>{words(2, 20)}</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if kind < 0.96:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.98:
            return f"<pre>{words(3, 20)}</pre>"
        return f"<table><tr><th>{words(1, 3)}</th><th>{words(1, 3)}</th></tr><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"

    def content() -> str:
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        title = f'<a href="/">{words(1, 12)}</a>' if r.random() < 0.2 else words(1, 12)
        inner = [f"<h1>{title}</h1>"] if r.random() < 0.85 else []
        inner += [piece() for _ in range(r.choice((1, 1, 2, 3, r.randint(4, 14), r.randint(4, 14))))]
        for extra, much in ((advert, 0.3), (notice, 0.1), (form, 0.1), (side, 0.15), (comments, 0.15), (lambda: menu().replace(">", ' data-y="0">', 1), 0.1)):
            if r.random() < much:
                inner.insert(r.randint(1, len(inner)), extra())
        if r.random() < 0.25:
            inner = [f"<div{named(CONTENT_NAMES, 0.7)}>", *inner, "</div>"]
        return f'<{tag}{named(CONTENT_NAMES, 0.3 if tag in ("article", "main") else 1)} data-y="1">{"".join(inner)}</{tag}>'

    def plain() -> str:
        """A page without names or elements of an article: text alone, or paragraphs or bare blocks, with few things around them."""
        kind = r.random()
        if kind < 0.25:
            return f'<html data-y="1">{words(1, 200)}'
        block = r.choice(("p", "div", "section"))
        body = "".join(f"<{block}>{words(3, 120)}</{block}>" for _ in range(r.randint(1, 8)))
        if kind < 0.5:
            return f'<html data-y="1"><head data-y="0"><title>{words(1, 8)}</title></head><body>{body}</body></html>'
        around = [menu() if r.random() < 0.5 else "", footer() if r.random() < 0.5 else "", advert() if r.random() < 0.3 else ""]
        wrapped = f'<{(tag := r.choice(("div", "section", "td", "center")))} data-y="1">{body}</{tag}>'
        return f"<html><head><title>{words(1, 8)}</title></head><body>{around[0]}{around[2]}{wrapped}{around[1]}</body></html>"

    pages = []
    for _ in range(n):
        if r.random() < 0.2:
            pages.append(plain())
            continue
        before = [f() for f, much in ((header, 0.5), (menu, 0.8), (notice, 0.25), (advert, 0.5), (form, 0.15), (side, 0.15)) if r.random() < much]
        after = [f() for f, much in ((comments, 0.4), (side, 0.4), (advert, 0.3), (form, 0.2), (notice, 0.15), (footer, 0.9)) if r.random() < much]
        middle = content()
        if r.random() < 0.3:
            before, after, middle = before, after[-1:], f"<div{named(['wrapper', 'container', 'page', 'layout', 'row'], 0.8)}>{middle}{''.join(after[:-1])}</div>"
        page = f"<html><head><title>{words(1, 12)}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"
        pages.append(page[: r.randint(2 * len(page) // 3, len(page))] if r.random() < 0.08 else page)
    return pages
