"""Operator 5, HTML extraction: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into its block-level elements. Boosted trees score each one from subtree
density, attribute tokens, depth and sibling statistics. Decoding then chooses the labelling
of best total score in which every path from the root runs outside -> inside -> cut: nothing
inside a rejected element is kept, and no ancestor of a kept one is rejected.

The model is fitted on the driver on a sample with a fixed bound (``SAMPLE_PAGES`` pages of
least id hash, each of at most ``SAMPLE_BYTES``). Labels come from semantic elements; each
page's prose is also retold with neutral elements, other and meaningless attribute names, and with
sidebars, notices, comments, forms and footers around and inside of the article, so that the model
does not rest on element names alone. A node is labelled by its own text, so a foreign part of any
size inside an article is learnt as foreign.
Extraction is one Arrow pass over whole pages; the model (a fixed size) is broadcast.

Defined results: a null or empty page, and one without a main block, has an empty text; a
null id or URL is kept; repeated rows are extracted row by row; unclosed and stray tags follow
the usual implied ends; what follows an unclosed comment or script is not read; ties go to the
node's outside label; a very long page is parsed in one piece, in time and memory linear in its
length; extra columns are ignored. Page ids must be integers, or texts of such.
"""

from __future__ import annotations

import html as html_text
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from collinea.llm.boosting import BoostedTrees

SAMPLE_PAGES = 240
SAMPLE_BYTES = 200_000
#: pages whose nodes are scored together
SCORED_PAGES = 64
#: stands before main blocks of pages made for training; a code point for private use
MARK = "\ue000"

#: fixed values: elements that make blocks, elements without an end, raw or unread contents
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav aside header footer form fieldset details summary address center hr dialog menu".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template title textarea select option button iframe canvas audio video head".split())
RAW = frozenset("script style title textarea noscript iframe".split())
#: fixed values: an opening element closes an open one of these
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
KINDS = ("p", "h", "li", "list", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "other")
_KIND = {**{f"h{k}": "h" for k in range(1, 7)}, "ul": "list", "ol": "list", "menu": "nav", "td": "table", "tr": "table", "th": "table", "table": "table", "dialog": "aside"}
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: the rest of a tag; a quoted value after an equals sign may hold the end mark
_TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
#: elements inside which no paragraph, item or cell from outside is ended
_BARRIERS = frozenset("ul ol dl table td th div section article main".split())
_TOKEN = re.compile(r"[a-z]+")
#: ASCII only: str.lower makes two code points of U+0130, so places would no longer agree
_LOWER = {code: code + 32 for code in range(65, 91)}


@dataclass
class Page:
    """Block elements in document order, and the text blocks with their owners."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    tokens: list[list[str]] = field(default_factory=lambda: [[]])
    owner: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    """The page's blocks in one pass, linear in its length."""
    page = Page()
    stack = [0]
    opened: Counter[str] = Counter()  # open elements by name
    pieces: list[str] = []
    linked = anchors = at = 0
    n = len(source)
    lower = source.translate(_LOWER)
    missing: set[str] = set()  # marks that do not come again

    def find(mark: str, start: int) -> int:
        """Place of the next mark; each mark is looked for to the end in vain once only."""
        if mark in missing:
            return -1
        place = lower.find(mark, start)
        if place < 0:
            missing.add(mark)
        return place

    def flush() -> None:
        nonlocal linked
        text = " ".join(html_text.unescape("".join(pieces)).split())
        if text:
            page.owner.append(stack[-1])
            page.text.append(text)
            page.linked.append(min(linked, len(text)))
        pieces.clear()
        linked = 0

    def leave(k: int) -> None:
        opened.subtract(page.tag[x] for x in stack[k:])
        del stack[k:]

    while at < n:
        start = source.find("<", at)
        if start < 0:
            start = n
        if start > at:
            pieces.append(source[at:start])
            if anchors:
                linked += start - at
        if start == n:
            break
        if source.startswith("<!--", start):
            end = find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        found = _TAG.match(source, start)
        if not found:
            if source[start + 1 : start + 2] in ("!", "?", "/"):
                end = find(">", start)
                at = n if end < 0 else end + 1
            else:
                pieces.append("<")
                at = start + 1
            continue
        whole = None if ">" in missing else _TAG_END.match(source, found.end())
        if whole is None:
            missing.add(">")
        at = n if whole is None else whole.end()
        rest = source[found.end() : at - (whole is not None)]
        name, closing = found[2].lower(), bool(found[1])
        if name in UNREAD and not closing:
            if not rest.endswith("/"):
                if name == "head":
                    # an unclosed head ends where the body begins
                    ends = [x for x in (find("</head", at), find("<body", at)) if x >= 0]
                    at = min(ends) if ends else at
                else:
                    end = find(f"</{name}", at)
                    at = at if end < 0 and name not in RAW else n if end < 0 else end
            pieces.append(" ")
            continue
        if name == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        anchors = 0
        if closing:
            if opened[name] > 0:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if page.tag[stack[k]] == name))
            continue
        if name in ("html", "body"):
            continue
        ends_here = {"p", *CLOSES.get(name, ()), *(_HEADINGS if name in _HEADINGS else ())}
        if any(opened[x] > 0 for x in ends_here):  # a block ends an open paragraph, an item an open item
            for k in range(len(stack) - 1, 0, -1):
                tag = page.tag[stack[k]]
                if tag in ends_here:
                    leave(k)
                    break
                if tag in _BARRIERS:
                    break
        if name in EMPTY:
            continue
        page.parent.append(stack[-1])
        page.tag.append(name)
        page.tokens.append([t for m in _ATTRIBUTE.finditer(rest) for t in _TOKEN.findall((m[2] or m[3] or m[4] or "").lower())])
        stack.append(len(page.tag) - 1)
        opened[name] += 1
    flush()
    return page


FEATURES = [*KINDS, "depth", "children", "chars", "blocks", "link_share", "mean_block", "longest", "stops", "before", "after", "same_siblings", "sibling_chars", "place", "share_of_parent", "own_low", "own_high", "path_low", "path_high", "path_header", "path_foreign", "path_foot", "path_main", "main_elsewhere", "since_main_low"]


def page_features(page: Page, token_score: dict[str, float]) -> np.ndarray:
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.array([[len(t), 1, l, t.count(".") + t.count(",") + t.count("!") + t.count("?")] for t, l in zip(page.text, page.linked)], float).reshape(-1, 4)
    total, longest = np.zeros((n, 4)), np.zeros(n)
    owner = np.array(page.owner, np.int64)
    np.add.at(total, owner, own)
    np.maximum.at(longest, owner, own[:, 0])
    first_block = np.full(n, len(owner))
    np.minimum.at(first_block, owner, np.arange(len(owner)))
    depth, children, place = np.zeros(n), np.zeros(n), np.zeros(n)
    low, high, path_low, path_high, path_header, path_foreign, path_foot, path_main, since_main = (np.zeros(n) for _ in range(9))
    kinds = [_KIND.get(t, t if t in KINDS else "other") for t in page.tag]
    for k in range(1, n):
        p = page.parent[k]
        depth[k] = depth[p] + 1
        place[k] = children[p]
        children[p] += 1
        scores = [token_score.get(t, 0.0) for t in page.tokens[k]]
        low[k], high[k] = min(scores, default=0.0), max(scores, default=0.0)
        path_low[k], path_high[k] = min(path_low[p], low[k]), max(path_high[p], high[k])
        path_header[k] = path_header[p] or float(kinds[k] == "header")
        path_foreign[k] = path_foreign[p] or float(kinds[k] in ("nav", "aside", "form"))
        path_foot[k] = path_foot[p] or float(kinds[k] == "footer")
        path_main[k] = path_main[p] or float(kinds[k] in ("article", "main"))
        # names below the nearest article: its own may be any
        since_main[k] = 0.0 if kinds[k] in ("article", "main") else min(since_main[p], low[k])
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
        longest[parent[k]] = max(longest[parent[k]], longest[k])
        first_block[parent[k]] = min(first_block[parent[k]], first_block[k])
    chars, blocks, linked, stops = total.T
    before = np.concatenate([[0], np.cumsum(own[:, 0])])[np.minimum(first_block, len(owner))]
    whole = max(chars[0], 1.0)
    key = [(page.parent[k], page.tag[k]) for k in range(n)]
    count: dict[tuple[int, str], list[float]] = {}
    for k in range(n):
        found = count.setdefault(key[k], [0.0, 0.0])
        found[0] += 1
        found[1] += chars[k]
    same = np.array([count[x][0] for x in key])
    sibling = np.array([count[x][1] for x in key]) / same
    safe = np.maximum(chars, 1)
    kind = np.zeros((n, len(KINDS)))
    kind[np.arange(n), [KINDS.index(x) for x in kinds]] = 1
    rest = [depth, children, np.log1p(chars), np.log1p(blocks), linked / safe, np.log1p(chars / np.maximum(blocks, 1)), np.log1p(longest), 100 * stops / safe, before / whole, (whole - before - chars) / whole]
    rest += [same, np.log1p(sibling), place, chars / np.maximum(chars[np.maximum(parent, 0)], 1), low, high, path_low, path_high, path_header, path_foreign, path_foot, path_main, np.full(n, path_main.max()) * (1 - path_main), since_main]
    return np.concatenate([kind, np.stack(rest, 1)], 1)


def decode(page: Page, score: np.ndarray, switch: float = 0.5) -> list[int]:
    """The blocks whose owners are inside, under the best outside -> inside -> cut labelling."""
    n = len(page.tag)
    own = np.bincount(np.array(page.owner, np.int64), minlength=n) > 0
    value = np.clip(score, -6, 6) * (own + 0.25)
    # best total of a subtree if its node is outside, inside or cut
    best = np.zeros((n, 3))
    best[:, 1] = value
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        best[p, 0] += max(best[k, 0], best[k, 1] - switch)
        best[p, 1] += max(best[k, 1], best[k, 2] - switch)
    state = np.zeros(n, np.int64)
    state[0] = int(best[0, 1] - switch > best[0, 0])
    for k in range(1, n):
        above = state[page.parent[k]]
        if above == 0:
            state[k] = int(best[k, 1] - switch > best[k, 0])
        elif above == 1:
            state[k] = 1 if best[k, 1] >= best[k, 2] - switch else 2
        else:
            state[k] = 2
    return [k for k, owner in enumerate(page.owner) if state[owner] == 1]


@dataclass
class ExtractionModel:
    trees: BoostedTrees
    token_score: dict[str, float]

    def main_texts(self, sources: list[str]) -> list[str]:
        """The main text of each page; the pages' nodes are scored together."""
        pages = [parse(source) for source in sources]
        tables = [page_features(page, self.token_score) for page in pages]
        scores = np.split(self.trees.score(np.concatenate(tables)), np.cumsum([len(t) for t in tables])[:-1]) if tables else []
        return ["\n\n".join(page.text[k] for k in decode(page, score)) for page, score in zip(pages, scores)]


#: fixed values: usual attribute names of main and of other parts
MAIN_NAMES = "content article post entry story main body text maincontent postbody".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb topnav".split(),
    "ad": "ad ads advert advertisement sponsored promo banner".split(),
    "side": "sidebar side aside related widget rail trending".split(),
    "notice": "cookie notice consent alert popup modal gdpr newsletter subscribe".split(),
    "comment": "comments comment replies disqus discussion respond".split(),
    "head": "header masthead top branding site".split(),
    "foot": "footer foot bottom copyright legal colophon".split(),
    "form": "form search login signup contact".split(),
}
OTHER_TAGS = {"nav": "nav", "side": "aside", "head": "header", "foot": "footer", "form": "form"}


def retold(prose: list[str], rng: random.Random, mark: str = "") -> tuple[str, list[str]]:
    """A page with known parts: (html, its main blocks), from paragraphs of real pages.

    Every main block of the html begins with ``mark``.
    """
    pick = lambda: rng.choice(prose)
    short = lambda: " ".join(pick().split()[: rng.randint(1, 5)])
    title = " ".join(pick().split()[: rng.randint(1, 12)])
    body: list[str] = []
    meaningless = rng.random() < 0.3  # a page whose names say nothing

    def said(text: str) -> str:
        body.append(text)
        return mark + text

    def part(kind: str, inner: str, within: bool = False) -> str:
        """A foreign part; inside of an article it has an element or a name that says so."""
        name = rng.choice(OTHER_NAMES[kind])
        tag = OTHER_TAGS.get(kind, rng.choice(["div", "section"])) if rng.random() < 0.5 else "div"
        if meaningless and not (within and kind != "nav"):
            name = "".join(rng.choice("abcdefghijkqxz") for _ in range(rng.randint(1, 3))) + str(rng.randint(0, 99))
        named = f' {rng.choice(["class", "id"])}="{name}{rng.choice(["", "-box", " block", "_1", "-list", " widget", "-footer"])}"' if rng.random() < (0.4 if tag in OTHER_TAGS.values() else 1.0 if within else 0.85) else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"
    prose_part = lambda: "".join(f"<p>{' '.join(pick().split()[: rng.randint(3, 60)])}</p>" for _ in range(rng.randint(1, 4)))
    before = [x for x, p in ((part("head", f"<h2>{short()}</h2>{links() if rng.random() < 0.4 else ''}"), 0.4), (part("nav", links()), 0.8), (part("ad", short() + " " + short()), 0.5), (part("notice", f"<p>{pick()[:160]}</p>"), 0.4)) if rng.random() < p]
    after = [
        x
        for x, p in ((part("side", f"<h3>{short()}</h3>" + rng.choice([links, prose_part])()), 0.5), (part("comment", f"<h3>{short()}</h3>" + prose_part()), 0.5), (part("form", f"<p>{short()}</p><label>{short()}</label><input>"), 0.4), (part("ad", f"<p>{pick()[:120]}</p>"), 0.3), (part("foot", f"<p>&copy; {short()} &middot; {pick()[:100]}</p>"), 0.8))
        if rng.random() < p
    ]
    rng.shuffle(before)
    heading = f"<h1>{said(title)}</h1>"
    roll = rng.random()
    inner = [f"<header>{heading}</header>" if roll < 0.15 else f"<header>{heading}<p>{said(short())}</p></header>" if roll < 0.25 else heading]

    def main_part() -> str:
        roll = rng.random()
        long = lambda: " ".join(pick().split()[: rng.randint(2, 400)])
        if roll < 0.04:
            return f"<h{rng.randint(2, 4)}>{said(short())}</h{rng.randint(2, 4)}>"
        if roll < 0.1:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{said(rng.choice([short, short, long])())}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        if roll < 0.15:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{said(short())}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if roll < 0.19:
            return f'<p><a href="/y">{said(rng.choice([short, long])())}</a></p>'
        if roll < 0.23:
            return f"<figure><figcaption>{said(short())}</figcaption></figure>"
        if roll < 0.3:
            tag = rng.choice(["blockquote", "pre", "div"])
            return f"<{tag}>{said(long())}</{tag}>"
        return f"<p>{said(short() if roll < 0.36 else long())}</p>"

    for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
        inner.append(main_part())
    replies = lambda: "".join(f"<p>{' '.join(pick().split()[: rng.randint(1, 25)])}</p>" for _ in range(rng.randint(1, 10)))
    inserts = {
        "ad": lambda: rng.choice([short, prose_part])(),
        "side": lambda: f"<h3>{short()}</h3>" * (rng.random() < 0.7) + rng.choice([links, prose_part, prose_part])(),
        "comment": lambda: f"<h3>{short()}</h3>" * (rng.random() < 0.8) + (replies() if rng.random() < 0.6 else "<ol>" + "".join(f"<li>{replies()}</li>" for _ in range(rng.randint(1, 4))) + "</ol>"),
        "nav": links,
        "form": lambda: f"<p>{short()}</p><label>{short()}</label><input>",
        "notice": lambda: prose_part(),
        "foot": lambda: f"<p>{short()}</p>" + (links() if rng.random() < 0.4 else ""),
    }
    for kind, make in inserts.items():
        for _ in range(2 if kind == "side" else 1):
            if rng.random() < 0.22:
                at = len(inner) if kind in ("comment", "foot") else rng.randint(0 if kind == "notice" else 1, len(inner))
                inner.insert(at, part(kind, make(), True))
    if rng.random() < 0.2:  # parts of the article in sections of their own
        cut = rng.randint(1, len(inner))
        inner = [*inner[:1], "<section>", *inner[1:cut], "</section>", "<section>", *inner[cut:], "</section>"]
    any_name = lambda: rng.choice([*MAIN_NAMES, *(x for names in OTHER_NAMES.values() for x in names)])
    own_name = f' class="{any_name()}{rng.choice(["", "-story", " post"])}"' if rng.random() < 0.35 else ""
    form = rng.random() * (1 - 0.25 * meaningless) + 0.25 * meaningless
    if form < 0.35:
        main = f"<article{own_name}>{''.join(inner)}</article>"
    elif form < 0.5:
        main = f"<main{own_name}>{''.join(inner)}</main>"
    else:
        name = f' {rng.choice(["class", "id"])}="{rng.choice(["b", "k", "zq"]) + str(rng.randint(0, 99)) if meaningless else rng.choice(MAIN_NAMES)}{rng.choice(["", "-area", " wrap"])}"' if rng.random() < 0.8 else ""
        main = f"<{(tag := rng.choice(['div', 'section']))}{name}>{''.join(inner)}</{tag}>"
    if rng.random() < 0.3:
        main = f'<div class="container">{main}{after.pop(0) if after and rng.random() < 0.5 else ""}</div>'
    return f"<html><body>{''.join(before)}{main}{''.join(after)}</body></html>", body


def _known_labels(page: Page) -> np.ndarray | None:
    """Labels from semantic elements; None for a page that has no article or main element."""
    inside, out = np.zeros(len(page.tag), bool), np.zeros(len(page.tag), bool)
    other = {name for names in OTHER_NAMES.values() for name in names} - {"header", "top", "site", "bottom", "form"}
    for k in range(1, len(page.tag)):
        p = page.parent[k]
        named = any(t in other for t in page.tokens[k]) and (page.tag[k] not in ("article", "main") or inside[p])
        out[k] = out[p] or page.tag[k] in ("nav", "aside", "footer", "form", "dialog") or named
        inside[k] = (inside[p] or page.tag[k] in ("article", "main")) and not out[k]
    return inside if inside.any() else None


def _marked_labels(page: Page) -> np.ndarray:
    """Labels of a retold page, whose marks are taken away.

    A node with text of its own is main if most of that text is; any other one if most of its subtree's is.
    """
    own, total = np.zeros((len(page.tag), 2)), np.zeros((len(page.tag), 2))
    for k, (owner, text) in enumerate(zip(page.owner, page.text)):
        page.text[k] = text.replace(MARK, "").strip() or "x"
        own[owner] += [len(page.text[k]), len(page.text[k]) * (MARK in text)]
    total += own
    for k in range(len(page.tag) - 1, 0, -1):
        total[page.parent[k]] += total[k]
    decisive = np.where(own[:, :1] > 0, own, total)
    return decisive[:, 1] > 0.5 * np.maximum(decisive[:, 0], 1)


def fit_model(sources: list[str], retellings: int = 2000, seed: int = 7) -> ExtractionModel:
    """Fit on a bounded list of pages; the same pages give the same model."""
    rng = random.Random(seed)
    pages: list[tuple[Page, np.ndarray]] = []
    prose: list[str] = []
    for source in sources:
        page = parse(source)
        labels = _known_labels(page)
        if labels is not None:
            pages.append((page, labels))
        prose += [html_text.escape(t, quote=False) for k, t in enumerate(page.text) if len(t) >= 40 and not page.linked[k]][:20]
    if len(prose) < 20:
        prose += [" ".join(f"word{rng.randint(0, 999)}" for _ in range(60)) + "." for _ in range(40)]
    for _ in range(retellings):
        source, _ = retold(prose, rng, MARK)
        if rng.random() < 0.15:  # a page that breaks off
            source = source[: rng.randint(len(source) // 3, len(source))]
        page = parse(source)
        if MARK in "".join(page.text):
            pages.append((page, _marked_labels(page)))
    held: dict[str, list[int]] = {}
    for page, labels in pages:
        for k in range(1, len(page.tag)):
            for token in set(page.tokens[k]):
                held.setdefault(token, [0, 0])[int(labels[k])] += 1
    token_score = {token: float(np.log((good + 0.5) / (bad + 0.5))) for token, (bad, good) in sorted(held.items()) if good + bad >= 5}
    x = np.concatenate([page_features(page, token_score)[1:] for page, _ in pages])
    y = np.concatenate([labels[1:] for _, labels in pages]).astype(float)
    return ExtractionModel(BoostedTrees(trees=60, depth=5).fit(x, y), token_score)


def fit_on(pages: DataFrame) -> ExtractionModel:
    """Fit on at most ``SAMPLE_PAGES`` pages of at most ``SAMPLE_BYTES`` each."""
    sample = pages.filter(F.octet_length("html").between(1, SAMPLE_BYTES)).select(F.xxhash64("page_id", "url").alias("k"), "html").orderBy("k", "html").limit(SAMPLE_PAGES)
    return fit_model([row.html for row in sample.select("html").collect()])


def extract(pages: DataFrame, model: ExtractionModel) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo in range(0, len(batch), SCORED_PAGES):
                part = batch.slice(lo, SCORED_PAGES)
                texts = model.main_texts([x or "" for x in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
