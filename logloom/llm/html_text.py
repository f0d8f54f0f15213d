"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded along the tree.

A page is tokenised and built into a tree of its block elements (inline elements belong to the block around them;
omitted end tags of paragraphs, list items, table cells and the like are implied; scripts, styles, comments, head
and other unseen content never enter the tree). Features of a block: its tag and attribute tokens and those of its
ancestors, depth, text and link density of its subtree, tags per text, position among its siblings and what they
are. Text that stands bare in the body makes blocks of its own, one for each run between others, so it is judged like
any block. A boosted ensemble of small trees gives the log-odds that the block holds article text; the decoding takes
the most likely labelling in which nothing is kept inside something dropped, by one pass up and one down the tree.

The ensemble is fitted here, once per driver, on pages that ``sample_pages`` writes from a fixed seed: layouts with
menus, banners, notices, adverts, sidebars, forms and reader comments under many names, around articles.

Edge cases: null and empty pages give an empty text; broken markup (unclosed or stray tags, a cut end) is built as
far as it goes; pages that repeat are extracted each; an empty table gives no rows. Extra columns of the input pass
through unless they are named ``text``.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
#: One attribute: its whole name and its value, quoted or not.
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]++))?+""")
READ = set("class id role itemprop hidden style aria-hidden aria-label".split())
DISPLAY = re.compile(r"(?:\A|;)\s*display\s*:\s*([a-z-]+)")
#: Element names by how they are read.
UNSEEN = set("script style noscript template svg math iframe object canvas audio video select textarea title".split())
#: Of these, what has to be text up to the end tag; without one it is the rest of the page. Others are passed over.
RAW = set("script style textarea title".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: End tags, sought in the source itself: lower-casing may change the length of a text.
CLOSING = {name: re.compile(f"</{name}(?![a-z0-9])", re.I | re.A) for name in UNSEEN}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
#: Tag of a run of text that stands in the body itself.
BARE = "#text"
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl", "dd", BARE,
        "nav", "header", "footer", "aside", "form", "dialog", "body", "button", "address", "fieldset", "details", "hgroup"]
#: Words of class, id and role attributes by what they hint at.
HINTS = {
    "good": "article content post entry story main body text articlebody prose blog page".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination tabs skip sitemap toolbar topbar".split(),
    "head": "header masthead banner branding logo hero".split(),
    "foot": "footer copyright colophon legal bottom foot".split(),
    "side": "sidebar aside related widget rail recommended recommendations trending popular teaser archive tags complementary secondary more".split(),
    "note": "cookie cookies consent notice popup modal overlay gdpr alert toast notification paywall disclaimer dialog announcement".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense dfp outbrain taboola affiliate".split(),
    "talk": "comment comments reply replies disqus discussion respond commentlist feedback review reviews".split(),
    "share": "share sharing social follow byline author meta twitter facebook".split(),
    "form": "form search login signup newsletter subscribe subscription register".split(),
}
KIND = {w: i for i, words in enumerate(HINTS.values()) for w in words}
SPLIT = re.compile(r"[^a-z]+")


class Page:
    """Blocks of a page in document order: parent, tag, hints, and its own pieces of text between inner blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.hint, self.links, self.tags, self.hidden = ["body"], [-1], [0], [0], [0], [False]
        self.pieces: list[tuple[int, str]] = []  # (block, text), in page order
        stack, buffer, at, end, inline_links, in_head = [0], [], 0, len(source), 0, False
        places: dict[str, list[int]] = {}  # of the open elements, by name
        endless: set[str] = set()  # names without an end tag in what follows

        def flush() -> None:
            if buffer:
                words = "".join(buffer).split()
                buffer.clear()
                if words:
                    self.pieces.append((stack[-1] or self._add(BARE, 0, 0, False, self.links[0], self.tags[0]), " ".join(words)))
                if not stack[-1]:
                    self.links[0] = self.tags[0] = 0

        def say(raw: str) -> None:
            if raw and not in_head:
                text = html.unescape(raw) if "&" in raw else raw
                buffer.append(text)
                if inline_links:
                    self.links[stack[-1]] += len(text.strip())

        def pop_to(names: set[str], stops: set[str]) -> None:
            last = lambda some: max((places[n][-1] for n in some if places.get(n)), default=0)
            k = last(names)
            if k > last(stops):
                flush()
                for b in stack[k:]:
                    places[self.tag[b]].pop()
                del stack[k:]
        while at < end:
            m = MARKUP.search(source, at)
            if m is None:
                say(source[at:])
                break
            if m.start() > at:
                say(source[at:m.start()])
            at = m.end()
            name = m[2].lower() if m[2] else ""
            if not name:
                continue
            if name == "head":
                in_head = not m[1]
            elif m[1]:
                if name == "a":
                    inline_links = max(0, inline_links - 1)
                elif name == "p" or name not in INLINE and name not in ("html", "body"):
                    pop_to({name}, set())
            elif name in UNSEEN:
                if name not in endless and (not m[3].rstrip().endswith("/") or name in RAW):
                    close = CLOSING[name].search(source, at)
                    if close:
                        at = source.find(">", close.start()) + 1 or end
                    elif name in RAW:
                        at = end
                    else:
                        endless.add(name)
            elif name == "br" or name == "img":
                buffer.append(" ")
                self.tags[stack[-1]] += 1
            elif name in INLINE:
                self.tags[stack[-1]] += 1
                inline_links += name == "a"
            elif name == "hr":
                flush()
            elif name not in VOID and name != "html":
                in_head = False
                if name == "body":
                    self.hint[0] |= self._hint(m[3])[0]
                    continue
                flush()
                inline_links = 0
                pop_to({"p"}, {"td", "th", "li", "div", "section", "article", "aside", "table"})
                if name in CLOSES:
                    pop_to(CLOSES[name], STOPS[name])
                hint, hidden = self._hint(m[3])
                places.setdefault(name, []).append(len(stack))
                stack.append(self._add(name, stack[-1], hint, hidden, 0, 1))
        flush()

    def _add(self, tag: str, parent: int, hint: int, hidden: bool, links: int, tags: int) -> int:
        for own, value in ((self.tag, tag), (self.parent, parent), (self.hint, hint), (self.hidden, hidden), (self.links, links), (self.tags, tags)):
            own.append(value)
        return len(self.tag) - 1

    @staticmethod
    def _hint(attributes: str) -> tuple[int, bool]:
        bits, hidden = 0, False
        if attributes and not attributes.isspace():
            for a in ATTRIBUTE.finditer(attributes):
                key, value = a[1].lower(), (a[2] or "").strip("\"'").lower()
                if key not in READ:
                    continue
                if key == "hidden" or key == "style" and DISPLAY.findall(value)[-1:] == ["none"]:
                    hidden = True
                for w in SPLIT.split(value) if key not in ("style", "hidden", "aria-hidden") else ():
                    if w in KIND:
                        bits |= 1 << KIND[w]
        return bits, hidden

    def features(self) -> np.ndarray:
        n, k = len(self.tag), len(HINTS)
        own = np.zeros(n)
        stops = np.zeros(n)
        for b, text in self.pieces:
            own[b] += len(text)
            stops[b] += text.count(".") + text.count(",")
        parent = np.array(self.parent)
        size, links, tags, marks = own.copy(), np.array(self.links, float), np.array(self.tags, float), stops
        paragraphs = np.array([t == "p" for t in self.tag], float)
        below = np.zeros(n)
        for i in range(n - 1, 0, -1):
            j = parent[i]
            size[j] += size[i]
            links[j] += links[i]
            tags[j] += tags[i]
            marks[j] += marks[i]
            below[j] += below[i] + 1
            paragraphs[j] += paragraphs[i]
        depth, above, place = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        semantic = [{"nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 9, "dialog": 5}.get(t, 0) for t in self.tag]
        whole = [h | (1 << s if s else 0) for h, s in zip(self.hint, semantic)]
        whole = [w | (1 if t in ("article", "main") else 0) for w, t in zip(whole, self.tag)]
        children = np.zeros(n)
        for i in range(1, n):
            j = parent[i]
            depth[i] = depth[j] + 1
            above[i] = above[j] | whole[j]
            place[i] = children[j]
            children[j] += 1
        siblings = np.where(parent >= 0, children[np.maximum(parent, 0)], 1)
        p_near = np.array([paragraphs[j] if j >= 0 else 0 for j in parent])
        code = np.array([TAGS.index(t) if t in TAGS else len(TAGS) for t in self.tag])
        total = max(1.0, size[0])
        bits = 1 << np.arange(k)
        here = (np.array(whole)[:, None] & bits > 0).astype(float)
        over = (above[:, None] & bits > 0).astype(float)
        x = [np.log1p(size), np.log1p(own), links / np.maximum(1, size), tags / np.maximum(10, size) * 10, marks / np.maximum(10, size) * 10, depth,
             place / np.maximum(1, siblings), siblings, np.log1p(below), np.log1p(paragraphs), np.log1p(p_near), size / total, np.array(self.hidden, float)]
        names = np.zeros((n, len(TAGS) + 1))
        names[np.arange(n), code] = 1
        return np.concatenate((np.array(x).T, names, here, over), axis=1).astype(np.float32)

    def text(self, odds: np.ndarray) -> str:
        """Pieces of the blocks kept by the most likely labelling that keeps nothing below something dropped."""
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        drop, keep = no.copy(), yes.copy()
        for i in range(n - 1, 0, -1):
            j = self.parent[i]
            drop[j] += drop[i]
            keep[j] += max(keep[i], drop[i])
        kept = [True] * n
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] >= drop[i] and not self.hidden[i]
        return "\n".join(t for b, t in self.pieces if kept[b])


def sample_pages(count: int = 900, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """Pages with a 0 or 1 for each of their blocks after the body, in page order."""
    rng = random.Random(seed)
    syllables = "ka lo mi ter an ish pro den vo ra sel un ti mor ge".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(lo: int, hi: int) -> str:
        n = max(lo, min(hi, int(math.exp(rng.uniform(math.log(lo), math.log(hi))))))
        return " ".join(word() + rng.choice(["", "", "", "", ",", ".", " &amp;", "!!", "***"]) for _ in range(n)) + "."
    names = {g: ws for g, ws in HINTS.items()}

    def neutral() -> str:
        return rng.choice(["", "", ' class="x1 y2"', ' id="b7"', ' class="wrap"', ' class="col row"'])

    def attribute(group: str | None) -> str:
        if group is None or rng.random() < 0.25:
            return neutral()
        w = rng.choice(names[group])
        return rng.choice([f' class="{w}"', f' id="{w}"', f' class="{w}-box inner"', f" class='site_{w}'", f' role="{w}" class="{w}"', f" class={w}"])

    for _ in range(count):
        labels: list[int] = []

        def el(tag: str, y: int, inner, attr: str = "", close: bool = True) -> str:
            labels.append(y)
            return f"<{tag}{attr}>" + (inner() if callable(inner) else inner) + (f"</{tag}>" if close else "")

        def items(tag: str, lo: int, hi: int, body) -> str:
            return "".join(el(tag, 0, body) for _ in range(rng.randint(lo, hi)))
        link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'

        def menu() -> str:
            return el(rng.choice(["nav", "nav", "div", "ul"]), 0, lambda: (el("ul", 0, lambda: items("li", 2, 8, link)) if rng.random() < 0.7 else " ".join(link() for _ in range(rng.randint(2, 6)))), attribute("menu"))

        def plain(tags: list[str], group: str, hi: int) -> str:
            return el(rng.choice(tags), 0, lambda: rng.choice([
                lambda: words(2, hi), lambda: el("p", 0, words(2, hi)), lambda: el("h3", 0, words(1, 4)) + el("p", 0, words(2, hi)) + link(),
                lambda: words(1, 6) + " " + link(), lambda: el("h2", 0, words(1, 3)) + el("ul", 0, lambda: items("li", 2, 6, link))])(), attribute(group) if tags[0] in ("div", "p") else rng.choice(["", attribute(group)]))

        def sure(group: str, hi: int) -> str:
            """A block that only its attributes give away."""
            w = rng.choice(names[group])
            return el(rng.choice(["div", "div", "section", "p"]), 0, lambda: words(2, hi), f' class="{w}"')

        def comments() -> str:
            return el(rng.choice(["div", "section"]), 0, lambda: el("h3", 0, words(1, 3)) + items(rng.choice(["div", "li", "article"]), 1, 5, lambda: el("p", 0, words(3, 60))),
                      f' {rng.choice(["class", "id"])}="{rng.choice(names["talk"])}"')

        def form() -> str:
            return el("form", 0, lambda: "<label>" + words(1, 3) + "</label><input name=q>" + el("button", 0, words(1, 2)), attribute("form"))
        noise = [menu, lambda: plain(["aside", "div"], "side", 30), lambda: sure("ad", 40), lambda: sure("note", 40), lambda: sure("side", 40), comments, form, lambda: sure("share", 10), lambda: plain(["aside"], "ad", 40)]

        def article() -> str:
            parts = []
            if rng.random() < 0.8:
                parts.append(lambda: el(rng.choice(["h1", "h1", "h2"]), 1, words(1, 14)))
            elif rng.random() < 0.5:
                parts.append(lambda: el("header", 1, lambda: el("h1", 1, words(1, 14))))
            for _ in range(rng.randint(0 if rng.random() < 0.1 else 1, 12)):
                parts.append(rng.choices([
                    lambda: el("p", 1, words(1, 150)), lambda: el("p", 1, "<b>" + words(2, 60) + "<br>", close=False), lambda: el("p", 1, words(3, 40) + f" <a href='#'>{words(1, 3)}</a> " + words(1, 30)),
                    lambda: el("h2", 1, words(1, 8)), lambda: el(rng.choice(["ul", "ol"]), 1, lambda: "".join(el("li", 1, words(1, 25)) for _ in range(rng.randint(1, 6)))),
                    lambda: el("blockquote", 1, lambda: el("p", 1, words(3, 50))), lambda: el("pre", 1, words(3, 40)),
                    lambda: el("table", 1, lambda: "".join(el("tr", 1, lambda: el("td", 1, words(1, 4)) + el("td", 1, words(1, 4))) for _ in range(3))),
                    lambda: el("div", 1, words(5, 90)), lambda: el("figure", 1, lambda: "<img src=a.png>" + el("figcaption", 1, words(2, 12))), lambda: rng.choice(noise)()],
                    [14, 4, 4, 3, 2, 1, 1, 1, 1, 1, 1.2])[0])
            if rng.random() < 0.15:  # a part of the article whose name would fit something else, too
                own = f"{rng.choice(names[rng.choice(['talk', 'side', 'foot', 'head', 'note'])])}-{rng.choice(['body', 'section', 'text', 'content'])}"
                parts.append(lambda: el(rng.choice(["div", "section"]), 1, lambda: "".join(el("p", 1, words(15, 150)) for _ in range(rng.randint(1, 4))), f' class="{own}"'))
            body = lambda: "".join(p() for p in parts) or words(1, 60)
            style = rng.random()
            if style < 0.4:
                return el("article", 1, body, rng.choice(["", "", attribute("good")]))
            if style < 0.55:
                return el("main", 1, lambda: el("article", 1, body) if rng.random() < 0.5 else body(), rng.choice(["", attribute("good")]))
            if style < 0.7:
                return el(rng.choice(["div", "section"]), 1, body, f' class="{rng.choice(names["good"])}"')
            # Nothing but the text tells: paragraphs in an element without a name, or in none.
            parts = parts + [lambda: el("p", 1, words(10, 150)) for _ in range(rng.randint(1, 4))]
            if style < 0.85:
                return el(rng.choice(["div", "div", "section", "td"]), 1, body, neutral())
            return body()
        def bare(y: int, lo: int, hi: int) -> str:
            labels.append(y)
            return words(lo, hi)

        def loose() -> str:
            """An article without an element of its own: runs of bare text between blocks."""
            out = el(rng.choice(["h1", "h2"]), 1, words(1, 12))
            for _ in range(rng.randint(1, 5)):
                out += bare(1, 12, 160) + el(rng.choice(["p", "p", "h2", "blockquote", "ul"]), 1, words(2, 90))
            return out + (bare(1, 8, 120) if rng.random() < 0.8 else "")
        layout = [rng.choice([menu, lambda: el("header", 0, lambda: words(1, 5) + (menu() if rng.random() < 0.5 else ""), rng.choice(["", attribute("head")]))]) for _ in range(rng.randint(0, 2))]
        layout += [rng.choice(noise) for _ in range(rng.randint(0, 3))] + ([article] if rng.random() < 0.97 else []) + [rng.choice(noise) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.8:
            layout.append(lambda: plain(["footer", "footer", "div"], "foot", 25) if rng.random() < 0.5 else el("footer", 0, "&copy; " + words(1, 12)))
        wrap = rng.random() < 0.35
        if not wrap and rng.random() < 0.45:  # short runs of bare text between the blocks; two blocks never touch a run
            if article in layout and rng.random() < 0.6:
                layout[layout.index(article)] = loose
            spots = [i for i in range(len(layout) + 1) if not any(f is loose for f in layout[max(0, i - 1):i + 1])]
            for i in sorted(rng.sample(spots, min(len(spots), rng.randint(1, 2))), reverse=True):
                layout.insert(i, lambda: bare(0, 1, 9) if rng.random() < 0.6 else bare(0, 1, 4) + f' <a href="/{word()}">{words(1, 3)}</a>')
        inner = lambda: "".join(f() for f in layout)
        body = el("div", int(article in layout or loose in layout), inner, attribute(None)) if wrap else inner()
        yield f"<html><head><title>{words(1, 6)}</title></head><body>{body}</body></html>", labels


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 16) -> tuple[float, list]:
    """Base log-odds and trees; a tree is (features, thresholds, leaf values) of a full binary tree."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    flat = codes + np.arange(x.shape[1]) * (bins + 1)
    base = math.log(y.mean() / (1 - y.mean()))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        width = x.shape[1] * (bins + 1)
        for level in range(depth):
            n = 1 << level
            spot = (node[:, None] * width + flat).ravel()
            sums = [np.bincount(spot, np.repeat(v, x.shape[1]), n * width).reshape(n, x.shape[1], bins + 1).cumsum(2) for v in (g, h)]
            lg, lh = sums[0][:, :, :-1], sums[1][:, :, :-1]
            rg, rh = sums[0][:, :, -1:] - lg, sums[1][:, :, -1:] - lh
            gain = np.where((lh > 1) & (rh > 1), lg * lg / (lh + 1) + rg * rg / (rh + 1) - (lg + rg) ** 2 / (lh + rh + 1), 0)
            best = gain.reshape(n, -1).argmax(1)
            for k in range(n):
                f, b = divmod(int(best[k]), bins)
                if gain[k].max() > 1e-6 and b < len(cuts[f]):
                    feature[n - 1 + k], limit[n - 1 + k] = f, cuts[f][b]
            at = n - 1 + node
            node = node * 2 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
        score += leaf[node]
        trees.append((feature, limit, leaf))
    return base, trees


def log_odds(x: np.ndarray, model: tuple[float, list]) -> np.ndarray:
    base, trees = model
    out, rows = np.full(len(x), base), np.arange(len(x))
    for feature, limit, leaf in trees:
        node = np.zeros(len(x), np.int64)
        while node[0:1].size and node[0] < len(feature):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        out += leaf[node - len(feature)] if len(x) else 0
    return out


@cache
def model() -> tuple[float, list]:
    x, y = [], []
    for source, labels in sample_pages():
        page = Page(source)
        if len(page.tag) == len(labels) + 1:
            x.append(page.features()[1:])
            y += labels
    return boost(np.concatenate(x), np.array(y, float))


def extract_texts(sources: list[str | None], fitted: tuple[float, list]) -> list[str]:
    pages = [Page(s) if s else None for s in sources]
    rows = [p.features() for p in pages if p]
    odds = log_odds(np.concatenate(rows), fitted) if rows else np.empty(0)
    out, at = [], 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        own = odds[at:at + len(p.tag)].copy()
        at += len(p.tag)
        own[0] = 50.0  # the body itself is never dropped
        out.append(p.text(own))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """The pages without ``html``, with the main ``text``."""
    fitted = model()

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for i in range(0, len(batch), 64):
                out += extract_texts(batch.slice(i, 64).to_pylist(), fitted)
            yield pa.array(out, pa.string())
    said = F.arrow_udf(work, "string")(F.col("html").cast("string"))
    return pages.select(*(c for c in pages.columns if c not in ("text", "html")), said.alias("text"))
