"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded top-down.

A page becomes a tree of elements. Each element is described by its own and its subtree's text (length, share of the page, share in
links, sentence marks, tags per character), the tokens of its attributes by group, its depth, its place among its siblings and
their statistics, and by what stands above it. Boosted trees give the log odds that an element belongs to the
article. Decoding keeps an element only below kept elements: every subtree is worth its own odds plus what its children are
worth, or nothing, so no choice contradicts one further up.

The trees are fitted on a hash-chosen sample of at most about ``SAMPLE_PAGES`` pages: their texts are set into page frames whose
parts are known (articles, menus, headers, footers, sidebars, notices, adverts, forms, comments), with usual, unusual
and no attribute tokens. The pages themselves are not labelled.

Text: character references are decoded, scripts, styles, comments and the head are no text, block elements end a block,
white space inside a block is one space, blocks are trimmed and joined by a line feed. Formulas, drawings and the fallback text of
media count as text. Null and empty pages give the empty text; a page cut off inside a tag loses that tag only, and a
quote that is never closed ends with its tag. Rows are independent, repeated ones too. Time is linear in the page, however many
tags are open.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granthi.llm.common import map_batches, steps

SAMPLE_PAGES = 300
SAMPLE_RUNS = 1 << 16
FRAMES = 900
PAGE_STEP = 4 << 20

BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select
    summary table tbody td tfoot th thead tr ul caption""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template title iframe".split())
RAW = frozenset("script style title textarea iframe xmp".split())
# An opening tag ends an open element of these names, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}


def _closing(name: str) -> tuple[frozenset[str], frozenset[str]]:
    """Elements that an opening tag ends, and those above which it ends none."""
    ends, limit = CLOSES.get(name, (set(), set()))
    if name in BLOCK:
        ends, limit = ends | {"p"}, limit | {"button", "td", "th", "table"}
    return frozenset(ends), frozenset(limit - ends)


ENDS = {name: _closing(name) for name in BLOCK | CLOSES.keys()}
KINDS = ("nav menu", "header hgroup", "footer", "aside", "form input button select option textarea label fieldset",
         "article main", "section div", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "a",
         "table tbody tr td th", "b i em strong span u s small sub sup code q mark time abbr cite")
TOKENS = {
    "advert": "ad ads advert adverts advertisement adsense adslot sponsor sponsored promo promotion banner dfp outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs toc skip",
    "side": "side sidebar aside widget widgets related recommended trending popular rail more links tags teaser",
    "foot": "foot footer copyright colophon legal bottom",
    "head": "head header masthead logo branding top hero",
    "notice": "notice cookie cookies consent gdpr popup modal overlay alert warning message toast paywall disclaimer",
    "form": "form search login signup register subscribe newsletter contact input password",
    "comment": "comment comments reply replies respond discussion disqus thread responses reviews",
    "share": "share sharing social follow twitter facebook author bio meta byline",
    "content": "content article post entry story text body main maintext page copy prose single",
}
GROUP = {token: i for i, words in enumerate(TOKENS.values()) for token in words.split()}
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(>|\Z)|</([a-zA-Z][^\s>]*)[^>]*(?:>|\Z)"
                    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label|data-[a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_GROUPS = len(TOKENS)


@dataclass
class Page:
    tag: list[str] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)  # bit per token group
    parent: list[int] = field(default_factory=list)  # smaller than the element: page order
    runs: list[tuple[int, str]] = field(default_factory=list)  # (element, text) or (-1, "") at a block's edge


def attribute_groups(raw: str) -> int:
    out = 0
    if raw and "=" in raw:
        for values in _NAMES.findall(raw):
            for part in _PARTS.findall(_CAMEL.sub(" ", "".join(values)).lower()):
                if part in GROUP:
                    out |= 1 << GROUP[part]
    return out


def parse(source: str | None) -> Page:
    """Elements in page order (a parent before its children) and the text runs between them."""
    page = Page(["#"], [0], [-1])
    open_at, silent = [0], 0
    places: dict[str, list[int]] = defaultdict(list)  # where in open_at the elements of a name are, ascending
    runs, at, size = page.runs, 0, len(source or "")

    def close(down_to: int) -> None:
        nonlocal silent
        while len(open_at) > down_to:
            gone = page.tag[open_at.pop()]
            places[gone].pop()
            silent -= gone in SILENT
            if gone in BLOCK:
                runs.append((-1, ""))

    def text(raw: str) -> None:
        if raw and not silent:
            runs.append((open_at[-1], html.unescape(raw) if "&" in raw else raw))

    while at < size:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at:m.start()])
        at = m.end()
        name = m.group(1)
        if name:
            if not m.group(3):
                break  # cut off inside the tag
            name = name.lower()
            if name in ENDS:
                ends, limit = ENDS[name]
                floor = max((places[tag][-1] for tag in limit if places.get(tag)), default=0)
                lowest = [own[k] for own in (places[tag] for tag in ends if places.get(tag)) if (k := bisect_right(own, floor)) < len(own)]
                if lowest:
                    close(min(lowest))
            page.tag.append(name)
            page.groups.append(attribute_groups(m.group(2)))
            page.parent.append(open_at[-1])
            if name in BLOCK:
                runs.append((-1, ""))
            elif name == "br" and not silent:
                runs.append((open_at[-1], " "))
            if name in VOID:
                continue
            places[name].append(len(open_at))
            open_at.append(len(page.tag) - 1)
            silent += name in SILENT
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                text(source[at: end.start() if end else size])
                at = end.end() if end else size
                close(len(open_at) - 1)
        elif m.group(4):
            name = m.group(4).lower()
            if places.get(name):
                close(places[name][-1])
    return page


def blocks(page: Page, kept: np.ndarray) -> str:
    out, now = [], []
    for node, run in page.runs:
        if node >= 0:
            if kept[node]:
                now.append(run)
        elif now:
            out.append(" ".join("".join(now).split()))
            now = []
    out.append(" ".join("".join(now).split()))
    return "\n".join(b for b in out if b)


@dataclass
class Forest:
    """Elements of several pages in one numbering, parents before children."""

    parent: np.ndarray
    depth: np.ndarray
    starts: np.ndarray  # first element of each page
    features: np.ndarray


def describe(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.tag) for p in pages])
    starts = np.cumsum(sizes) - sizes
    own_page = np.repeat(np.arange(len(pages)), sizes)
    n = int(sizes.sum())
    parent = np.concatenate([np.array(p.parent) for p in pages]) + starts[own_page]
    roots = np.concatenate([np.array(p.parent) for p in pages]) < 0
    parent[roots] = np.flatnonzero(roots)
    kind = np.array([KIND.get(t, len(KINDS)) for p in pages for t in p.tag])
    groups = np.array([g for p in pages for g in p.groups])
    # In page order a parent is before its children and a subtree is one stretch: masks go down, ends come up.
    ups, depths, last = parent.tolist(), [0] * n, list(range(1, n + 1))
    seen = (groups | (1 << (_GROUPS + kind))).tolist()
    for i, up in enumerate(ups):
        if up != i:
            depths[i] = depths[up] + 1
            seen[i] |= seen[up]
    for i in range(n - 1, -1, -1):
        if last[ups[i]] < last[i]:
            last[ups[i]] = last[i]
    depth, last = np.array(depths, np.int64), np.array(last, np.int64)
    masks = (np.array(seen, np.int64)[:, None] >> np.arange(_GROUPS + len(KINDS) + 1)) & 1
    path_bits, path = masks[:, :_GROUPS].astype(float), masks[:, _GROUPS:].astype(float)
    chars, marks, linked = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, p in enumerate(pages):
        for node, run in p.runs:
            if node >= 0:
                chars[starts[i] + node] += len(run)
                marks[starts[i] + node] += run.count(".") + run.count(",")
    tags, paragraphs = np.ones(n), (kind == KIND["p"]).astype(float)
    bits = ((groups[:, None] >> np.arange(_GROUPS)) & 1).astype(float)
    linked = np.where(path[:, KIND["a"]] > 0, chars, 0)
    sums = np.zeros((n + 1, 7))
    np.cumsum(np.column_stack([chars, marks, linked, tags, paragraphs, kind == KIND["h1"], bits[:, -1]]), axis=0, out=sums[1:])
    below = sums[last] - sums[:-1]  # whole numbers, exact
    total = np.maximum(below[starts[own_page], 0], 1)
    siblings = np.bincount(parent, minlength=n)[parent]
    order = np.arange(n) - parent
    sibling_chars = np.bincount(parent, below[:, 0], n)[parent] / np.maximum(siblings, 1)
    sibling_links = np.bincount(parent, below[:, 2], n)[parent]
    features = np.column_stack([
        np.log1p(chars), np.log1p(below[:, 0]), below[:, 0] / total, below[:, 2] / np.maximum(below[:, 0], 1),
        below[:, 1] / np.maximum(below[:, 0], 1), below[:, 3] / np.maximum(below[:, 0], 1), below[:, 4], below[:, 5] > 0,
        depth, siblings, order, (np.arange(n) - starts[own_page]) / sizes[own_page], np.log1p(sibling_chars),
        sibling_links / np.maximum(sibling_chars * siblings, 1), below[parent, 2] / np.maximum(below[parent, 0], 1),
        kind, path, path_bits, bits, below[:, 6] > 0,
    ]).astype(np.float32)
    return Forest(parent, depth, starts, features)


class BoostedTrees:
    """Logistic boosting of depth-limited trees on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, bin, leaf values
        self.bias = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = self.binned(x)
        share = float(np.average(y, weights=weight))
        self.bias = math.log(max(share, 1e-3) / max(1 - share, 1e-3))
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += tree[2][self._leaf(binned, tree)]

    def _grow(self, binned: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2 ** self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        node = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first, count = 2 ** level - 1, 2 ** level
            best = np.full(count, 1e-6)
            for f in range(binned.shape[1]):
                key = (node - first) * 256 + binned[:, f]
                g = np.bincount(key, slope, count * 256).reshape(count, 256).cumsum(axis=1)
                h = np.bincount(key, curve, count * 256).reshape(count, 256).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g ** 2 / (all_h + 1)
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best
                best = np.where(better, value, best)
                feature[first: first + count][better], cut[first: first + count][better] = f, at[better]
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        return feature, cut, self.rate * g / (h + 1)

    def _leaf(self, binned: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, _ = tree
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return node - len(feature)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.binned(x), np.full(len(x), self.bias)
        for tree in self.trees:
            out += tree[2][self._leaf(binned, tree)]
        return out


def decode(forest: Forest, odds: np.ndarray) -> np.ndarray:
    """Kept elements: the choice of best total odds in which every kept element's parent is kept."""
    worth, ups = odds.tolist(), forest.parent.tolist()
    for i in forest.starts.tolist():
        worth[i] = 1e9  # the page itself
    for i in range(len(ups) - 1, -1, -1):
        if worth[i] > 0 and ups[i] != i:
            worth[ups[i]] += worth[i]
    kept = [w > 0 for w in worth]
    for i, up in enumerate(ups):
        kept[i] = kept[i] and kept[up]
    return np.array(kept, bool)


def frames(texts: list[str], count: int, seed: int = 0) -> Iterator[str]:
    """Pages made of known parts: elements of the article are below a ``data-known``, others below a ``data-cut``."""
    g = np.random.default_rng(seed)
    words = [w for t in texts for w in t.split()] or ["word"]

    def some(low: int, high: int) -> str:
        at = int(g.integers(0, len(words)))
        return html.escape(" ".join(words[at: at + int(g.integers(low, high))]) or "word")

    def one(options: str) -> str:
        return str(g.choice(options.split()))

    def named(group: str | None) -> str:
        if group is None or g.random() < 0.25:
            return ""
        return f' {one("class id")}="{one(TOKENS[group])}{one("x -1 -box _wrap").replace("x", "")}"'

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="#">{some(1, 4)}</a></li>' for _ in range(g.integers(2, 9))) + "</ul>"

    def prose() -> str:
        return "".join(f"<p>{some(3, 40)}</p>" for _ in range(g.integers(1, 4)))

    def part(kind: str) -> str:
        if kind == "menu":
            return f"<nav>{links()}</nav>" if g.random() < 0.5 else f"<div{named('menu') or ' role=navigation'}>{links()}</div>"
        if kind == "head":
            return f"<header{named('head')}>{g.choice([links(), f'<a href=x>{some(1, 4)}</a>', f'<p>{some(1, 9)}</p>'])}</header>"
        if kind == "foot":
            return f"<footer{named('foot')}>&copy; {some(2, 25)} {links() if g.random() < 0.3 else ''}</footer>"
        if kind == "form":
            return f"<form{named('form')}><label>{some(1, 4)}</label><input><button>{some(1, 3)}</button></form>"
        if kind == "comment":
            inner = "".join(f'<div class="{one(TOKENS["comment"])}"><p>{some(3, 40)}</p></div>' for _ in range(g.integers(1, 5)))
            return f'<section class="{one(TOKENS["comment"])}">{inner}</section>'
        if kind == "side" and g.random() < 0.5:
            return f"<aside>{g.choice([links(), prose()])}</aside>"
        return f'<div class="{one(TOKENS[kind])}">{g.choice([some(3, 25), prose(), links()])}</div>'

    def article() -> str:
        out = f"<h1>{some(2, 9)}</h1>"
        for _ in range(g.integers(1, 9)):
            pick = g.random()
            if pick < 0.7:
                out += f"<p>{g.choice(['', '<b>'])}{some(1, 80)}{g.choice(['</p>', '<br>', ''])}"
            elif pick < 0.76:
                out += f"<h{g.integers(2, 4)}>{some(1, 8)}</h2>"
            elif pick < 0.82:
                out += "<ul>" + "".join(f"<li>{some(3, 25)}</li>" for _ in range(g.integers(2, 6))) + "</ul>"
            elif pick < 0.87:
                out += f"<blockquote>{some(5, 40)}</blockquote>"
            elif pick < 0.92:
                out += f"<p>{some(4, 30)} <a href=x>{some(1, 4)}</a> {some(4, 30)}</p>"
            elif pick < 0.95:
                out += f"<table><tr><td>{some(1, 6)}</td><td>{some(1, 6)}</td></tr></table>"
            else:
                out += f"<div>{some(4, 40)}</div>"
        return out

    def inset(kind: str) -> str:
        """A part inside the article, marked as not belonging to it."""
        return re.sub(r"^<(\w+)", r"<\1 data-cut", part(kind))

    for _ in range(count):
        body = article()
        if g.random() < 0.5:
            places = [m.start() for m in re.finditer(r"<(?:p|h2|h3|blockquote)>", body)]
            at = int(g.choice([*places, len(body)]))
            body = body[:at] + inset(str(g.choice(["advert", "comment", "share", "side", "form", "notice"]))) + body[at:]
        before = [inset(str(k)) for k in g.choice(["menu", "head", "advert", "notice", "form", "side"], g.integers(0, 4))]
        after = [inset(str(k)) for k in g.choice(["foot", "comment", "side", "advert", "share", "menu", "form"],
                                                 g.integers(0, 4))]
        frame = g.random()
        if frame < 0.15:  # no element of its own holds the article
            yield f"<html><body data-known>{''.join(before)}{body}{''.join(after)}</body></html>"
            continue
        if frame < 0.2:
            yield body.replace("<h1>", "<h1 data-known>").replace("<p>", "<p data-known>") if "data-cut" not in body \
                else f"<body data-known>{body}</body>"
            continue
        tag = one("article article main div section")
        name = "" if g.random() < 0.15 else named("content") if tag in ("article", "main") or g.random() < 0.4 else f' class="{one(TOKENS["content"])}"'
        inner = f"{''.join(before)}<{tag}{name} data-known>{body}</{tag}>{''.join(after)}"
        yield f"<html><body>{f'<div>{inner}</div>' if g.random() < 0.3 else inner}</body></html>"


def known_labels(source: str, page: Page) -> np.ndarray:
    """1 for elements of the article and those above it, 0 for the others, from the marks of a frame."""
    marks = [0, *(1 if "data-known" in m else 2 if "data-cut" in m else 0 for m in re.findall(r"<[a-z][^>]*>", source))]
    label = np.zeros(len(page.tag))
    for i, up in enumerate(page.parent):
        marks[i] = marks[i] or (marks[up] if up >= 0 else 0)
        if marks[i] == 1:
            label[i] = 1
            while up >= 0 and not label[up]:
                label[up] = 1
                up = page.parent[up]
    return label


def fit(texts: list[str], seed: int = 0) -> BoostedTrees:
    """Trees from frames filled with ``texts``."""
    pages, labels = [], []
    for source in frames(texts, FRAMES, seed):
        pages.append(parse(source))
        labels.append(known_labels(source, pages[-1]))
    forest = describe(pages)
    trees = BoostedTrees()
    y = np.concatenate(labels)
    trees.fit(forest.features, y, np.ones(len(y)))
    return trees


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    runs = [run for s in batch.column(0).to_pylist() for _, run in parse(s).runs if len(run) > 20]
    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string())], ["run"])


def sampled_runs(pages: DataFrame, key: tuple[str, ...], source: str) -> list[str]:
    """Text runs of about ``SAMPLE_PAGES`` pages, at most ``SAMPLE_RUNS``, in order of their hash.

    Pages are chosen by the hash of all columns and equal ones count once, so no id, null or repeated, brings many pages.
    """
    span = 1 << 30
    chosen = F.xxhash64(*[F.col(c).cast("string") for c in key], F.col(source))
    n = pages.agg(F.approx_count_distinct(chosen)).first()[0]
    sample = pages.filter(F.pmod(chosen, F.lit(span)) < F.lit(int(min(1.0, SAMPLE_PAGES / max(n, 1)) * span))) \
        .select(*key, source).distinct()
    return [r.run for r in map_batches(sample.select(source), "run string", _runs)
            .orderBy(F.xxhash64("run"), "run").limit(SAMPLE_RUNS).collect()]


def extract(pages: DataFrame, key: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """The columns ``key`` with text and n_chars. The trees (a few kilobytes) go to the workers once; map-only."""
    spark = pages.sparkSession
    texts = sampled_runs(pages, key, source)
    sent = spark.sparkContext.broadcast(fit(texts))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        raw = batch.column(batch.num_columns - 1).to_pylist()
        out: list[str] = []
        for a, b in steps([len(s or "") for s in raw], PAGE_STEP):
            parsed = [parse(s) for s in raw[a:b]]
            forest = describe(parsed)
            kept = decode(forest, trees.log_odds(forest.features))
            ends = [*forest.starts[1:], len(kept)]
            out += [blocks(p, kept[x:y]) for p, x, y in zip(parsed, forest.starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            [*batch.schema.names[:-1], "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in key), "text string, n_chars long"])
    return map_batches(pages.select(*key, F.col(source).alias("__html")), schema, step)
