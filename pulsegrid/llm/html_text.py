"""Main text of web pages by minimum cut.

A tolerant tokenizer turns a page into text blocks: what stands between tags that start or end a block. Each block
gets a cost of calling it boilerplate and a cost of calling it content; these are the capacities of its edges from the
source and to the sink. Neighbours in page order, and blocks near each other in the element tree, are joined by
smoothness edges, so that a doubtful block goes with what surrounds it. The minimum cut, found by maximum flow, is the
labelling of least cost; what stays on the source's side is the text.

Costs come from the elements around a block (article against nav, aside, footer, form, class names of adverts, notices
and comments ...), as fixed weights, and from its shape (length, share of link text, punctuation, tag), as a naive
Bayes model. The model is trained on at most ``TRAINING_PAGES`` pages, the first by a hash of their ids; their blocks are
labelled by their elements where these are plain. Without training pages it has no say.

Cases: null, empty and tagless input gives an empty text (a page with bare text only gives that text). Unclosed
elements end with what contains them; a page is one row and may be of any length. Repeated rows get equal texts. An
empty table stays empty. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements by what they do to text.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
UNSEEN = frozenset(("head", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "datalist", "option", "dialog"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"))
CLOSES_P = frozenset((
    "address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
CONTENT_ELEMENTS = frozenset(("article", "main"))
BOILERPLATE_ELEMENTS = frozenset(("nav", "aside", "footer", "form", "menu", "fieldset", "dialog"))
ROLES = {"main": 4.0, "article": 4.0, "navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0,
         "form": -8.0, "dialog": -8.0, "alert": -8.0, "menu": -8.0, "menubar": -8.0, "toolbar": -8.0}
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscri(?:be|ption)|sign-?up|login|share|sharing|social|related|recommend(?:ed|ations)?|more-?stories|sidebar|side|widget|"
    r"nav|navbar|navigation|menu|breadcrumbs?|crumbs|pagination|pager|toolbar|header|masthead|topbar|footer|foot|copyright|legal|disclaimer|"
    r"comments?|commentlist|replies|reply|respond|disqus|discussion|tags?|skip|search|form)(?=$|[\s_-])", re.I)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|body|main|text|prose)(?=$|[\s_-])", re.I)

STRONG, WEAK = 8.0, 1.5
IN_CONTENT = 4.0
NEXT_EDGE, NEAR_EDGE = 0.5, 0.5
TRAINING_PAGES = 2000
#: The model's say is bounded, so that elements outweigh shape.
MODEL_BOUND = 2.5

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|(?=[\s/>]|$))", re.I)


class Block:
    __slots__ = ("text", "weight", "path", "tag", "linked")

    def __init__(self, text: str, weight: float, path: tuple[int, ...], tag: str, linked: int):
        self.text, self.weight, self.path, self.tag, self.linked = text, weight, path, tag, linked


def _weigh(tag: str, attr: str, inside: float, parents: list) -> tuple[float, bool]:
    """The weight of an element's content for content (positive) or boilerplate, and whether it is shown at all."""
    weight, shown = 0.0, tag not in UNSEEN
    if tag in CONTENT_ELEMENTS:
        weight = IN_CONTENT
    elif tag in BOILERPLATE_ELEMENTS:
        weight = -STRONG
    elif tag == "header":  # an article's own header holds its title
        weight = 0.0 if any(p[0] in CONTENT_ELEMENTS for p in parents) else -STRONG
    if attr and not attr.isspace():
        for m in ATTR.finditer(attr):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
                if BOILERPLATE_NAMES.search(value) and tag not in ("body", "html", "article", "main"):
                    weight -= STRONG
                elif CONTENT_NAMES.search(value) and weight == 0:
                    weight += WEAK
            elif name == "role":
                weight += ROLES.get(value.strip().lower(), 0.0)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                shown = False
    return weight, shown


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    # open elements: tag, summed weight, shown, number among its siblings, children so far
    stack: list[list] = [["", 0.0, True, 0, 0]]
    parts: list[str] = []
    linked = 0
    context: tuple[float, tuple[int, ...], str] | None = None
    links = 0

    def flush() -> None:
        nonlocal parts, linked, context
        text = " ".join("".join(parts).split()) if parts else ""
        if text and context:
            out.append(Block(text, context[0], context[1], context[2], min(linked, len(text))))
        parts, linked, context = [], 0, None

    def add(raw: str) -> None:
        nonlocal linked, context
        if not raw or not stack[-1][2]:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if context is None and not text.isspace():
            owner = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
            low = min(e[1] for e in stack[stack.index(owner):])
            context = (low if low < owner[1] else owner[1], tuple(e[3] for e in stack[:stack.index(owner) + 1]), owner[0])
        parts.append(text)
        if links:
            linked += len(text.strip())

    def close_to(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            links -= e[0] == "a"
        del stack[k:]

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] is not None and m["raw"].lower() not in ("script", "style"):
                flush()
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if not inline:
            flush()
        if m["close"]:
            k = len(stack) - 1
            while k > 0 and stack[k][0] != tag:
                # an inline end tag doesn't reach out of its block, a p's not out of its container
                if (inline or tag in ("p", "li")) and stack[k][0] not in INLINE:
                    k = 0
                    break
                k -= 1
            if k > 0:
                close_to(k)
            continue
        if tag in CLOSES_P:
            k = len(stack) - 1
            while k > 0 and stack[k][0] in INLINE:
                k -= 1
            if k > 0 and stack[k][0] == "p":
                close_to(k)
        elif tag in SAME:
            k = len(stack) - 1
            while k > 0 and stack[k][0] != tag and stack[k][0] not in SAME[tag]:
                k -= 1
            if k > 0 and stack[k][0] == tag:
                close_to(k)
        stack[-1][4] += 1
        if tag in VOID or (m["attr"] or "").endswith("/") and inline:
            continue
        weight, shown = _weigh(tag, m["attr"] or "", stack[-1][1], stack)
        stack.append([tag, stack[-1][1] + weight, stack[-1][2] and shown, stack[-1][4], 0])
        links += tag == "a"
    add(page[at:])
    flush()
    return out


def shape_of(b: Block) -> list[tuple[str, int]]:
    """What the model looks at: features with a few values each."""
    n = len(b.text)
    marks = sum(b.text.count(c) for c in ".,;:!?")
    return [("length", min(8, n.bit_length())), ("links", min(3, 4 * b.linked // max(n, 1))), ("marks", min(4, 100 * marks // max(n, 1))),
            ("end", int(b.text[-1:] in ".!?\"”»")), ("tag", ("p", "li", "td", "div", "h1", "h2", "h3", "").index(b.tag) if b.tag in ("p", "li", "td", "div", "h1", "h2", "h3", "") else 8)]


def _near(blocks: list[Block]) -> Iterator[tuple[int, int]]:
    """Each block with the next one that shares its parent element: near in the tree, if not in the page."""
    last: dict[tuple[int, ...], int] = {}
    for i, b in enumerate(blocks):
        key = b.path[:-1]
        if key in last and last[key] != i - 1:
            yield last[key], i
        last[key] = i


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the source's side of a minimum cut.

    ``content[i]`` is the cost of calling block i boilerplate, ``boilerplate[i]`` that of calling it content; an edge's
    weight is paid if its ends differ. Dinic's algorithm after the part of both capacities that always flows.
    """
    n = len(content)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, (c, b) in enumerate(zip(content, boilerplate, strict=True)):
        if c > b:
            join(s, i, c - b, 0.0)
        elif b > c:
            join(i, t, b - c, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(j for j, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(head[u]):
                path.append(head[u][turn[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                turn[u] += 1


def main_text(page: str | None, ratios: dict[tuple[str, int], float]) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    content, boilerplate = [], []
    for b in blocks:
        model = sum(ratios.get(x, 0.0) for x in shape_of(b)) if ratios else 0.0
        lean = b.weight + max(-MODEL_BOUND, min(MODEL_BOUND, model))
        content.append(max(lean, 0.0))
        boilerplate.append(max(-lean, 0.0))
    edges = [(i, i + 1, NEXT_EDGE) for i in range(len(blocks) - 1)] + [(a, b, NEAR_EDGE) for a, b in _near(blocks)]
    keep = minimum_cut(content, boilerplate, edges)
    if not any(keep) and all(abs(b.weight) < WEAK for b in blocks):
        keep = [True] * len(blocks)  # nothing marks anything: bare text
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def train(pages: DataFrame, page_id: str = "page_id", page: str = "html", limit: int = TRAINING_PAGES) -> dict[tuple[str, int], float]:
    """Log ratios content / boilerplate by feature and value, from at most ``limit`` pages."""
    chosen = pages.select(F.col(page_id).alias("i")).orderBy(F.xxhash64("i"), "i").limit(limit).distinct()
    sample = pages.select(F.col(page_id).alias("i"), F.col(page).alias("html")).join(F.broadcast(chosen), "i", "left_semi")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(name, value, b.weight > 0) for p in frame["html"] for b in blocks_of(p) if abs(b.weight) >= IN_CONTENT for name, value in shape_of(b)]
            yield pd.DataFrame(rows, columns=["name", "value", "content"]).groupby(["name", "value", "content"]).size().reset_index(name="n")

    counted = sample.mapInPandas(count, "name string, value int, content boolean, n bigint").groupBy("name", "value", "content").agg(F.sum("n").alias("n"))
    n = {(r["name"], r["value"], r["content"]): r["n"] for r in counted.collect()}  # a few values a feature
    out = {}
    for name, value in sorted({k[:2] for k in n}):
        share = [(n.get((name, value, c), 0) + 1) / (sum(x for k, x in n.items() if k[0] == name and k[2] is c) + 10) for c in (True, False)]
        out[name, value] = math.log(share[0] / share[1])
    return out


def extract(pages: DataFrame, ratios: dict[tuple[str, int], float], page: str = "html"):
    """The main text of a column of pages, as a column."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, ratios) for p in batch], dtype=object)
    return text(F.col(page))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    texts = pages.select("page_id", "url", extract(pages, train(pages)).alias("text"))
    return texts.select("*", F.length("text").cast("long").alias("n_chars"))
