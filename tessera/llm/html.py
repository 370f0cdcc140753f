"""Main text of web pages by minimum-cut labelling of their blocks.

A page is split into blocks: runs of text between the starts and ends of block elements, with character references
decoded and white space as one space. A logistic classifier (trained on blocks of generated, labelled pages, half of them
without telling names) looks at the text, its links and marks, the text and links of its container, the elements around it, and names of
containers, and gives each block costs for the labels content and boilerplate. The costs are the capacities of a block's edges to the two terminals;
neighbouring blocks, and neighbours among the blocks of one container, are joined by smoothness edges, the weaker the
further apart in the document tree. The maximum flow's minimum cut is the cheapest labelling; content is what stays on
the source's side. Scripts, styles, templates, form controls and the head never become blocks; all other text does (mathematics, drawings,
what is shown without scripts).

One page is handled at a time, in time about proportional to its length, so memory follows the largest page. Null and empty pages, and pages without content, give
an empty text; malformed markup is closed as it ends, and a quote that doesn't end is none; a null URL stays null; ties between equal cuts go to boilerplate; repeated rows give equal texts; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: Inside a tag: a quote after an equals sign, or the end.
INSIDE = re.compile(r"""=[ \t\r\n]{0,9}(["'])|>""")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
HIDDEN = re.compile(r"""\shidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
#: Element names of HTML by their part in the layout; fixed values.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style template head title iframe select option button textarea datalist".split())
RAW = frozenset("script style textarea title iframe".split())
#: Elements that the start of the same kind, or of a block, closes.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
STOPS = frozenset("article section div table ul ol dl nav aside main form body html td th li dd".split())
#: Names of classes, ids and roles that tell content or boilerplate.
GOOD_NAMES = frozenset("article content post entry story main body text prose markdown".split())
BAD_NAMES = frozenset(
    "nav navigation navbar menu sidebar side aside footer foot header masthead banner ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies consent "
    "notice alert popup modal overlay comment comments reply replies respond discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager login "
    "signup subscribe subscription newsletter widget toolbar search form tags meta byline copyright legal disclaimer skip complementary contentinfo dialog".split()
)
LAMBDA, FAR = 0.6, 0.3
SCALE = 1000


class Block:
    """far: the steps in the tree from the block before; home: the number of the element around the block's own."""

    __slots__ = ("text", "link", "tag", "far", "home", "main", "aside", "good", "bad")

    def __init__(self, text, link, tag, far, home, main, aside, good, bad):
        self.text, self.link, self.tag, self.far, self.home, self.main, self.aside, self.good, self.bad = text, link, tag, far, home, main, aside, good, bad


CONTAINER = frozenset("div section article main aside ul ol dl table nav header footer form body menu dialog fieldset details".split())
ASIDE = frozenset("nav aside footer header form menu dialog".split())


def _signals(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether names of a container tell content, or boilerplate. Those of single blocks tell nothing."""
    if not attrs or tag not in CONTAINER:
        return False, False
    names: set[str] = set()
    for m in NAMES.finditer(attrs):
        names.update(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1]).lower()))
    bad = bool(names & BAD_NAMES)
    return not bad and bool(names & GOOD_NAMES), bad


def tokens(page: str):
    """(text, None, False, "") and (None, tag, whether it ends an element, attributes) of the page, without comments and declarations."""
    at, size, no_end, no_quote = 0, len(page), False, {}
    while at < size:
        i = page.find("<", at)
        if i < 0:
            i = size
        if i > at:
            yield page[at:i], None, False, ""
        if i == size:
            return
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = size if end < 0 else end + 3
            continue
        m = NAME.match(page, i)
        if not no_end and page.find(">", i) < 0:
            no_end = True
        if no_end or not (m or page.startswith(("<!", "<?"), i)):
            yield "<", None, False, ""
            at = i + 1
            continue
        if not m:
            at = page.index(">", i) + 1
            continue
        end = m.end()
        while True:
            k = INSIDE.search(page, end)
            if not k:  # the last quote reaches to the end of the page
                end = page.index(">", m.end()) + 1
                break
            if not k[1]:
                end = k.end()
                break
            close = -1 if no_quote.get(k[1]) else page.find(k[1], k.end())
            if close < 0:
                no_quote[k[1]] = True
                end = page.find(">", k.end()) + 1 or page.index(">", m.end()) + 1
                break
            end = close + 1
        at = end
        tag = m[1].lower()
        closing = page[i + 1] == "/"
        yield None, tag, closing, page[m.end() : end - 1]
        if tag in RAW and not closing:
            stop = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else size


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    stack: list[tuple] = []  # tag, and whether anything so far is main, aside, good, bad
    opened: dict[str, int] = {}
    closable: list[int] = []  # places in the stack of elements that a start tag may close, or that stop that
    tree: list[tuple[int, str]] = []  # numbers and tags of the open block elements
    parts: list[str] = []
    number = link = skip = in_link = 0
    lowest = last = 0  # depth of the tree: the least since the last block, and that block's

    def flush():
        nonlocal link, lowest, last
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                depth = len(tree)
                low = min(lowest, depth)
                state = stack[-1][1:] if stack else (False, False, False, False)
                out.append(Block(text, link, tree[-1][1] if tree else "body", last + depth - 2 * low, tree[-2][0] if depth > 1 else 0, *state))
                lowest = last = depth
            parts.clear()
        link = 0

    def close(depth: int):
        nonlocal skip, in_link, lowest
        while len(stack) > depth:
            t = stack.pop()[0]
            opened[t] -= 1
            skip -= t in SKIP
            in_link -= t == "a"
            if t in BLOCK:
                tree.pop()
                lowest = min(lowest, len(tree))
        while closable and closable[-1] >= depth:
            closable.pop()

    for text, tag, ends, attrs in tokens(page):
        if tag is None:
            if not skip:
                parts.append(text)
                if in_link:
                    link += len(text)
            continue
        if ends:
            if opened.get(tag):
                if tag in BLOCK:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            elif tag in BLOCK and not skip:
                flush()
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif not skip and tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            for i in reversed(closable):
                t = stack[i][0]
                if tag in CLOSED_BY.get(t, ()):
                    close(i)
                    break
                if t in STOPS:
                    break
        if attrs.endswith("/") and tag in ("svg", "script", "iframe"):
            continue
        main, aside, good, bad = stack[-1][1:] if stack else (False, False, False, False)
        g, b = _signals(tag, attrs)
        if tag not in SKIP and attrs and HIDDEN.search(attrs):
            b = True
        # the header and footer of an article may be parts of it
        aside = aside or (tag in ASIDE and not (main and tag in ("header", "footer")))
        number += 1
        if tag in CLOSED_BY or tag in STOPS:
            closable.append(len(stack))
        stack.append((tag, main or tag in ("article", "main"), aside, good or g, bad or b))
        opened[tag] = opened.get(tag, 0) + 1
        skip += tag in SKIP
        in_link += tag == "a"
        if tag in BLOCK:
            tree.append((number, tag))
    flush()
    return out


FEATURES = 15
NOTICE = re.compile(r"©|\(c\)|all rights reserved|cookie|subscribe|sign up|log in|sponsored|advert", re.I)


def features(found: list[Block]) -> np.ndarray:
    """One row of numbers for each block of a page."""
    held: dict[int, list[int]] = {}
    for b in found:
        sums = held.setdefault(b.home, [0, 0])
        sums[0] += len(b.text)
        sums[1] += min(b.link, len(b.text))
    most = max(v[0] for v in held.values()) if held else 1
    rows = []
    for b in found:
        n = len(b.text)
        chars, links = held[b.home]
        rows.append(
            [
                1.0,
                float(b.main),
                float(b.aside),
                float(b.good),
                float(b.bad),
                min(1.0, b.link / n),
                links / chars,
                math.log1p(n) / 5,
                math.log1p(chars) / 8,
                chars / most,
                float(b.text[-1] in ".!?…。\"”»"),
                float(b.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")),
                float(b.tag in ("li", "td", "th", "dt", "dd")),
                min(1.0, 8 * sum(map(b.text.count, ",;.")) / n),
                float(bool(NOTICE.search(b.text))),
            ]
        )
    return np.array(rows).reshape(-1, FEATURES)


def generated(pages: int = 400, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of generated pages; a content block's text begins with a mark that is cut off.
    In half of the pages no name tells anything; elements may have the names of the other kind."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdehilnorstu") for _ in range(r.randint(1, 9)))
    text = lambda a, b: " ".join(word() + r.choice(("", "", "", ",")) for _ in range(r.randint(a, b))).capitalize() + r.choice((".", ".", ".", "", "?"))
    rows, labels = [], []
    for _ in range(pages):
        telling = r.random() < 0.5
        name = lambda *names: f' {r.choice(("class", "class", "id"))}="{r.choice(names) if telling else word()}"' if telling or r.random() < 0.7 else ""
        link = lambda: f'<a href="/{word()}">{text(1, 3)}</a>'
        listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
        junk = [
            lambda: f"<nav>{listed()}</nav>",
            lambda: f'<div{name("ad", "advert top", "sponsored", "promo-box")}>{text(3, 25)}</div>',
            lambda: f'<aside{name("sidebar")}><h3>{text(1, 3)}</h3>{listed()}<p>{text(4, 20)}</p></aside>',
            lambda: f'<div{name("cookie-notice", "notice", "banner")}><p>{text(5, 25)}</p></div>',
            lambda: f'<div{name("comments")}><h2>{text(1, 2)}</h2>' + "".join(f'<div{name("comment")}><p>{text(3, 40)}</p></div>' for _ in range(r.randint(1, 4))) + "</div>",
            lambda: f"<form><label>{text(1, 3)}</label><input></form>",
            lambda: f"<header><h1>{text(1, 3)}</h1>{listed()}</header>",
            lambda: f'<div{name("menu")}>{listed()}</div>',
            lambda: f"<div>{listed()}</div>",
            lambda: f"<div>{' | '.join(link() for _ in range(r.randint(2, 6)))}</div>",
        ]
        note = lambda: r.choice(("", "", "", f' class="{word()}"', ' class="note comment"'))
        body = "".join(
            r.choice(
                (
                    lambda: f"<p{note()}>\x02{text(1, 90)}</p>",
                    lambda: f"<p{note()}>\x02{text(10, 60)} {link()} {text(2, 30)}</p>",
                    lambda: f"<h2>\x02{text(1, 6)}</h2>",
                    lambda: f"<header><h2>\x02{text(1, 6)}</h2></header>",
                    lambda: "<ul>" + "".join(f"<li>\x02{text(2, 12)}</li>" for _ in range(3)) + "</ul>",
                    lambda: f"<blockquote>\x02{text(5, 40)}</blockquote>",
                )
            )()
            for _ in range(r.randint(2, 14))
        )
        wrap = r.choice(("article", "article", "main", f"div{name('content', 'post')}", f"div{name('content', 'post')}", "div", "section"))
        inside = junk[1]() if telling and r.random() < 0.4 else ""
        parts = [r.choice(junk)() for _ in range(r.randint(1, 4))]
        parts.append(f"<{wrap}><h1>\x02{text(2, 9)}</h1>{inside}{body}</{wrap.split()[0]}>")
        parts += [r.choice(junk)() for _ in range(r.randint(0, 3))]
        parts.append(f"<footer>&copy; {word()} {text(1, 8)}</footer>")
        found = blocks("<html><body>" + "".join(parts) + "</body></html>")
        marks = [b.text.startswith("\x02") for b in found]
        for b in found:
            b.text = b.text.replace("\x02", "") or "."
        rows.append(features(found))
        labels += marks
    return np.concatenate(rows), np.array(labels, float)


def train(rounds: int = 12, ridge: float = 0.3) -> np.ndarray:
    """Weights of the block classifier: logistic regression by Newton steps."""
    x, y = generated()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node stays on the source's side of a minimum cut (whole capacities; edges hold both ways).

    The flow of each node's own source-sink path is taken out first; the rest is found in phases: the distances from the sources, then
    every shortest path at once, by a walk that never tries an edge twice in a phase.
    """
    n = len(source)
    net = [a - b for a, b in zip(source, sink)]
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        if a != b:
            near[a].append(len(to))
            near[b].append(len(to) + 1)
            to += [b, a]
            room += [c, c]
    while True:
        level = [0 if x > 0 else -1 for x in net]
        queue, met = deque(i for i in range(n) if net[i] > 0), -1
        while queue:
            u = queue.popleft()
            if met >= 0 and level[u] >= met:
                break
            for e in near[u]:
                v = to[e]
                if room[e] > 0 and level[v] < 0:
                    level[v] = level[u] + 1
                    if net[v] < 0:
                        met = level[v]
                    queue.append(v)
        if met < 0:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            while net[start] > 0:
                path, u = [], start  # edges from start to u
                while net[u] >= 0:
                    k = tried[u]
                    while k < len(near[u]):
                        e = near[u][k]
                        if room[e] > 0 and level[to[e]] == level[u] + 1 and (level[to[e]] < met or net[to[e]] < 0):
                            break
                        k += 1
                    tried[u] = k
                    if k < len(near[u]):
                        path.append(e)
                        u = to[e]
                    elif path:
                        u = to[path.pop() ^ 1]
                        tried[u] += 1
                    else:
                        break
                if net[u] >= 0:
                    break
                push = min(net[start], -net[u], min(map(room.__getitem__, path)))
                net[start] -= push
                net[u] += push
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push


def main_text(page: str, w: np.ndarray) -> str:
    """The content blocks of a page, joined by line ends."""
    found = blocks(page)
    if not found:
        return ""
    scores = (features(found) @ w).clip(-12, 12)
    keep = np.logaddexp(0, -scores)  # cost of the label content
    drop = np.logaddexp(0, scores)  # cost of the label boilerplate
    source, sink = (drop * SCALE).astype(int).tolist(), (keep * SCALE).astype(int).tolist()
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, int(SCALE * LAMBDA / (1 + b.far))))
        if b.home in last and last[b.home] != i - 1:
            edges.append((last[b.home], i, int(SCALE * FAR)))
        last[b.home] = i
    stay = minimum_cut(source, sink, edges)
    return "\n".join(b.text for b, s in zip(found, stay) if s)


def extracted(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text of every row of pages."""
    w = train() if weights is None else weights

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py() or "", w) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    common.byte_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")


def op8_mincut_html(spark, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
