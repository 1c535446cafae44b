"""Main text of web pages by a tree-structured graphical model.

A page is parsed into block elements and text runs (the inline content between block borders). Each is a node with two
states, content or not; an element is content if any text below it is. Nodes have unary potentials of
their features and every child shares a pairwise potential with its parent. Sum-product message passing, upward and then downward
over the trees of a whole batch of pages level by level, gives each node's marginal; text runs with a marginal of
one half at least are the text. The potentials are trained by maximum likelihood, whose gradient takes the same
marginals, on labelled pages (`labelled_pages`, a fixed number of them); what they came to is kept in WEIGHTS, and a test trains them again.

Character references are decoded, white space in a run becomes one space, runs are trimmed and joined
by newlines in page order; empty runs are left out. A line break tag is white space.

Defined results: a null or empty page has an empty text; markup that is never closed ends where its parent does, an unclosed
comment, script or tag takes the rest of the page; elements nest to any depth; rows that repeat are extracted each; an empty table
gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import json
import pathlib
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits
from .labelled_pages import MARK, labelled_pages

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is never text of the page.
DROPPED = frozenset("script style head noscript template iframe svg math object canvas audio video select textarea button title".split())
#: Of these the content isn't parsed as markup.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
#: A start tag of the key closes these if they are open and nothing in STOPS is between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "body": set()}


@dataclass
class Nodes:
    """The nodes of many pages; a parent comes before its children."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    look: list[tuple] = field(default_factory=list)  # of elements: tag, class, id and role; of runs: ()
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links

    def add(self, page: int, parent: int, look: tuple, text: str = "", linked: int = 0) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.look.append(look)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.page) - 1


def collapsed(nodes: Nodes, page: int) -> None:
    """Takes out of the last page's tree each element without a name whose only child is one of the same tag, unnamed as well: it says nothing."""
    begin = len(nodes.page)
    while begin and nodes.page[begin - 1] == page:
        begin -= 1
    children = Counter(nodes.parent[begin:])
    gone = {p for i in range(begin + 1, len(nodes.page)) if children[p := nodes.parent[i]] == 1 and p > begin and nodes.look[i]
        and nodes.look[i] == nodes.look[p] and not nodes.look[i][1]}
    if not gone:
        return
    place, kept = {}, 0
    for i in range(begin, len(nodes.page)):  # parents come first
        p = nodes.parent[i]
        up = place.get(p, p)
        if i in gone:
            place[i] = up
            continue
        to = begin + kept
        place[i], kept = to, kept + 1
        nodes.parent[to], nodes.depth[to] = up, nodes.depth[up] + 1 if up >= 0 else 0
        nodes.page[to], nodes.look[to], nodes.text[to], nodes.linked[to] = page, nodes.look[i], nodes.text[i], nodes.linked[i]
    for column in (nodes.page, nodes.parent, nodes.depth, nodes.look, nodes.text, nodes.linked):
        del column[begin + kept :]


def attributes(source: str) -> str:
    return " ".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in ATTRIBUTE.finditer(source)) if "=" in source else ""


def parse(source: str, page: int, out: Nodes) -> None:
    root = out.add(page, -1, ("html", ""))
    stack: list[tuple[str, int]] = [("html", root)]  # open elements; inline ones have their block's node
    pieces: list[str] = []
    linked = links = dropped = 0
    at, end = 0, len(source)

    places: dict[str, list[int]] = defaultdict(list)  # of each tag's elements in the stack
    blocks: list[int] = []  # places of block elements in the stack

    def push(tag: str, own: int):
        if tag in BLOCKS:
            blocks.append(len(stack))
        places[tag].append(len(stack))
        stack.append((tag, own))

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.add(page, stack[-1][1], (), text, linked)
            pieces.clear()
        linked = 0

    def close(k: int):
        """Closes all open elements from the k-th on."""
        nonlocal links, dropped
        if blocks and blocks[-1] >= k:
            flush()
            while blocks and blocks[-1] >= k:
                blocks.pop()
        for t, _ in stack[k:]:
            places[t].pop()
            links -= t == "a"
            dropped -= t in DROPPED
        del stack[k:]

    while at < end:
        m = TOKEN.search(source, at)
        to = m.start() if m else end
        if to > at and not dropped:
            pieces.append(source[at:to])
            if links:
                linked += to - at
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if places[tag]:
                close(places[tag][-1])
            elif tag == "p" and not dropped:
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            if blocks and stack[blocks[-1]][0] == "p":  # an open paragraph ends before a block
                close(blocks[-1])
            flush()
            if tag in CLOSES:
                stop = max((places[t][-1] for t in STOPS[tag] if places[t]), default=0)
                above = [places[t][bisect_right(places[t], stop)] for t in CLOSES[tag] if places[t] and places[t][-1] > stop]
                if above:
                    close(min(above))
            if tag == "html":
                continue
            push(tag, out.add(page, stack[-1][1], (tag, attributes(m[3] or m[6] or ""))) if not dropped else stack[-1][1])
            continue
        if tag == "a" and links:  # links don't nest
            close(places["a"][-1])
        if tag in RAW:
            found = RAW[tag].search(source, at)
            at = found.end() if found else end
        else:
            push(tag, stack[-1][1])
            links += tag == "a"
            dropped += tag in DROPPED
    flush()
    collapsed(out, page)


WORD = re.compile(r"[a-z]+")


@lru_cache(100_000)
def look_features(look: tuple) -> tuple[str, ...]:
    """Names of an element's features: its tag, and the words of its class, id and role."""
    tag, named = look
    return ("tag " + tag, *sorted({"name " + w for part in named.lower().split() for w in WORD.findall(part.partition("=")[2] or part)}))


#: What short runs of boilerplate say. Common phrases of web pages.
PHRASES = """responses?|replies|discussion|kommentare?|commentaires?|comentarios?|about us|accept|advertisement|agree|all rights reserved|also like|anzeige|archives|back to|browser|buy now|by using|comments?|contact|cookies?|copyright
derechos reservados|email|filed under|follow us|home|impressum|inc|leave a|log ?in|mentions l\u00e9gales|menu|min read|newsletter|next page|popular|posted|powered by|print
privacy|publicidad|read more|recent|recommended|registered|related|reply|save|says|search|share|sign ?(?:in|up)|skip to|sponsored|submit|subscribe|tags|terms|trademark
tweet|welcome|\u00a9|\\|"""
SAYS = re.compile("|".join(rf"(?<!\w)(?:{x})(?!\w)" for x in PHRASES.replace("\n", "|").split("|") if x.strip("\\")), re.I)
SHORT = 200
#: Words that phrases begin with: most runs have none, which is seen at once.
FIRST = frozenset(w for x in PHRASES.replace("\n", "|").split("|") for w in WORD.findall(x)[:1] if w not in ("log", "sign")) | {"log", "login", "sign",
    "comment", "cookie", "response", "kommentar", "commentaire", "comentario"}


def run_words(text: str) -> tuple[str, ...]:
    """Names of the features of what a short run says."""
    if len(text) > SHORT or FIRST.isdisjoint(WORD.findall(text.lower())) and "\u00a9" not in text and "|" not in text:
        return ()
    return tuple({"says " + x.lower() for x in SAYS.findall(text)})


RUN = ["run", "log_chars", "log_words", "linked", "all_linked", "stop", "comma", "short", "first", "last", "of_page"]
ELEMENT = ["log_chars", "linked", "log_runs", "of_page", "mean_run", "few"]


def run_features(text: str, linked: int) -> list[float]:
    n = len(text)
    words = text.count(" ") + 1
    share = min(1.0, linked / n)
    return [1.0, np.log1p(n) / 5, np.log1p(words) / 3, share, float(share > 0.9), float(text[-1] in ".!?:%*&$#\"'"), min(1.0, text.count(",") / words),
        float(words < 4)]


class Forest:
    """Trees of a batch in arrays, and sum-product over them."""

    def __init__(self, nodes: Nodes):
        self.parent, depth = np.array(nodes.parent, np.int64), np.array(nodes.depth, np.int64)
        self.run = np.array([not x for x in nodes.look], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth)[:-1])) if len(order) else []
        self.page = np.array(nodes.page, np.int64)
        size = np.array([[len(t), min(k, len(t)), 1.0 if t else 0.0] for t, k in zip(nodes.text, nodes.linked, strict=True)]).reshape(-1, 3)
        for level in self.levels[:0:-1]:
            np.add.at(size, self.parent[level], size[level])
        self.size = size  # characters, linked ones and runs of what is below

    def features(self, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the runs, their features (RUN), and those of all nodes as elements (ELEMENT; zero for runs)."""
        runs = np.flatnonzero(self.run)
        root = np.flatnonzero(self.parent < 0)  # one for each page, in order
        total = np.maximum(self.size[root[np.searchsorted(self.page[root], self.page)], 0], 1)
        own = np.array([run_features(nodes.text[i], nodes.linked[i]) for i in runs.tolist()]).reshape(len(runs), len(RUN) - 3)
        place = np.searchsorted(self.page[runs], self.page[runs])  # the page's first run
        after = np.searchsorted(self.page[runs], self.page[runs], "right") - 1
        number = np.arange(len(runs))
        ends = [np.maximum(0, 1 - (number - place) / 3), np.maximum(0, 1 - (after - number) / 3), self.size[runs, 0] / total[runs]]
        chars, linked, many = self.size.T
        some = np.maximum(chars, 1)
        elements = np.column_stack([np.log1p(chars) / 5, linked / some, np.log1p(many) / 3, chars / total, np.log1p(chars / np.maximum(many, 1)) / 5,
            chars < 60])
        elements[self.run == 1] = 0
        return runs, np.column_stack([own, *ends]), elements

    def sum_product(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals (node, state) and (node, parent's state, own state); pair[run][parent][own] are log potentials."""
        n = len(unary)
        below = np.zeros((n, 2))
        below[:, 1] = unary
        up, above = np.zeros((n, 2)), np.zeros((n, 2))
        w = pair[self.run]
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(below[level][:, None, :] + w[level], axis=2)
            np.add.at(below, self.parent[level], up[level])
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            cavity = above[p] + below[p] - up[level]
            joint = cavity[:, :, None] + w[level]
            above[level] = np.logaddexp.reduce(joint, axis=1)
            joint += below[level][:, None, :]
            both[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None])
        total = above + below
        return np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None]), both


#: Characters of a run that can be the heading of what it stands at the top of.
HEADING = 60
#: Headings of what readers write. Common phrases of web pages.
READERS = re.compile(
    r"\W*(?:\d+\s+)?(?:(?:reader|user|visitor|all|join the|leave a|post a|add a|write a|your)\s+)?"
    r"(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?|commentaires?|comentarios?)\W*(?:\d+\W*)?", re.I)  # fmt: skip


def names(nodes: Nodes) -> list[tuple[str, ...]]:
    """Names of each node's features: what an element's look says and what a short run at its top, what a run says, and whether either is below a
    heading of READERS."""
    n = len(nodes.page)
    first = [-1] * n  # an element's first run
    for i in range(n - 1, -1, -1):  # children come after their parents, in order
        if not nodes.look[i]:
            first[i] = i
        if first[i] >= 0 and nodes.parent[i] >= 0:
            first[nodes.parent[i]] = first[i]
    out, below = [], [False] * n
    for i in range(n):
        if not nodes.look[i]:
            own = run_words(nodes.text[i])
        else:
            own, top = look_features(nodes.look[i]), nodes.text[first[i]] if first[i] >= 0 else ""
            if 0 < len(top) <= HEADING:
                own += tuple({"headed" + x[4:] for x in run_words(top)})
                if nodes.parent[i] >= 0 and READERS.fullmatch(top):
                    own, below[i] = (*own, "headed by readers"), True
        if nodes.parent[i] >= 0 and below[nodes.parent[i]]:
            below[i], own = True, (*own, "below readers" if nodes.look[i] else "run below readers")
        out.append(own)
    return out


@dataclass
class Model:
    names: dict[str, float]
    run: np.ndarray
    element: np.ndarray
    pair: np.ndarray

    def to_json(self) -> str:
        rounded = lambda x: [round(float(v), 5) for v in x]
        return json.dumps({"names": {k: round(v, 5) for k, v in self.names.items()}, "run": rounded(self.run), "element": rounded(self.element),
            "pair": rounded(self.pair.ravel())}, indent=0)

    @classmethod
    def from_json(cls, text: str) -> Model:
        told = json.loads(text)
        return cls(told["names"], np.array(told["run"]), np.array(told["element"]), np.array(told["pair"]).reshape(2, 2, 2))

    def marginals(self, nodes: Nodes) -> np.ndarray:
        forest, weight = Forest(nodes), self.names.get
        runs, x, elements = forest.features(nodes)
        unary = np.array([sum(weight(f, 0.0) for f in own) for own in names(nodes)]) + elements @ self.element
        unary[runs] += x @ self.run
        return forest.sum_product(unary, self.pair)[0][:, 1]

    def extract(self, pages: list[str]) -> list[str]:
        nodes = Nodes()
        for i, source in enumerate(pages):
            parse(source, i, nodes)
        out: list[list[str]] = [[] for _ in pages]
        for page, look, text, p in zip(nodes.page, nodes.look, nodes.text, self.marginals(nodes).tolist(), strict=True):
            if not look and p >= 0.5:
                out[page].append(text)
        return ["\n".join(x) for x in out]


def fit(pages: list[str], steps: int = 500, l2: float = 0.06) -> Model:
    """Maximum likelihood by gradient steps with per-weight rates; MARK at the start of a run is its label."""
    nodes = Nodes()
    for i, source in enumerate(pages):
        parse(source, i, nodes)
    n = len(nodes.page)
    truth = np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        if MARK in nodes.text[i]:
            truth[i], nodes.text[i] = 1, nodes.text[i].replace(MARK, "")
        if truth[i] and nodes.parent[i] >= 0:
            truth[nodes.parent[i]] = 1
    named = names(nodes)
    vocabulary = sorted({f for own in named for f in own})
    number = {f: i for i, f in enumerate(vocabulary)}
    row, column = (np.array(x) for x in zip(*[(i, number[f]) for i, own in enumerate(named) for f in own], strict=True))
    forest = Forest(nodes)
    runs, x, elements = forest.features(nodes)
    v, k, e = len(vocabulary), len(RUN), len(ELEMENT)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.run[inner], truth[forest.parent[inner]], truth[inner]), 1)
    w, squares, speed = (np.zeros(v + k + e + 8) for _ in range(3))
    for step in range(1, steps + 1):
        unary = np.bincount(row, w[column], n) + elements @ w[v + k : v + k + e]
        unary[runs] += x @ w[v : v + k]
        one, two = forest.sum_product(unary, w[v + k + e :].reshape(2, 2, 2))
        left = truth - one[:, 1]
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, forest.run[inner], two[inner])
        gradient = [np.bincount(column, left[row], v), x.T @ left[runs], elements.T @ left, (seen - expected).ravel()]
        gradient = np.concatenate(gradient) / len(pages) - l2 * w / len(pages)
        speed = 0.9 * speed + 0.1 * gradient
        squares = 0.99 * squares + 0.01 * gradient**2
        w = w + 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(vocabulary, w[:v].tolist(), strict=True)), w[v : v + k], w[v + k : v + k + e], w[v + k + e :].reshape(2, 2, 2))


#: The trained weights; `python -m auditweave.llm.html_extract` trains and writes them.
WEIGHTS = pathlib.Path(__file__).with_name("html_weights.json")


@lru_cache(1)
def trained() -> Model:
    return Model.from_json(WEIGHTS.read_text())


#: Pages whose trees are worked on together.
TOGETHER = 64


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    spark = pages.sparkSession
    arrow_limits(spark)
    held = spark.sparkContext.broadcast(model or trained())  # a few hundred weights

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                rows = b.slice(at, TOGETHER)
                texts = held.value.extract(rows.column("html").to_pylist())
                yield pa.record_batch([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    WEIGHTS.write_text(fit(labelled_pages()).to_json())
