"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import arrays

#: Fixed values of HTML: elements without an end tag, with raw text, that begin a block, and that an element of the same kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Blocks that are text of the element around them, and such that structure it; the others are boxes of their own.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption legend summary option address tbody thead tfoot hgroup".split())
STRUCTURE = frozenset("ul ol dl table blockquote figure pre details".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text isn't running text of any page.
NEVER = frozenset("button canvas head iframe input map noscript object script select style svg template textarea title".split())
#: Elements that seldom hold the article, and words by which authors name such; both weigh, and the scores decide.
WEIGHED = frozenset("aside dialog footer form menu nav search".split())
NAMES = frozenset(
    "ad ads adsbygoogle adv advert advertise advertisement advertising adverts adbox adslot alert banner breadcrumb breadcrumbs byline cookie cookies comment comments commentlist complementary consent contentinfo "
    "copyright crumbs dialog disclaimer discussion disqus foot footer gdpr header login masthead menu menubar menus modal nav navbar navigation newsletter notice notices notification notifications outbrain overlay paywall "
    "pagination pager popup promo promos promotion reactions recommended recommendations related replies reply respond responses search share sharing sidebar signup skip social sponsor "
    "sponsored sponsors subscribe subscription survey taboola toast toolbar topbar trending widget widgets".split()
)
#: Words that say nothing beside such a name, as in site-footer; with any other (social-studies, ad-hoc) a name is none.
BESIDE = frozenset("area bar bottom box block col column container fixed global inner item items left links list main module outer page panel right row section site slot text top unit wrap wrapper".split())
WEIGHT = 0.02
OWN = frozenset("article body content entry main post story text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Paths:
    """The tag paths of a page as numbers: each is a label below an earlier path."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent = [-1]

    def below(self, path: int, label: str) -> int:
        found = self.known.get((path, label))
        if found is None:
            found = self.known[path, label] = len(self.parent)
            self.parent.append(path)
        return found

    def intervals(self) -> tuple[list[int], list[int]]:
        """Where each path comes, and its last descendant, in depth-first order."""
        children: list[list[int]] = [[] for _ in self.parent]
        for k in range(1, len(self.parent)):
            children[self.parent[k]].append(k)
        first, last = [0] * len(self.parent), [0] * len(self.parent)
        todo, n = [(0, False)], 0
        while todo:
            k, done = todo.pop()
            if done:
                last[k] = n - 1
                continue
            first[k] = n
            n += 1
            todo.append((k, True))
            todo.extend((c, False) for c in children[k])
        return first, last


class Element:
    """An open or closed element. What depends on the elements around it is handed down when it opens."""

    __slots__ = ("tag", "parent", "holder", "path", "box", "inside", "apart", "named", "holds", "weight")

    def __init__(self, tag: str, parent: Element | None, paths: Paths, label: str, apart: bool, named: bool):
        self.tag, self.parent, self.apart, self.named = tag, parent, apart, named
        self.holds = False  # an article, a main part or a first heading stands inside
        self.weight = 1.0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        block = tag in BLOCK or parent is None
        self.holder = self if block else parent.holder  # the innermost block
        self.path = 0 if parent is None else paths.below(parent.path, label) if block or tag in ("b", "strong") else parent.path
        self.box = self.path if block and tag not in LEAF else parent.box


class Block:
    __slots__ = ("element", "path", "box", "weight", "parts", "linked", "text")

    def __init__(self, element: Element, path: int):
        self.element, self.path, self.box, self.weight, self.parts, self.linked, self.text = element, path, element.box, 1.0, [], 0, ""


def _attributes(tag: str, source: str) -> tuple[str, bool, bool]:
    """(label of the element in a path, hidden, named as something that isn't the article)."""
    if not source.strip(" \t\r\n/"):
        return tag, False, False
    names, hidden, named = "", False, False
    for name, a, b, c in ATTRIBUTE.findall(source):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label"):
            for token in value.split() if name != "aria-label" else [value]:
                words = {w.lower() for w in NAME_WORD.findall(token)}
                hits = words & NAMES
                named = named or (bool(hits) and words <= NAMES | BESIDE and not (words & OWN and hits <= {"header", "byline", "banner"}))
            if name == "class":
                names += "." + ".".join(value.split())
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return tag + names, hidden, named and tag not in ("html", "body", "main", "article")


class Stack:
    """The open elements. Each tag's places and the blocks' places are kept, so that no step looks through the stack."""

    def __init__(self, root: Element):
        self.open, self.places, self.blocks, self.links = [root], {}, [0], 0

    def last(self, tags) -> int:
        """The place of the innermost element with one of these tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, e: Element) -> None:
        at = len(self.open)
        self.open.append(e)
        self.places.setdefault(e.tag, []).append(at)
        if e.tag in BLOCK:
            self.blocks.append(at)
        self.links += e.tag == "a"

    def close_to(self, k: int) -> None:
        while len(self.open) > k:
            e = self.open.pop()
            self.places[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()
            self.links -= e.tag == "a"


def blocks_of(page: str) -> tuple[list[Block], Paths]:
    """The page's blocks of text in order, each with its element and its root-to-leaf tag path; in time linear in the page's length."""
    paths = Paths()
    root = Element("#", None, paths, "", False, False)
    stack, elements, blocks = Stack(root), [root], []
    block: Block | None = None

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        inner = stack.open[-1]
        if block is None:
            if piece.isspace():
                return
            block = Block(inner.holder, inner.path)
            blocks.append(block)
        if inner.tag not in BLOCK and inner.apart and not block.element.apart:
            return  # an inline part that is no text of the article, such as a button
        block.parts.append(piece)
        if stack.links:
            block.linked += len(piece.strip())

    at = 0
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(references.unescape(page[at:]))
            break
        if m.start() > at:
            text(references.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3])
            continue
        tag = tag.lower()
        if tag == "br":
            if not m["end"] and block is not None:
                block.parts.append(" ")
        elif m["end"]:
            place = stack.last((tag,))
            if tag in BLOCK:
                block = None
            if place and (tag in BLOCK or place > stack.blocks[-1]):
                stack.close_to(place)
        else:
            if tag in BLOCK:
                block = None
                if stack.open[stack.blocks[-1]].tag == "p":  # a block ends an open paragraph
                    stack.close_to(stack.blocks[-1])
                if tag in CLOSES:
                    while (place := stack.last(CLOSES[tag])) > stack.last(HOLDS[tag]):
                        stack.close_to(place)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
                while tag in HEADING and stack.open[-1].tag not in BLOCK and len(stack.open) > 1:
                    stack.close_to(len(stack.open) - 1)
            if tag in VOID or (tag in ("body", "html") and stack.last((tag,))):
                continue
            if tag == "body" and (place := stack.last(("head",))):
                stack.close_to(place)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
                continue
            parent = stack.open[-1]
            label, hidden, named = _attributes(tag, m["attributes"])
            apart = parent.apart or hidden or tag in NEVER
            element = Element(tag, parent, paths, label, apart, named or tag in WEIGHED or (tag == "header" and not parent.inside))
            elements.append(element)
            if tag in ("article", "main", "h1"):
                e: Element | None = parent
                while e is not None and not e.holds:
                    e.holds = True
                    e = e.parent
            if not m["attributes"].rstrip().endswith("/") or tag in BLOCK:
                stack.push(element)
    for e in elements:  # outer ones come first
        named = e.named and not (e.holds or e.tag in ("h1", "main", "article"))
        e.weight = 0.0 if e.apart else min(WEIGHT if named else 1.0, e.parent.weight if e.parent is not None else 1.0)
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        b.weight = b.element.weight
    return [b for b in blocks if b.text], paths


def path_scores(blocks: list[Block], radius: int = 1) -> dict[tuple[int, float], float]:
    """The fused ratio of each tag path and weight; blocks that hold no running text weigh nothing.

    Text length (without link text) and punctuation a node, smoothed in page order by a Gaussian, fused with the path's own ratio, and weighed by
    what the markup and the names around it say.
    """
    sums: dict[tuple[int, float], list[float]] = {}
    for b in blocks:
        s = sums.setdefault((b.path, b.weight), [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += min(b.linked, len(b.text))
    ratio = {p: (chars - linked) / n * (1 + marks / n) if p[1] else 0.0 for p, (n, chars, marks, linked) in sums.items()}
    series = [ratio[b.path, b.weight] for b in blocks]
    weights = [math.exp(-(d * d) / 2) for d in range(-radius, radius + 1)]
    total: dict[tuple[int, float], list[float]] = {}
    for i, b in enumerate(blocks):
        near = [(w, series[i + d]) for d, w in zip(range(-radius, radius + 1), weights, strict=True) if 0 <= i + d < len(series)]
        smooth = sum(w * x for w, x in near) / sum(w for w, _ in near)
        t = total.setdefault((b.path, b.weight), [0.0, 0.0])
        t[0] += math.sqrt(max(series[i], 0.0) * smooth)
        t[1] += 1
    return {p: p[1] * s / n for p, (s, n) in total.items()}


#: A node's score against the page's mean, and its mass against that of the largest node.
LEAST_SCORE, LEAST_MASS = 0.5, 0.2


def content(blocks: list[Block], paths: Paths, scores: dict[tuple[int, float], float]) -> list[Block]:
    """The blocks of the content nodes, which the paths' scores alone choose.

    A node is a path of boxes; its score is the mean of its text's paths by length, and its mass their sum. Nodes that reach half
    the mean of the whole page's text (by length and weight) are content, if they have a fifth of the largest node's mass or stand beside it in one box below the
    body. A list, table or quotation in such a node goes with it; a heading goes with the node that follows it inside its own. Text of
    paths without a score never counts.
    """
    worth = [scores[b.path, b.weight] for b in blocks]
    size = sum(len(b.text) * b.weight for b, w in zip(blocks, worth, strict=True) if w > 0)
    if not size:
        return []
    threshold = LEAST_SCORE * sum(w * len(b.text) * b.weight for b, w in zip(blocks, worth, strict=True)) / size
    label = {k: name.split(".", 1)[0] for (_, name), k in paths.known.items()}
    node = list(range(len(paths.parent)))  # structures belong to the box around them
    for k, above in enumerate(paths.parent):  # outer paths come first
        if k and (label[k] in STRUCTURE or label[k] in LEAF) and label.get(above, "body") not in ("body", "html"):
            node[k] = node[above]
    sums: dict[int, list[float]] = {}
    for b, w in zip(blocks, worth, strict=True):
        if w > 0:
            s = sums.setdefault(node[b.box], [0.0, 0.0])
            s[0] += w * len(b.text)
            s[1] += len(b.text)
    largest = max(sums, key=lambda k: sums[k][0])
    first, last = paths.intervals()
    around = lambda k: label.get(k, "body") not in ("body", "html") and first[k] <= first[largest] <= last[k]
    chosen = {k for k, (mass, chars) in sums.items() if mass >= threshold * chars and (mass >= LEAST_MASS * sums[largest][0] or around(paths.parent[k]))}
    kept: list[Block] = []
    following: Block | None = None  # the next block of the content that is no heading
    for b, w in zip(reversed(blocks), reversed(worth), strict=True):
        heading = b.element.tag in HEADING
        inside = following is not None and first[b.box] <= first[following.box] <= last[b.box]
        if w > 0 and (node[b.box] in chosen or (heading and inside)):
            kept.append(b)
            following = following if heading else b
        elif not heading and w > 0:
            following = None
    return kept[::-1]


def main_text(page: str) -> str:
    """The text of the page's article, one line a block: see path_scores and content."""
    blocks, paths = blocks_of(page)
    return "\n".join(b.text for b in content(blocks, paths, path_scores(blocks))) if blocks else ""


def extract(pages: DataFrame) -> DataFrame:
    """pages with `text`, the main text of each whole html (null html: empty; nothing but markup: empty).

    One pass without a shuffle. Broken and truncated markup is read as far as it goes, very long or deep pages
    in linear time; a page's paths of equal score are chosen or left alike; repeated rows are alike; an empty table gives no
    rows; other columns pass through (one named `text` is replaced).
    """
    names = [c for c in pages.columns if c.lower() != "text"]
    schema = T.StructType([*(pages.schema[c] for c in names), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = arrays.plain(batch.column(batch.schema.get_field_index("html")))
            texts = [main_text(page.as_py()) for page in source]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, type=pa.string())], names=[*names, "text"])

    return pages.mapInArrow(run, schema)


def op3_html(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
