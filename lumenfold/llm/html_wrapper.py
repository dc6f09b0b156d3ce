"""Main text of web pages by wrapper induction.

Pages of a host share a template. Every page is parsed into an outline, the tree of its
elements that hold blocks of text; menus, notices and the like are no part of it. A layout is
the set of a page's outer containers. A host's reference is the smallest outline of its most
common layout (of equals that of the smallest hash), and each page of the host is aligned to it by
simple tree matching: parents are paired before children, children in order, so that most
nodes are paired, like labels (tag, class and id, digits left out) counting twice. Elements of one tag
whose labels differ are paired where their children mostly are. What has no partner lies, by its
label, below its parent's partner. So each block has a place in the reference.

Counts by host, layout, place and hash of the text are aggregated in Spark over all distinct
pages. A text that `SHARE` of the pages with its place repeat there is a constant node, template, within a
layout or within the host; other texts are slots. The lowest container that holds most
characters of the slots is the content: of the layout if it has `LAYOUT_PAGES` pages, else of the host.

Extraction aligns every page again and takes all blocks within the content, in page order, without
the template's texts. The article and main elements are hints: text inside needs `LAYOUT_PAGES`
pages to be template, and where no content is known or it is not on the page (hosts with a single page,
rare layouts), all articles are taken, else all main elements, else the body. Elements that by tag, role or
name are no article text are left out, and no slots.

No page is sampled and no child is left out; wrappers are a table joined by host and layout,
never gathered on the driver. A wrapper holds one reference, and at most one text for each place and level.

Defined results: null and empty pages give an empty text; so do pages without any. A null or odd
url is a host of its own kind (an empty name). A host with one page, or whose pages are all the same, has
no template. Where the template would leave nothing of a page, it is not applied. Repeated rows give repeated results. Broken markup is read as browsers do in
the main: ends may be missing, stray ends are ignored. Other columns pass through `extract`.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("body caption html legend li summary tbody td tfoot th thead tr dd dt".split())
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
HOLDS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "thead": "table", "tbody": "table", "tfoot": "table"}
#: Elements, roles and words in a class or id that mark what is no article text.
SKIP_TAGS = frozenset("head script style noscript nav footer aside form button select textarea input iframe svg template menu dialog object canvas audio video map".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SKIP_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
CONTAINERS = frozenset("body div section td article main".split())
VARIES = re.compile(r"[0-9/\s]+")
#: Of the pages with a path so many repeat a template's text, two at least (within articles, and by layout, LAYOUT_PAGES).
SHARE, LAYOUT_PAGES = 0.8, 4
#: Of the slots' characters so many are in the content's place.
MOST = 0.7
#: Elements nested deeper than this have the place of the one at this depth.
DEEP = 40
#: Elements of one tag and other labels are partners if so much of both lies below in partners.
ALIKE = 0.5
#: Longer runs of containers with one label share a place, as runs of elements without children always do.
RUN = 8


class Node:
    __slots__ = ("tag", "label", "kids", "skip")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.label, self.kids, self.skip = tag, tag, [], tag in SKIP_TAGS
        if attributes and attributes.strip(" /"):
            got = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
            names = f"{got.get('class', '')} {got.get('id', '')}".split()
            self.label = ".".join([tag, *names])
            if tag not in ("html", "body", "article", "main"):
                words = {w.lower() for x in names for w in WORD.findall(x)} | {x.lower() for x in names}
                self.skip |= bool(words & SKIP_WORDS) or got.get("role", "").lower() in SKIP_ROLES
            elif tag == "article":
                self.skip |= bool({w.lower() for x in names for w in WORD.findall(x)} & {"comment", "comments", "reply", "replies", "related"})
            if got.get("role", "").lower() == "main":
                self.tag = "main"
            self.skip |= "hidden" in got or got.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", got.get("style", "")))


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and strings (character references decoded)."""
    root = Node("html")
    stack, at, last = [root], 0, page.rfind(">") + 1

    def put(text: str) -> None:
        if text:
            stack[-1].kids.append(html.unescape(text) if "&" in text else text)

    def close(tags: str, within: str) -> None:
        """End the nearest open element of these tags, unless a holder is nearer."""
        ends, holders = tags.split(), within.split()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                del stack[k:]
                return
            if stack[k].tag in holders:
                return

    while at < last:
        m = TAG.search(page, at, last)
        if not m:
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body":
                stack[:] = stack[:1]
            elif len(stack) == 1:
                continue
        if tag in ENDS_P:
            close("p", "article main section div table td th li blockquote button")
        if tag in ENDS:
            close(ENDS[tag], HOLDS[tag])
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 if end else last
            at = at or last
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    put(page[max(at, last) :])
    return root


def _name(node: Node) -> str:
    return VARIES.sub("#", node.label)


class Outline:
    """The elements of a page that hold blocks, parents first: parents' numbers and labels. The root is number 0."""

    __slots__ = ("parents", "labels", "_kids", "_sizes", "_shapes")

    def __init__(self, parents: list[int] | None = None, labels: list[str] | None = None) -> None:
        self.parents, self.labels, self._kids, self._sizes, self._shapes = parents or [-1], labels or ["html"], None, None, None

    def add(self, parent: int, label: str) -> int:
        self.parents.append(parent)
        self.labels.append(label)
        return len(self.labels) - 1

    def kids(self, n: int) -> list[list[int]]:
        """The children of a node in order, as runs of like ones."""
        if self._kids is None:
            below: list[list[int]] = [[] for _ in self.labels]
            for i, p in enumerate(self.parents[1:], 1):
                below[p].append(i)
            self._kids = [self._runs(ks, below) for ks in below]
        return self._kids[n]

    def _runs(self, kids: list[int], below: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in kids:
            if out and self.labels[out[-1][0]] == self.labels[k] and bool(below[out[-1][0]]) == bool(below[k]):
                out[-1].append(k)
            else:
                out.append([k])
        return [part for run in out for part in ([[k] for k in run] if below[run[0]] and len(run) <= RUN else [run])]

    def size(self, n: int) -> int:
        """Runs at and below a node."""
        if self._sizes is None:
            self._sizes = [1] * len(self.labels)
            for i in range(len(self.labels) - 1, -1, -1):
                self._sizes[i] += sum(self._sizes[run[0]] for run in self.kids(i))
        return self._sizes[n]

    def shape(self, n: int) -> int:
        """A number that nodes share below which labels and runs are the same, down to the last."""
        if self._shapes is None:
            numbers: dict[tuple, int] = {}
            self._shapes = [0] * len(self.labels)
            for i in range(len(self.labels) - 1, -1, -1):
                below = tuple((self.labels[run[0]], self._shapes[run[0]]) for run in self.kids(i))
                self._shapes[i] = numbers.setdefault(below, len(numbers))
        return self._shapes[n]


def outlined(root: Node) -> tuple[Outline, list[tuple[int, bool, str]]]:
    """The outline below a node and its blocks: (element's number, inside an article or main, text), without what is to be skipped."""
    outline, found, line = Outline(), [], []
    inside = root.tag in ("article", "main")
    todo: list = [(None, 0, 1, inside), *[(k, 0, 1, inside) for k in reversed(root.kids)]]
    while todo:
        item, at, depth, inside = todo.pop()
        if isinstance(item, str):
            line.append(item)
            continue
        if item is not None and item.tag == "br":
            line.append(" ")
            continue
        skipped = item is not None and (item.skip or item.tag == "header" and not inside)
        block = item is None or item.tag in BLOCKS
        if block:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                found.append((at, inside, text))
        if item is None or skipped:
            continue
        # what ends a block has the block's place, as has the text before a block within it
        within = inside or item.tag in ("article", "main")
        below, deeper = (outline.add(at, _name(item)) if depth < DEEP else at, depth + 1) if block else (at, depth)
        if block:
            todo.append((None, below, deeper, within))
        todo += [(k, below, deeper, within) for k in reversed(item.kids)]
    return outline, found


def blocks(root: Node) -> list[str]:
    """The texts of the blocks below a node, without what is to be skipped."""
    return [text for _, _, text in outlined(root)[1]]


def mark(text: str) -> int:
    """64 bits that stand for a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def layout(root: Node) -> int:
    """64 bits that stand for the set of a page's outer containers (down to the second below the body)."""
    found, todo = set(), [(root, "html", 1)]
    while todo:
        node, path, depth = todo.pop()
        for k in node.kids:
            if isinstance(k, Node) and not k.skip and k.tag in CONTAINERS and depth < 4:
                below = f"{path}/{_name(k)}"
                found.add(below)
                todo.append((k, below, depth + 1))
    return mark("\n".join(sorted(found)))


def _tag(label: str) -> str:
    return label.partition(".")[0]


def tree_matching(a: Outline, b: Outline, x: int = 0, y: int = 0, known: dict | None = None) -> tuple[int, list[tuple[list[int], list[int]]]]:
    """Simple tree matching of the elements x and y: the most nodes (runs) in partners, and the partners below them, as runs.

    A pair of like labels counts 2, one of the same tag alone 1 (and only if its children are ALIKE).
    """
    known = {} if known is None else known
    if (x, y) in known:
        return known[x, y]
    one, other = a.labels[x], b.labels[y]
    left, right = a.kids(x), b.kids(y)
    if _tag(one) != _tag(other) or one != other and not (left and right):
        known[x, y] = 0, []
        return known[x, y]
    pairs, score = [], 0
    first, ends, last = 0, (len(left), len(right)), 0
    while first < min(ends) and _same(a, b, left[first], right[first]):
        first += 1
    while last < min(ends) - first and _same(a, b, left[-1 - last], right[-1 - last]):
        last += 1
    # what is equal at both ends is paired there: no pairing of more nodes is lost by it
    for l, r in [*zip(left[:first], right[:first], strict=True), *zip(left[ends[0] - last :], right[ends[1] - last :], strict=True)]:
        got = tree_matching(a, b, l[0], r[0], known)
        score += got[0]
        pairs += [(l, r), *got[1]]
    left, right = left[first : ends[0] - last], right[first : ends[1] - last]
    for l, r, got in _in_order(a, b, left, right, known):
        score += got[0]
        pairs += [(l, r), *got[1]]
    if one != other and score < ALIKE * (max(a.size(x), b.size(y)) - 1) * 2:
        known[x, y] = 0, []
    else:
        known[x, y] = score + (2 if one == other else 1), pairs
    return known[x, y]


def _same(a: Outline, b: Outline, l: list[int], r: list[int]) -> bool:
    """Whether two runs have the same labels at and below their first elements."""
    todo = [(l[0], r[0])]
    while todo:
        x, y = todo.pop()
        if a.labels[x] != b.labels[y] or len(a.kids(x)) != len(b.kids(y)):
            return False
        todo += [(k[0], m[0]) for k, m in zip(a.kids(x), b.kids(y), strict=True)]
    return True


def _in_order(a: Outline, b: Outline, left: list[list[int]], right: list[list[int]], known: dict) -> list[tuple]:
    """The pairs of two lists of runs, in order, that put most nodes in partners, each with its own matching.

    One rule for lists of any length. Of the table of best sums only some rows are kept; those between are worked out again on the way back.
    """
    if not left or not right:
        return []
    weights = _weights(a, b, left, right, known)
    every = math.isqrt(len(left))

    def after(best: np.ndarray, i: int) -> np.ndarray:
        return np.concatenate([[0], np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weights(i)))])

    kept, row = [np.zeros(len(right) + 1, dtype=np.int64)], np.zeros(len(right) + 1, dtype=np.int64)
    for i in range(len(left)):
        row = after(row, i)
        if (i + 1) % every == 0:
            kept.append(row)
    out, i, j = [], len(left), len(right)
    while i and j:
        start = (i - 1) // every * every
        best = [kept[start // every]]
        for n in range(start, i):
            best.append(after(best[-1], n))
        while i > start and j:
            if best[i - start][j] == best[i - start - 1][j]:
                i -= 1
            elif best[i - start][j] == best[i - start][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((left[i], right[j], tree_matching(a, b, left[i][0], right[j][0], known)))
    return out[::-1]


def _weights(a: Outline, b: Outline, left: list[list[int]], right: list[list[int]], known: dict) -> Callable[[int], np.ndarray]:
    """A function of a run's place on the left: its nodes in partners with each run on the right.

    Of runs of one shape below one is scored, for like labels and for others; those that can't be partners are not.
    """
    same: dict[str, dict[int, list[int]]] = {}
    others: dict[str, dict[int, list[int]]] = {}
    for n, (y, *_) in enumerate(right):
        same.setdefault(b.labels[y], {}).setdefault(b.shape(y), []).append(n)
        if b.kids(y):
            others.setdefault(_tag(b.labels[y]), {}).setdefault(b.shape(y), []).append(n)
    places = {name: {shape: np.array(ns) for shape, ns in shapes.items()} for name, shapes in others.items()}
    scored: dict[tuple[str, int, int], int] = {}

    def of(i: int) -> np.ndarray:
        x, row = left[i][0], np.zeros(len(right), dtype=np.int64)
        label, tag = a.labels[x], _tag(a.labels[x])
        for shape, ns in places.get(tag, {}).items() if a.kids(x) else ():
            key = tag, a.shape(x), shape
            if key not in scored:
                y = next((right[n][0] for n in ns.tolist() if b.labels[right[n][0]] != label), None)
                if y is None:
                    continue  # all have its label
                scored[key] = tree_matching(a, b, x, y, known)[0]
            row[ns] = scored[key]
        for ns in same.get(label, {}).values():
            row[ns] = tree_matching(a, b, x, right[ns[0]][0], known)[0]
        return row

    return of


def places(reference: Outline, page: Outline) -> list[str]:
    """For each element of a page its place in the reference: names from the root, of partners with the number in the reference."""
    partner = {0: 0}
    todo = [(runs[0], runs[1]) for runs in tree_matching(reference, page)[1]]
    for theirs, own in todo:
        partner |= dict.fromkeys(own, theirs[0])
    out: list[str] = []
    for n, (parent, label) in enumerate(zip(page.parents, page.labels, strict=True)):
        got = partner.get(n)
        name = label if got is None else f"{reference.labels[got]}@{got}"
        out.append(name if n == 0 else f"{out[parent]}/{name}")
    return out


def _outermost(root: Node, tag: str) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        if node.tag == tag:
            found.append(node)
        else:
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return found


def decided_text(page: str | None, wrapper: dict | None = None) -> tuple[str, bool]:
    """The article's text, a line for each block, and whether the wrapper's place gave it."""
    if not page:
        return "", False
    root = parse(page)
    outline, found = outlined(root)
    wrapper = wrapper or {}
    template = {(x["path"], x["text"]) for x in wrapper.get("template") or ()}
    place, reference = wrapper.get("place"), wrapper.get("reference")
    where = places(reference, outline) if reference else outline.labels
    fresh = [(where[n], text) for n, _, text in found if not template or (where[n], mark(text)) not in template]
    if place and (kept := [text for path, text in fresh if path == place or path.startswith(place + "/")]):
        return "\n".join(kept), True
    for tag in ("article", "main"):
        if texts := [text for node in _outermost(root, tag) for text in blocks(node)]:
            return "\n".join(texts), False
    return "\n".join([text for _, text in fresh] or [text for _, _, text in found]), False


def main_text(page: str | None, wrapper: dict | None = None) -> str:
    """The article's text, a line for each block."""
    return decided_text(page, wrapper)[0]


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))


def wrapper_of(told: str | None) -> dict:
    """A wrapper from its JSON text."""
    found = json.loads(told) if told else {}
    if found.get("reference"):
        found["reference"] = Outline(*json.loads(found["reference"]))
    return found


_SEEN = pa.schema([("_host", pa.string()), ("_mark", pa.int64()), ("_layout", pa.int64()), ("outline", pa.string()), ("size", pa.int64()), ("blocks", pa.list_(pa.struct([("node", pa.int32()), ("inside", pa.bool_()), ("text", pa.int64()), ("chars", pa.int64())])))])


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its layout, outline and the hashes of its blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for name, page_mark, page in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                root = parse(page)
                outline, found = outlined(root)
                told = [{"node": n, "inside": inside, "text": mark(text), "chars": len(text)} for n, inside, text in found]
                out.append({"_host": name, "_mark": page_mark, "_layout": layout(root), "outline": json.dumps([outline.parents, outline.labels]), "size": len(outline.labels), "blocks": told})
            yield pa.RecordBatch.from_pylist(out, schema=_SEEN)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page one row for each place (without a text) and for each place and text."""
    known: dict[str, Outline] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(at, 256).to_pylist():
                if r["reference"] not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[r["reference"]] = Outline(*json.loads(r["reference"]))
                where = places(known[r["reference"]], Outline(*json.loads(r["outline"])))
                seen: dict = {("html", False, None): 0}
                for b in r["blocks"]:
                    key = where[b["node"]], b["inside"]
                    seen[*key, None] = 0
                    seen[*key, b["text"]] = seen.get((*key, b["text"]), 0) + b["chars"]
                out += [(r["_host"], r["_layout"], path, inside, text, r["_mark"], n) for (path, inside, text), n in seen.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(_NODES.names, x, strict=True)) for x in out], schema=_NODES)


_NODES = pa.schema([("_host", pa.string()), ("_layout", pa.int64()), ("path", pa.string()), ("inside", pa.bool_()), ("text", pa.int64()), ("_mark", pa.int64()), ("chars", pa.int64())])


def references(seen: DataFrame) -> DataFrame:
    """_host and reference: the smallest outline of its most common layout."""
    by_layout = seen.groupBy("_host", "_layout").agg(F.count("*").alias("n"), F.min_by("outline", F.struct("size", "_mark")).alias("outline"))
    return by_layout.groupBy("_host").agg(F.max_by("outline", F.struct("n", "_layout")).alias("reference"))


def _places(slots: DataFrame, keys: list[str]) -> DataFrame:
    """keys and place: the lowest container with most of the slots' characters."""
    names = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    held = slots.select(*keys, "chars", F.explode(prefixes).alias("place")).groupBy(*keys, "place").agg(F.sum("chars").alias("chars"))
    total = slots.groupBy(*keys).agg(F.sum("chars").alias("total"))
    fit = held.where(F.col("place").rlike(rf"/({'|'.join(sorted(CONTAINERS))})([.@][^/]*)?$")).join(total, keys).where(F.col("chars") >= MOST * F.col("total"))
    return fit.groupBy(*keys).agg(F.max_by("place", F.size(F.split("place", "/"))).alias("place"))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """_host, _layout and _wrapper (JSON: place, template, reference) of each layout of a host, from all its pages."""
    rows = pages.where(F.length(html_col) > 0).select(host(pages[url_col]).alias("_host"), F.xxhash64(pages[html_col]).alias("_mark"), pages[html_col].alias("_html"))
    seen = materialize(rows.mapInArrow(_outlines, "_host string, _mark long, _layout long, outline string, size long, blocks array<struct<node int, inside boolean, text long, chars long>>"), "outlines")
    reference = materialize(references(seen), "references")
    aligned = seen.drop("size").join(reference, "_host")
    nodes = aligned.mapInArrow(_texts, "_host string, _layout long, path string, inside boolean, text long, _mark long, chars long")
    keys, where = ["_host", "_layout"], ["path", "inside"]
    # repeated pages count once
    counts = nodes.dropDuplicates([*keys, *where, "text", "_mark"]).groupBy(*keys, *where, "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    counts = materialize(counts, "texts")
    paths, texts = counts.where("text IS NULL").drop("text", "chars"), counts.where("text IS NOT NULL")

    def repeated(by: list[str], least: Column) -> DataFrame:
        """by, path and text of what is template by these counts."""
        often = texts.groupBy(*by, *where, "text").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        of = paths.groupBy(*by, *where).agg(F.sum("n").alias("pages"))
        return often.join(of, [*by, *where]).where(F.col("n") >= SHARE * F.col("pages")).select(*by, *where, "text")

    of_host = repeated(["_host"], F.when(F.col("inside"), LAYOUT_PAGES).otherwise(2))
    of_layout = repeated(keys, F.lit(LAYOUT_PAGES))
    known = texts.join(of_host, ["_host", *where, "text"], "left_semi").select(*keys, *where, "text")
    template = materialize(known.unionByName(of_layout).distinct(), "template")
    slots = texts.join(template, [*keys, *where, "text"], "left_anti").groupBy(*keys, "path").agg(F.sum("chars").alias("chars"))
    slots = materialize(slots, "slots")
    kinds = paths.where("path = 'html' AND NOT inside").select(*keys, F.col("n").alias("pages"))
    hosts = kinds.groupBy("_host").agg(F.sum("pages").alias("of_host"))
    own = _places(slots, keys).withColumnRenamed("place", "own")
    shared = _places(slots, ["_host"]).withColumnRenamed("place", "shared")
    place = F.when(F.col("of_host") > 1, F.when(F.col("pages") >= LAYOUT_PAGES, F.coalesce("own", "shared")).otherwise(F.col("shared")))
    listed = template.groupBy(*keys).agg(F.collect_set(F.struct("path", "text")).alias("template"))
    out = kinds.join(hosts, "_host").join(own, keys, "left").join(shared, "_host", "left").join(listed, keys, "left").join(reference, "_host")
    return out.select(*keys, F.to_json(F.struct(place.alias("place"), "template", "reference")).alias("_wrapper"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """pages with out_col, the main text of each."""
    found = materialize(wrappers(pages, url_col, html_col), "wrappers")

    @F.pandas_udf("long")
    def layouts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in batches:
            yield pd.Series([layout(parse(p or "")) for p in page], dtype="int64")

    row = F.struct(*[pages[c].alias(f"c{i}") for i, c in enumerate(pages.columns)])  # no name of pages can clash
    named = pages.select(row.alias("row"), host(pages[url_col]).alias("of_host"), layouts(pages[html_col]).alias("of_layout"))
    joined = named.join(found, (F.col("of_host") == F.col("_host")) & (F.col("of_layout") == F.col("_layout")), "left")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict = {}
        for page, wrapper in batches:
            out = []
            for p, w in zip(page, wrapper, strict=True):
                if w not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[w] = wrapper_of(w)
                out.append(main_text(p, known[w]))
            yield pd.Series(out, dtype=object)

    text = run(F.col(f"row.c{pages.columns.index(html_col)}"), F.col("_wrapper"))
    cols = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(pages.columns) if c != out_col]
    return joined.select(*cols, text.alias(out_col))
