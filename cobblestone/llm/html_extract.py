"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between block-level tags); every block has the path of tags from the root to it. Text
length and punctuation are added up per path, and a path's score fuses its two ratios: characters per block, times one
plus punctuation marks per block. Scores are smoothed over similar paths (a Gaussian of the number of last steps without
which they agree, at most ``REACH``; the paths are a tree, so this is linear in them) and weighted by the share of characters
outside links. A path must reach a share of the best score: ``INSIDE`` of the best one of its content root, such as
``article``, where even short blocks belong to the text and what is nearly all links does not, so that no article hides
another; ``THRESHOLD`` of the best one where a page has no content root. Blocks of such paths are the text, in page order.

Paths through menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by element, role or the words
of class and id) score nothing; comments, scripts, styles and the like are no text at all. Paths outside the content root
score nothing where there is one with text.

Nulls: null html gives an empty text; other columns are passed through. Character references are decoded, runs of white
space become one space, empty blocks vanish, blocks are joined by one newline. One page is one row: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cobblestone.llm.common import map_batches

#: Share of the best smoothed score that a path must reach, without and inside a content root.
THRESHOLD, INSIDE = 0.2, 0.02
REACH = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Za-z0-9]+")
_MARK = re.compile(r"[.,;:!?…。，！？、]")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark meter nobr q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav footer aside form button menu dialog head label".split())
_ROOTS = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes before it, up to the nearest of the second group.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Words of class and id names, fixed values.
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar footer masthead comment comments disqus reply replies discussion cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended"
    " widget toolbar pagination pager search login legal copyright disclaimer".split()
)
_HEADER_WORDS = frozenset("header topbar".split())
_ROOT_WORDS = frozenset("article articlebody content post entry story".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


def _hints(attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """Label, whether it is dropped and whether it names content, from an element's attributes."""
    label, drop, root = "", False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden":
            drop = True
        elif name == "style":
            drop = drop or "display:none" in value.replace(" ", "")
        elif name == "role":
            drop, root = drop or value in _DROP_ROLES, root or value in ("main", "article")
        else:
            for word in value.split():
                parts = _NAME.findall(word)
                if not parts or parts[0] in ("has", "with", "no"):
                    continue
                label = label or "." + word
                drop = drop or not _DROP_WORDS.isdisjoint(parts) or not inside and not _HEADER_WORDS.isdisjoint(parts)
                root = root or not _ROOT_WORDS.isdisjoint(parts)
    return label, drop, root


@dataclass
class Block:
    path: int  # its node in the tree of tag paths
    root: int  # the content root it is in, 0 for none
    text: str
    linked: float  # share of its characters inside links


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page that are not dropped, and the parent of every node of its tree of tag paths.

    Even numbers of a root are content elements, odd ones content by name only.
    """
    out: list[Block] = []
    children: dict[tuple[int, str], int] = {}
    parents = [-1]
    stack: list[tuple[str, int, int]] = []  # tag, node, root
    opened: Counter = Counter()
    roots, pieces, at, link, sizes = 0, [], 0, False, [0, 0]

    def below(label: str) -> int:
        key = (stack[-1][1] if stack else 0, label)
        if key not in children:
            children[key] = len(parents)
            parents.append(key[0])
        return children[key]

    def push(tag: str, label: str, state: int) -> None:
        stack.append((tag, below(label), state))
        opened[tag] += 1

    def cut(first: int) -> None:
        while len(stack) > first:
            opened[stack.pop()[0]] -= 1

    def add(piece: str) -> None:
        pieces.append(piece)
        size = sum(map(len, piece.split()))
        sizes[0] += size
        sizes[1] += size if link else 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            root = stack[-1][2] if stack else 0
            if text and root >= 0:
                linked = sizes[1] / max(sizes[0], 1)
                # blocks that are mostly links are a path of their own
                out.append(Block(below("links") if 2 * linked > 1 else stack[-1][1] if stack else 0, root, text, linked))
            pieces.clear()
            sizes[:] = 0, 0

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = token[3] or token[6]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), token[2] or token[5], token[4] or token[7] or ""
        if tag == "a":
            link = not closing
        if closing:
            if opened[tag]:
                flush()
                while stack[-1][0] != tag:
                    cut(len(stack) - 1)
                cut(len(stack) - 1)
            elif tag not in _INLINE:
                flush()
            continue
        state = stack[-1][2] if stack else 0
        label, drop, root = _hints(attributes, state > 0) if attributes.strip() else ("", False, False)
        if tag in _INLINE:
            if tag == "br" or tag in _VOID:
                pieces.append(" " if tag == "br" else "")
            elif drop or tag == "button" or tag == "label":
                flush()
                push(tag, tag + label, -1)
            continue
        flush()
        if tag in _VOID:
            continue
        while stack and stack[-1][0] in _INLINE:
            cut(len(stack) - 1)
        if opened["p"]:
            i = len(stack) - 1
            while stack[i][0] not in ("p", "td", "th", "li", "button"):
                i -= 1
            if stack[i][0] == "p":
                while i and stack[i - 1][0] == "p":
                    i -= 1
                cut(i)
        if tag in _CLOSES:
            shut, stop = _CLOSES[tag]
            if any(opened[t] for t in shut):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stop:
                        break
                    if stack[i][0] in shut:
                        cut(i)
                        break
        state = stack[-1][2] if stack else 0
        if state >= 0 and tag not in ("html", "body"):
            if tag in _DROP or drop and tag not in _ROOTS or tag == "header" and state == 0:
                state = -1
            elif tag in _ROOTS:
                if state == 0:
                    roots += 2
                    state = roots  # even: a content element
            elif root and state == 0 and tag not in _HEADINGS:
                roots += 2
                state = roots + 1  # odd: content by name only
        push(tag, tag + label, state)
    if at < len(page):
        add(page[at:])
    flush()
    return out, parents


def path_scores(found: list[Block], parents: list[int]) -> dict[tuple[int, int], float]:
    """(path, root) -> score: characters per block times one plus punctuation marks per block, smoothed over the paths that
    share all but the last ``REACH`` steps or fewer (of one root only), times the share of characters outside links."""
    sums: dict[tuple[int, int], list] = {}
    for b in found:
        total = sums.setdefault((b.path, b.root), [0, 0, 0, 0.0])
        total[0] += len(b.text)
        total[1] += len(_MARK.findall(b.text))
        total[2] += 1
        total[3] += b.linked * len(b.text)
    ratio = {key: size / n * (1 + marks / n) for key, (size, marks, n, _) in sums.items()}
    trunks: dict[tuple[int, int, int], list] = {}  # paths by what is left of them without their last steps

    def above(path: int) -> Iterator[tuple[int, int]]:
        for k in range(REACH + 1):
            if path < 0:
                return
            yield k, path
            path = parents[path]

    for (path, root), value in ratio.items():
        for _, trunk in above(path):
            total = trunks.setdefault((trunk, root), [0.0, 0])
            total[0] += value
            total[1] += 1
    out = {}
    for path, root in ratio:
        value = weight = 0.0
        for k, trunk in above(path):
            total, n = trunks[trunk, root]
            value += exp(-(k**2) / 2) * total / n
            weight += exp(-(k**2) / 2)
        size, _, _, linked = sums[path, root]
        out[path, root] = value / weight * (1 - linked / size)
    return out


def content(page: str | None, threshold: float = THRESHOLD, inside: float = INSIDE) -> str:
    found, parents = blocks(page or "")
    # elements made for content come before names that suggest it
    for group in ([b for b in found if b.root and b.root % 2 == 0], [b for b in found if b.root]):
        if group:
            found = group
            break
    scores = path_scores(found, parents)
    best: dict[int, float] = {}
    for (_, root), value in scores.items():
        best[root] = max(best.get(root, 0.0), value)
    return "\n".join(b.text for b in found if scores[b.path, b.root] >= (inside if b.root else threshold) * best[b.root])


def extract(pages: DataFrame, page: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars``."""
    rest = [f for f in pages.schema.fields if f.name not in (page, "text", "n_chars")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [content(x.as_py(), threshold) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [f.name for f in rest] + ["text", "n_chars"],
        )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "text string, n_chars bigint"
    return map_batches(pages.select(F.col(page).alias("_html"), *(F.col(f"`{f.name}`") for f in rest)), run, schema)
