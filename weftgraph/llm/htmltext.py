"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into blocks at block-level tags; a block is described by its word count and link density, those of its
neighbours, and what it lies in (an article, a menu, a footer, ...).  A small decision tree, trained on the labelled
table below when the job starts, tells content from the rest.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrow import map_columns, picked

#: Attributes: a value in quotes begins behind an equals sign only; quotes elsewhere are plain characters.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>|<[!?][^>]*+>""", re.S)
_HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MAIN_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?main\b""", re.I)
# Elements and words of class names.
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_SKIPPED = frozenset("script style noscript template svg iframe textarea select button object canvas".split())
_RAW = frozenset("script style noscript iframe textarea title".split())  # what stands in them is no markup
_HEAD = frozenset("title script style noscript template meta link base".split())  # any other start tag ends an open head
_IN_SELECT = frozenset("option legend hr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = frozenset("nav footer aside header form menu dialog fieldset".split())
_INSIDE = frozenset("article main".split())
_UNNAMED = frozenset("html body main article".split())  # their names never put them outside
_AFTER = "comments?\\w*|repl(?:y|ies)|disqus|related|recommend\\w*|more[-_](?:stories|articles|posts|news|from)"
#: A name that only says that there is such a thing (has-sidebar), or whose header it is (post-header), is not meant.
_BAD_NAME = re.compile(rf"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bno[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?<!\bshow[_-])(?:(?<!\bpost[_-])(?<!\barticle[_-])(?<!\bentry[_-])(?<!\bstory[_-])header|ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|side-?bar\w*|footer|masthead|breadcrumbs?|{_AFTER}|cookies?\w*|consent|gdpr\w*|paywall\w*|(?:author[-_])?bio|notices?|alert|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|widget\w*|copyright|legal|pag(?:er|ination)|search\w*|form\w*|tags?|toolbar)(?:$|[\s_-])", re.I)
_AFTER_NAME = re.compile(rf"(?:^|[\s_-])(?:{_AFTER})(?:$|[\s_-])", re.I)  # these hold articles of their own
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|story|entry|text|body)(?:$|[\s_-])", re.I)
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "inside", "outside", "list_item")

#: Labelled blocks in the order of FEATURES, and whether they are main text.
LABELLED = (
    ((60, 0.00, 40, 0.00, 55, 0.00, 1, 0, 0), 1),
    ((3, 0.00, 40, 0.00, 55, 0.00, 1, 0, 0), 1),
    ((1, 0.00, 0, 0.00, 30, 0.00, 1, 0, 0), 1),
    ((9, 0.00, 12, 0.00, 30, 0.00, 1, 0, 0), 1),
    ((12, 0.25, 60, 0.00, 50, 0.10, 1, 0, 0), 1),
    ((120, 0.05, 1, 1.00, 80, 0.00, 1, 0, 0), 1),
    ((2, 0.00, 2, 0.00, 2, 0.00, 1, 0, 0), 1),
    ((6, 0.00, 8, 0.00, 7, 0.00, 1, 0, 1), 1),
    ((14, 0.10, 12, 0.00, 20, 0.00, 1, 0, 1), 1),
    ((2, 1.00, 60, 0.00, 40, 0.00, 1, 0, 0), 1),
    ((30, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0), 1),
    ((80, 0.02, 70, 0.00, 90, 0.00, 0, 0, 0), 1),
    ((45, 0.00, 50, 0.00, 3, 1.00, 0, 0, 0), 1),
    ((25, 0.10, 40, 0.05, 60, 0.00, 0, 0, 0), 1),
    ((7, 0.00, 60, 0.00, 70, 0.00, 0, 0, 0), 1),
    ((35, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0), 1),
    ((150, 0.15, 5, 0.80, 5, 0.80, 0, 0, 0), 1),
    ((16, 0.00, 30, 0.00, 45, 0.00, 0, 0, 1), 1),
    ((1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 1), 0),
    ((2, 1.00, 0, 0.00, 1, 1.00, 0, 1, 1), 0),
    ((9, 0.00, 1, 1.00, 11, 0.00, 0, 1, 0), 0),
    ((12, 0.00, 70, 0.00, 0, 0.00, 0, 1, 0), 0),
    ((40, 0.00, 60, 0.00, 50, 0.00, 1, 1, 0), 0),
    ((90, 0.05, 80, 0.00, 20, 0.00, 0, 1, 0), 0),
    ((18, 0.00, 40, 0.00, 16, 0.00, 1, 1, 0), 0),
    ((25, 0.00, 60, 0.00, 22, 0.00, 0, 1, 1), 0),
    ((5, 0.00, 4, 0.00, 60, 0.00, 1, 1, 0), 0),
    ((3, 0.00, 90, 0.00, 70, 0.00, 0, 1, 0), 0),
    ((1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1), 0),
    ((3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 1), 0),
    ((4, 0.90, 30, 0.00, 3, 1.00, 0, 0, 0), 0),
    ((6, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0), 0),
    ((10, 0.70, 4, 0.60, 9, 0.80, 0, 0, 0), 0),
    ((3, 0.00, 1, 1.00, 0, 0.00, 0, 0, 0), 0),
    ((22, 0.80, 18, 0.90, 25, 0.70, 0, 0, 0), 0),
    ((8, 0.50, 3, 1.00, 6, 0.60, 0, 0, 0), 0),
    # Articles: linked paragraphs, what stands beside them, lists of links, captions, single words.
    ((20, 1.00, 60, 0.00, 40, 0.00, 1, 0, 0), 1),
    ((12, 1.00, 50, 0.00, 0, 0.00, 1, 0, 0), 1),
    ((40, 0.00, 25, 1.00, 0, 0.00, 1, 0, 0), 1),
    ((30, 0.00, 12, 0.80, 60, 0.00, 1, 0, 0), 1),
    ((55, 0.60, 20, 0.90, 30, 0.70, 1, 0, 0), 1),
    ((3, 1.00, 2, 1.00, 4, 1.00, 1, 0, 1), 1),
    ((1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 1), 1),
    ((9, 0.50, 3, 1.00, 2, 1.00, 1, 0, 1), 1),
    ((4, 0.00, 3, 1.00, 2, 1.00, 1, 0, 0), 1),
    ((1, 0.00, 80, 0.00, 90, 0.00, 1, 0, 0), 1),
    ((1, 1.00, 70, 0.00, 0, 0.00, 1, 0, 0), 1),
    ((5, 0.00, 0, 0.00, 1, 1.00, 1, 0, 0), 1),
    ((200, 0.00, 5, 1.00, 180, 0.00, 1, 0, 0), 1),
    ((15, 0.70, 0, 0.00, 20, 0.00, 1, 0, 0), 1),
    # No article around: paragraphs and their headings.
    ((110, 0.00, 95, 0.00, 130, 0.00, 0, 0, 0), 1),
    ((65, 0.10, 3, 1.00, 2, 1.00, 0, 0, 0), 1),
    ((48, 0.00, 1, 1.00, 55, 0.00, 0, 0, 0), 1),
    ((75, 0.00, 80, 0.00, 1, 1.00, 0, 0, 0), 1),
    ((30, 0.00, 45, 0.00, 0, 0.00, 0, 0, 0), 1),
    ((28, 0.20, 33, 0.00, 41, 0.10, 0, 0, 0), 1),
    ((8, 0.00, 0, 0.00, 60, 0.00, 0, 0, 0), 1),
    ((4, 0.00, 2, 1.00, 75, 0.00, 0, 0, 0), 1),
    ((6, 0.00, 50, 0.00, 44, 0.00, 0, 0, 0), 1),
    ((3, 0.00, 85, 0.00, 66, 0.00, 0, 0, 0), 1),
    ((22, 0.00, 6, 0.00, 58, 0.00, 0, 0, 0), 1),
    ((18, 0.10, 40, 0.00, 35, 0.00, 0, 0, 1), 1),
    ((24, 0.00, 26, 0.00, 21, 0.00, 0, 0, 1), 1),
    ((90, 0.30, 70, 0.00, 60, 0.20, 0, 0, 0), 1),
    # No article around: links and short lines beside paragraphs or other links.
    ((1, 1.00, 60, 0.00, 0, 0.00, 0, 0, 0), 0),
    ((1, 1.00, 45, 0.00, 1, 1.00, 0, 0, 0), 0),
    ((2, 1.00, 70, 0.00, 55, 0.00, 0, 0, 0), 0),
    ((3, 1.00, 0, 0.00, 80, 0.00, 0, 0, 0), 0),
    ((5, 1.00, 90, 0.00, 3, 0.00, 0, 0, 0), 0),
    ((2, 1.00, 1, 1.00, 65, 0.00, 0, 0, 1), 0),
    ((12, 1.00, 50, 0.00, 10, 1.00, 0, 0, 0), 0),
    ((9, 0.80, 12, 0.90, 48, 0.00, 0, 0, 0), 0),
    ((2, 0.00, 60, 0.00, 1, 1.00, 0, 0, 0), 0),
    ((4, 0.00, 1, 1.00, 2, 1.00, 0, 0, 0), 0),
    ((5, 0.00, 3, 1.00, 0, 0.00, 0, 0, 0), 0),
    ((7, 0.40, 60, 0.00, 2, 1.00, 0, 0, 0), 0),
    ((14, 0.90, 4, 1.00, 3, 1.00, 0, 0, 0), 0),
    ((2, 0.00, 2, 0.00, 1, 1.00, 0, 0, 1), 0),
    # Articles: blocks of any length between links.
    ((11, 0.00, 3, 1.00, 0, 0.00, 1, 0, 0), 1),
    ((7, 0.00, 1, 1.00, 9, 1.00, 1, 0, 1), 1),
    ((2, 0.00, 8, 1.00, 1, 1.00, 1, 0, 0), 1),
    ((19, 0.10, 2, 1.00, 12, 1.00, 1, 0, 0), 1),
    ((5, 0.00, 40, 0.00, 6, 1.00, 1, 0, 0), 1),
    ((33, 0.00, 4, 1.00, 2, 1.00, 1, 0, 0), 1),
    ((14, 0.00, 30, 0.20, 3, 1.00, 1, 0, 1), 1),
    ((8, 1.00, 16, 1.00, 22, 0.00, 1, 0, 0), 1),
    ((2, 0.80, 5, 0.00, 3, 1.00, 1, 0, 1), 1),
    ((26, 0.90, 7, 1.00, 7, 1.00, 1, 0, 0), 1),
    # No article around: short blocks whose neighbours have no links either, and a short end of a long text.
    ((1, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0), 1),
    ((2, 0.00, 0, 0.00, 3, 0.00, 0, 0, 0), 1),
    ((3, 0.00, 2, 0.00, 3, 0.00, 0, 0, 0), 1),
    ((3, 0.00, 3, 0.00, 0, 0.00, 0, 0, 0), 1),
    ((5, 0.00, 6, 0.00, 4, 0.00, 0, 0, 0), 1),
    ((2, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0), 1),
    ((1, 0.00, 30, 0.00, 0, 0.00, 0, 0, 0), 1),
    ((4, 0.00, 45, 0.00, 5, 0.00, 0, 0, 0), 1),
    ((6, 0.00, 10, 0.00, 8, 0.00, 0, 0, 1), 1),
    ((2, 0.00, 3, 0.00, 2, 0.00, 0, 0, 1), 1),
    # Beside the main text: of any length and without links.
    ((70, 0.00, 60, 0.00, 50, 0.00, 0, 1, 0), 0),
    ((120, 0.00, 0, 0.00, 90, 0.00, 0, 1, 0), 0),
    ((35, 0.00, 40, 0.00, 30, 0.00, 1, 1, 0), 0),
    ((8, 0.00, 12, 0.00, 9, 0.00, 1, 1, 0), 0),
    ((15, 1.00, 70, 0.00, 2, 1.00, 1, 1, 1), 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7):
    """A decision tree by Gini impurity: a share of ones, or (feature, threshold, tree up to it, tree beyond it)."""
    share = float(y.mean())
    best = None
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                impurity = sum(part.sum() * (p := y[part].mean()) * (1 - p) for part in (low, ~low))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, float(cut), low
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def trained_tree(labelled=LABELLED):
    return grow(np.array([row for row, _ in labelled], float), np.array([label for _, label in labelled], float))


def is_content(tree, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def skipped_to(source: str, at: int, name: str, parents: set[str], missing: set[str]) -> int:
    """Where a skipped element that starts before at ends: behind its end tag, or, if it has none, before the next tag that cannot be in it.

    parents are the elements around it; missing collects the names that have no end tag in the rest of the source.
    """
    end = None if name in missing else re.compile(rf"</{name}\s*>", re.I).search(source, at)
    if not end:
        missing.add(name)
    if name in _RAW and end and (name in ("script", "style") or not re.compile(rf"<{name}[\s>]", re.I).search(source, at, end.start())):
        return end.end()
    opened: dict[str, int] = {}
    first, place, last = len(source), at, last_tag(source)
    while place <= last and (m := _TAG.search(source, place)):
        place, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened.get(tag):
                opened[tag] -= 1
            elif tag == name:
                return place
            elif tag in parents:
                return min(first, m.start())
        elif tag == name and (tag in _RAW or tag in ("button", "select")):
            return min(first, m.start())
        else:
            if tag in _BLOCKS and not (name == "select" and tag in _IN_SELECT):
                first = min(first, m.start())
                if not end:
                    break
            if tag not in _VOID and not m[3].rstrip().endswith("/"):
                opened[tag] = opened.get(tag, 0) + 1
    return first


def last_tag(source: str) -> int:
    """The place behind which no tag ends and no comment begins: what follows is text, whatever it opens."""
    return max(source.rfind(">"), source.rfind("<!--"))


def blocks_of(page: str | None) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, linked words, inside an article, outside the main text, list item) of each block in page order."""
    out: list[tuple] = []
    stack: list[tuple[str, int, int]] = []  # element, and by how much it changes inside and outside
    names_of: list[tuple[int, str, int, bool]] = []  # open elements that are outside by name or are forms: depth, name, number, may hold later articles
    cleared: set[int] = set()  # numbers of those that turned out to hold an article
    missing: set[str] = set()
    number = articles = 0
    in_head = False
    inside = outside = in_link = 0
    parts: list[str] = []
    linked: list[str] = []
    item = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, len(text.split()), len("".join(linked).split()), inside > 0, outside > 0, tuple(n[2] for n in names_of), item))
        parts, linked = [], []

    source, at = page or "", 0
    last = last_tag(source)
    while at < len(source):
        m = _TAG.search(source, at) if at <= last else None
        stop = m.start() if m else len(source)
        if stop > at:
            text = html.unescape(source[at:stop])
            in_head = in_head and text.isspace()
            parts.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in _BLOCKS:
                close()
            if name == "a":
                in_link = 0
            if name == "head":
                in_head = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, a, b in stack[k:]:
                        inside, outside = inside - a, outside - b
                    del stack[k:]
                    while names_of and names_of[-1][0] >= k:
                        names_of.pop()
                    break
            item = any(s[0] == "li" for s in stack)
            continue
        if name in _BLOCKS:
            close()
        elif name == "br":
            parts.append(" ")
        if name == "head":
            in_head = True
            continue
        in_head = in_head and name in _HEAD
        if name in _SKIPPED or (in_head and name == "title"):
            if not m[3].rstrip().endswith("/"):
                at = skipped_to(source, at, name, {s[0] for s in stack} | {"head", "body", "html"}, missing)
            continue
        if name in _VOID:
            continue
        if name == "a":
            in_link = 1
            linked.append(" ")
            continue
        if name in _BLOCKS:
            if name in ("p", "li") and stack and stack[-1][0] == name:
                _, a, b = stack.pop()
                inside, outside = inside - a, outside - b
                while names_of and names_of[-1][0] >= len(stack):
                    names_of.pop()
            names = " ".join(" ".join(filter(None, h)) for h in _HINT.findall(m[3])) if m[3] else ""
            named = bool(names and _BAD_NAME.search(names))
            good = name in _INSIDE or bool(names and not named and name not in _OUTSIDE and _GOOD_NAME.search(names))
            if name in _INSIDE or (names and _MAIN_ROLE.search(m[3])):
                cleared.update(n[2] for n in names_of if not articles or name != "article" or n[3])
                articles += 1
            if (named and name not in _UNNAMED and name not in _OUTSIDE) or name == "form":
                number += 1
                names_of.append((len(stack), name, number, not _AFTER_NAME.search(names)))
            own = name == "header" and not named and (inside or any(e[0] == "section" for e in stack))  # an article's or a section's own header holds its title
            bad = name in _OUTSIDE and name != "form" and not own
            stack.append((name, int(good), int(bad)))
            inside, outside = inside + good, outside + bad
            item = item or name == "li"
    close()
    return [(*b[:4], b[4] or not cleared.issuperset(b[5]), b[6]) for b in out]


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page)
    density = [min(1.0, b[2] / b[1]) for b in blocks]
    kept = []
    for i, (text, words, _, inside, outside, item) in enumerate(blocks):
        before = (blocks[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (blocks[i + 1][1], density[i + 1]) if i + 1 < len(blocks) else (0, 0.0)
        if is_content(tree, (words, density[i], *before, *after, inside, outside, item)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages: its main text, '' if there is none.

    Null and empty pages have none; blocks of any length and number are judged, whole; unclosed elements end with their parent or the page, unclosed skipped ones (script,
    button, select, ...) before the next block; an element around an article is not outside because of its name, except
    that comments and related links stay so unless they hold the page's first article; repeated rows stay.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def start():
        tree = trained_tree()

        def work(ids, urls, sources):
            texts = [main_text(s, tree) for s in sources]
            return [ids, urls, texts]

        return work

    found = map_columns(picked(pages, id_col, url_col, html_col), f"{kinds}, text string", start)
    return found.select("*", F.length("text").cast("long").alias("n_chars"))
