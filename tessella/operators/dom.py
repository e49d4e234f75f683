"""Parsing pages into token rows: the one stage that runs Python on the executors.

A page becomes a flat list of nodes in document order, each knowing its parent and where its subtree
ends. Two sweeps over that list, one backwards for what lies below a node and one forwards for what lies
above it, give every number that depends on the tree. Nothing recurses, so depth is not limited.
Everything that depends on other tokens by their order or on page-wide sums is left to SQL windows.

Tree rules: void elements close at once; an end tag closes the nearest open element of its name and is
ignored if there is none; ``p`` and ``li`` aren't closed by their like; a string of white space only is
kept as one line feed or one space (as it is within pre and textarea); script, style, template and ruby
text is not visible from outside. Text of comments, doctypes, scripts and styles is tokenised like any
other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from math import sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread
from .token_tree import TREE_NUMBERS, TokenTree, display_code, display_value

VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
#: Elements whose strings are of a kind of their own.
CONTAINERS = frozenset(("script", "style", "template", "rt", "rp"))
SECTIONS = frozenset(("section", "article", "nav", "aside"))
MAX_TOKEN_CHARS = 500
#: An ampersand, with what it stands for where that is closed.
_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")
#: Rows that a worker holds as Python values at once.
BATCH_ROWS = 2_000
#: Neither letter or digit nor white space.
_SPECIAL = re.compile(r"[^\w\s]|_")
ROOT = "[document]"


class Node:
    """An element, or a string (name is None) of a kind: text, cdata, comment, doctype, pi or a container's name."""

    __slots__ = ("attrs", "children", "end", "index", "kind", "name", "parent", "stats", "text")

    def __init__(self, index: int, parent: Node | None, name: str | None, attrs: dict | None, text: str, kind: str):
        self.index, self.parent, self.name, self.attrs, self.text, self.kind = index, parent, name, attrs, text, kind
        self.children: list[Node] | tuple = () if name is None else []
        self.end, self.stats = index + 1, None

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(0, None, ROOT, {}, "", "tag")]
        self.open = [self.nodes[0]]
        self.pending: list[str] = []

    def _add(self, name: str | None, attrs: dict | None, text: str, kind: str) -> Node:
        node = Node(len(self.nodes), self.open[-1], name, attrs, text, kind)
        self.nodes.append(node)
        self.open[-1].children.append(node)
        return node

    def flush(self) -> None:
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending.clear()
        if not text.strip(" \t\n\r\x0b\x0c") and not any(x.name in ("pre", "textarea") for x in self.open):
            text = "\n" if "\n" in text else " "
        self._add(None, None, text, next((x.name for x in reversed(self.open) if x.name in CONTAINERS), "text"))

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        node = self._add(tag, {k: v or "" for k, v in attrs}, "", "tag")
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def _special(self, text: str, kind: str) -> None:
        self.flush()
        self._add(None, None, text, kind)

    def handle_comment(self, data: str) -> None:
        self._special(data, "comment")

    def handle_decl(self, decl: str) -> None:
        self._special(decl[8:] if decl[:8].lower() == "doctype " else decl, "doctype")

    def handle_pi(self, data: str) -> None:
        self._special(data, "pi")

    def unknown_decl(self, data: str) -> None:
        if data.upper().startswith("CDATA["):
            self._special(data[6:], "cdata")
        else:
            self._special(data, "doctype")


def parse(html: str) -> list[Node]:
    """The nodes of a page in document order; the first is the document.

    A named or numbered character is read with or without the semicolon that closes it, as browsers do.
    """
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    builder.flush()
    nodes = builder.nodes
    for node in reversed(nodes[1:]):
        node.parent.end = max(node.parent.end, node.end)
    return nodes


def parse_closed(html: str) -> list[Node]:
    """As ``parse``, but a character's name or number without a semicolon stays as it is."""
    mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)  # stands for the ampersands that stay
    nodes = parse(_REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + m[0][1:], html))
    for node in nodes:
        node.text = node.text.replace(mark, "&")
        if node.name is not None:
            node.attrs = {k: v.replace(mark, "&") for k, v in node.attrs.items()}
    return nodes


#: What ``measure`` adds up below an element.
SUMS = (
    "n_nodes", "n_tags", "n_links", "n_images", "n_buttons", "n_strings", "n_digit_strings",
    "vis_chars", "vis_strings", "vis_periods", "vis_special", "vis_digits", "vis_repeats",
)
#: What ``measure`` finds below and above an element.
BELOW = (*SUMS, "n_child_tags", "height", "vis_words")
ABOVE = ("depth", "with_class", "with_id", "divs", "sections")


class Words(NamedTuple):
    """The word lengths of strings put together without separators: first, last, and sums of those between.

    A string of one word, and any number of such, is ``solid``: its first word is its last one.
    """

    solid: bool
    first: int
    last: int
    n: int
    chars: int
    squares: int

    @classmethod
    def of(cls, text: str) -> Words:
        sizes = [len(w) for w in text.split()]
        if len(sizes) == 1:
            return cls(True, sizes[0], sizes[0], 0, 0, 0)
        inner = sizes[1:-1]
        return cls(False, sizes[0], sizes[-1], len(inner), sum(inner), sum(x * x for x in inner))

    def before(self, other: Words | None) -> Words:
        """The words of this text with the other one right after it."""
        if other is None:
            return self
        if self.solid and other.solid:
            return Words(True, self.first + other.first, self.last + other.last, 0, 0, 0)
        if self.solid:
            return other._replace(first=self.first + other.first)
        if other.solid:
            return self._replace(last=self.last + other.last)
        joint = self.last + other.first
        return Words(False, self.first, other.last, self.n + other.n + 1, self.chars + other.chars + joint, self.squares + other.squares + joint * joint)

    def moments(self) -> tuple[int, float, float]:
        """Number, mean and population deviation of the lengths."""
        ends = (self.first,) if self.solid else (self.first, self.last)
        n, total, squares = self.n + len(ends), self.chars + sum(ends), self.squares + sum(x * x for x in ends)
        return n, total / n, sqrt(n * squares - total * total) / n


class Stats:
    __slots__ = (*BELOW, *ABOVE, "own_chars", "own_digits", "own_strings", "tag_rates", "text_rate", "rate_sum", "rate_squares")

    def __init__(self):
        for name in self.__slots__:
            setattr(self, name, 0)
        self.vis_words = None


def measure(nodes: list[Node], counts: dict[str, int] | None = None) -> None:
    """Gives every element its Stats; ``counts`` says how often the page has a string as a token."""
    counts = counts or {}
    for node in nodes:
        if node.name is not None:
            node.stats = Stats()
    for node in reversed(nodes):
        up = node.parent.stats if node.parent else None
        if node.name is None:
            stripped = node.text.strip()
            digits = sum(map(str.isdigit, stripped))
            up.n_nodes += 1
            up.n_strings += bool(stripped)
            up.n_digit_strings += digits > 0
            if node.kind in ("text", "cdata") and stripped:
                up.vis_chars += len(stripped)
                up.vis_strings += 1
                up.vis_periods += stripped.count(".")
                up.vis_digits += digits
                up.vis_special += _SPECIAL.subn("", stripped)[1]
                up.vis_repeats += counts.get(stripped, 0)
                up.vis_words = Words.of(stripped).before(up.vis_words)
            elif node.kind in CONTAINERS and stripped:
                place = node.parent  # an element sees the strings of its own kind
                while place is not None:
                    if place.name == node.kind:
                        place.stats.own_chars += len(stripped)
                        place.stats.own_digits += digits
                        place.stats.own_strings += 1
                    place = place.parent
            continue
        s = node.stats
        if node.name not in CONTAINERS:
            s.own_chars, s.own_digits, s.own_strings = s.vis_chars, s.vis_digits, s.vis_strings
        s.text_rate = s.own_strings / s.n_child_tags if s.n_child_tags else 0.0
        if up:
            for name in SUMS:
                setattr(up, name, getattr(up, name) + getattr(s, name))
            if s.vis_words is not None:
                up.vis_words = s.vis_words.before(up.vis_words)
            up.n_child_tags += 1
            up.n_nodes += 1
            up.n_tags += 1
            up.n_links += node.name == "a"
            up.n_images += node.name == "img"
            up.n_buttons += node.name == "button" or node.attrs.get("role") == "button"
            up.height = max(up.height, s.height + 1)
    for node in nodes[1:]:
        if node.name is None:
            continue
        s, p, up = node.stats, node.parent, node.parent.stats
        s.depth = up.depth + 1
        s.with_class = up.with_class + bool(p.classes)
        s.with_id = up.with_id + bool(p.attrs.get("id"))
        s.divs = up.divs + (p.name == "div")
        s.sections = up.sections + (p.name in SECTIONS)
        s.tag_rates = up.tag_rates + up.n_child_tags / (up.depth or 1)
        s.rate_sum = up.rate_sum + up.text_rate
        s.rate_squares = up.rate_squares + up.text_rate**2


def structure_ids(nodes: list[Node]) -> list[int]:
    """A number for each node, equal for equal markup: name, attributes and contents; strings by their text."""
    known: dict = {}
    out = [0] * len(nodes)
    for node in reversed(nodes):
        if node.name is None:
            key = node.text
        else:
            key = (node.name, tuple(sorted(node.attrs.items())), tuple(out[x.index] for x in node.children))
        out[node.index] = known.setdefault(key, len(known))
    return out


def visible_strings(nodes: list[Node], node: Node) -> list[str]:
    """The stripped strings that an element shows."""
    kinds = (node.name,) if node.name in CONTAINERS else ("text", "cdata")
    return [s for x in nodes[node.index : node.end] if x.name is None and x.kind in kinds and (s := x.text.strip())]


#: Numbers of a token's element, of its parent (block_), and of its place and page, as the parse stage gives them.
NODE_NUMBERS = (
    "depth", "anc_with_class", "anc_with_id", "anc_div", "anc_section", "n_child_tags", "n_nodes", "height", "n_siblings",
    "sibling_index", "siblings_with_text", "sibling_chars", "sibling_names", "has_style", "style_properties", "font_size",
    "margin_top", "display_code", "parent_child_tags", "digit_children", "digit_strings", "links", "buttons", "n_classes",
    "class_chars", "id_chars", "is_link", "href_depth", "title_class", "anc_text_variance", "anc_tag_rate", "n_strings", "n_tags",
    "images", "other_sibling_chars", "other_sibling_tags", "has_parent", "path_length",
)
BLOCK_NUMBERS = (
    "block_child_tags", "block_depth", "block_strings", "block_chars", "block_tags", "block_height", "block_periods", "block_words",
    "block_word_mean", "block_word_std", "block_special", "block_digits", "outer_chars", "outer_tags", "block_size", "block_repeats",
)
PLACE_NUMBERS = ("block_gap", "vocabulary")
NUMBERS = (*NODE_NUMBERS, *BLOCK_NUMBERS, *PLACE_NUMBERS)


def _style_number(style: str, name: str) -> float | None:
    at = style.find(name)
    while at >= 0:
        rest = style[at + len(name) :].lstrip()
        if rest.startswith(":"):
            digits = rest[1:].lstrip()
            size = next((k for k, c in enumerate(digits) if not (c.isdecimal() or c == ".")), len(digits))
            if size:
                try:
                    return float(digits[:size])
                except ValueError:
                    return None
        at = style.find(name, at + 1)
    return 0.0


class PageTokens:
    """Token rows of one page, with the numbers asked for; the tree is only measured if there are any."""

    def __init__(self, html: str, numbers: tuple[str, ...] = NUMBERS, closed: bool = False):
        self.nodes, self.numbers = (parse_closed if closed else parse)(html), numbers
        self.tokens = [
            (text, x.parent) for x in self.nodes if x.name is None and (text := x.text.strip()) and len(text) <= MAX_TOKEN_CHARS
        ]
        if not numbers:
            return
        self.counts = Counter(text for text, _ in self.tokens)
        measure(self.nodes, self.counts)
        self.ids = structure_ids(self.nodes)
        self.vocabulary = len({w.lower() for text in self.counts for w in text.split()})
        self.places: dict[int, list[int]] = {}
        for k, (_, node) in enumerate(self.tokens):
            self.places.setdefault(self.ids[node.index], []).append(k)
        self.of_block: dict[int, dict] = {}
        self.of_structure: dict[int, list[list[int]]] = {}
        self.of_children: dict[int, dict] = {}
        self.left = Counter(node.index for _, node in self.tokens)
        self.left_in_block = Counter((node.parent or node).index for _, node in self.tokens)
        self.asked = Counter(self.ids[(node.parent or node).index] for _, node in self.tokens)

    def _alike(self, block: Node) -> list[list[int]]:
        """The positions of tokens in markup like that of the block's children, in one or more sorted lists.

        They are put into one list only where that is less work than a look into each list for every token that
        asks: very many blocks can share the markup of a child.
        """
        mark = self.ids[block.index]
        if mark not in self.of_structure:
            marks = {self.ids[x.index] for x in block.children if x.name is not None}
            lists = [self.places[x] for x in marks if x in self.places]
            if len(lists) > 1 and sum(map(len, lists)) <= len(lists) * self.asked[mark]:
                lists = [sorted(k for x in lists for k in x)]
            self.of_structure[mark] = lists
        return self.of_structure[mark]

    def _block(self, block: Node) -> dict:
        """Numbers of an element as the block of its children."""
        if block.index in self.of_block:
            return self.of_block[block.index]
        s, outer = block.stats, block.parent
        words, chars, strings, repeats = s.vis_words, s.vis_chars, s.vis_strings, s.vis_repeats
        periods, special, digits = s.vis_periods, s.vis_special, s.vis_digits
        if block.name in CONTAINERS:  # few: their own strings are read
            shown = visible_strings(self.nodes, block)
            joined = "".join(shown)
            words = Words.of(joined) if joined else None
            chars, strings, repeats = len(joined), len(shown), sum(self.counts.get(x, 0) for x in shown)
            periods, special, digits = joined.count("."), _SPECIAL.subn("", joined)[1], sum(map(str.isdigit, joined))
        n, mean, spread = words.moments() if words else (0, 0.0, 0.0)
        self.of_block[block.index] = {
            "block_child_tags": s.n_child_tags, "block_depth": s.depth, "block_strings": strings, "block_chars": chars,
            "block_tags": s.n_tags, "block_height": s.height + 1, "block_periods": periods, "block_words": n,
            "block_word_mean": mean, "block_word_std": spread, "block_special": special, "block_digits": digits,
            "outer_chars": (outer.stats.own_chars or 1) if outer else 1, "outer_tags": outer.stats.n_tags if outer else 0,
            "block_size": sum(map(len, self._alike(block))), "block_repeats": repeats / strings if strings else 0.0,
        }
        return self.of_block[block.index]

    def _children(self, parent: Node) -> dict:
        """What the child elements of an element have in common."""
        if parent.index not in self.of_children:
            tags = [x for x in parent.children if x.name is not None]
            first: dict[int, int] = {}
            for k, x in enumerate(tags):
                first.setdefault(self.ids[x.index], k)
            self.of_children[parent.index] = {
                "first": first, "n": len(tags), "with_text": sum(x.stats.own_chars > 0 for x in tags),
                "chars": sum(x.stats.own_chars for x in tags), "names": len({x.name for x in tags}),
                "tags": sum(x.stats.n_child_tags for x in tags),
            }
        return self.of_children[parent.index]

    def _node(self, node: Node) -> dict:
        s, parent, style = node.stats, node.parent, node.attrs.get("style", "")
        peers = self._children(parent) if parent else {"first": {self.ids[0]: 0}, "n": 0, "with_text": 0, "chars": 0, "names": 0, "tags": 0}
        others, classes = peers["n"] - 1, node.classes
        mean = s.rate_sum / s.depth if s.depth else 0.0
        titled = next((k for k, c in enumerate(classes) if "title" in c.lower()), None)
        return {
            "depth": s.depth, "anc_with_class": s.with_class, "anc_with_id": s.with_id, "anc_div": s.divs, "anc_section": s.sections,
            "n_child_tags": s.n_child_tags, "n_nodes": s.n_nodes, "height": s.height, "n_siblings": max(others, 0),
            "sibling_index": peers["first"][self.ids[node.index]], "siblings_with_text": peers["with_text"],
            "sibling_chars": peers["chars"] / peers["n"] if peers["n"] else 0.0, "sibling_names": peers["names"],
            "has_style": float(bool(style)), "style_properties": sum(":" in x for x in style.split(";")),
            "font_size": _style_number(style, "font-size"), "margin_top": _style_number(style, "margin-top"),
            "display_code": display_code(display_value(style)), "parent_child_tags": parent.stats.n_child_tags if parent else 0,
            "digit_children": sum(x.stats.own_digits > 0 for x in node.children if x.name is not None),
            "digit_strings": s.n_digit_strings, "links": s.n_links, "buttons": s.n_buttons, "n_classes": len(classes),
            "class_chars": sum(map(len, classes)) / len(classes) if classes else 0.0, "id_chars": len(node.attrs.get("id", "")),
            "is_link": float(node.name == "a"), "href_depth": node.attrs.get("href", "").count("/") if node.name == "a" else 0,
            "title_class": 0.0 if titled is None else 1.0 / (titled + 1),
            "anc_text_variance": max(0.0, s.rate_squares / s.depth - mean**2) if s.depth > 1 else 0.0,
            "anc_tag_rate": s.tag_rates / s.depth if s.depth else 0.0, "n_strings": s.n_strings, "n_tags": s.n_tags,
            "images": s.n_images,
            "other_sibling_chars": (peers["chars"] - s.own_chars) / others if others > 0 else 0.0,
            "other_sibling_tags": (peers["tags"] - s.n_child_tags) / others if others > 0 else 0.0,
            "has_parent": float(parent is not None), "path_length": s.depth + 1,
        }

    def _gap(self, k: int, block: Node) -> float | None:
        """Half the distance between the neighbours of token k among its block's own; None where it isn't one of them."""
        lists = self._alike(block)
        if not lists:
            return 0.0
        own, before, after = False, None, None
        for places in lists:
            at = bisect_left(places, k)
            if at and (before is None or places[at - 1] > before):
                before = places[at - 1]
            if at < len(places) and places[at] == k:
                own, at = True, at + 1
            if at < len(places) and (after is None or places[at] < after):
                after = places[at]
        if not own:
            return None
        return ((0 if before is None else k - before) + (0 if after is None else after - k)) / 2

    def rows(self) -> list[tuple]:
        """(position, text, tag, classes, *numbers) of each token; missing numbers are None."""
        return list(self.stream())

    def stream(self) -> Iterator[tuple]:
        """The rows one by one; numbers of an element or block are forgotten with the last token that needs them."""
        wanted, known = self.numbers, {}
        of_tree = [x for x in wanted if x in TREE_NUMBERS]
        tree = TokenTree(self.nodes, self.tokens, self.ids) if of_tree else None
        groups = [bool(set(wanted) & set(group)) for group in (NODE_NUMBERS, BLOCK_NUMBERS)]
        for k, (text, node) in enumerate(self.tokens):
            numbers = known.get(node.index)
            if wanted and numbers is None:
                numbers = dict(self._node(node)) if groups[0] else {}
                if groups[1]:
                    numbers |= self._block(node.parent or node)
                    if node.parent is None:  # features of the parent that an element of the document itself lacks
                        numbers |= {"block_child_tags": 0, "block_depth": 1, "block_height": 0}
                if tree:
                    numbers |= tree.numbers(node)
                numbers["vocabulary"] = self.vocabulary
                known[node.index] = numbers
            if "block_gap" in wanted:
                numbers["block_gap"] = self._gap(k, node.parent or node)
            yield (k, text, node.name, node.classes, *[numbers[x] for x in wanted])
            if wanted:
                block = (node.parent or node).index
                self.left[node.index] -= 1
                self.left_in_block[block] -= 1
                if not self.left[node.index]:
                    del known[node.index]
                if not self.left_in_block[block]:
                    self.of_block.pop(block, None)


def _rows(id_type: pa.DataType, numbers: tuple[str, ...], closed: bool = False):
    def run(batches):
        names = ["page_id", "position", "text", "tag", "classes", *numbers, "error"]
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.float64()] * len(numbers), pa.string()]

        def table(rows):
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            rows = []  # of small pages
            for page_id, html in zip(batch.column(0), batch.column(1), strict=True):
                page_id, own, full = page_id.as_py(), [], []  # a page's rows wait for its end, most of them as Arrow tables
                try:
                    for row in PageTokens(html.as_py() or "", numbers, closed).stream():
                        own.append((page_id, *row, None))
                        if len(own) == BATCH_ROWS:
                            full.append(table(own))
                            own = []
                except Exception as e:  # a page that can't be parsed gives one row that says why
                    own, full = [(page_id, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")], []
                yield from full
                rows += own
                if len(rows) >= BATCH_ROWS:
                    yield table(rows)
                    rows = []
            yield table(rows)

    return run


def parsed_tokens(
    pages: DataFrame, id_column: str = "page_id", html_column: str = "html", numbers: tuple[str, ...] = NUMBERS, closed: bool = False
) -> DataFrame:
    """Token rows of all pages with the numbers asked for, of NUMBERS and TREE_NUMBERS.

    A page that fails gives one row with its error; a null or empty page has no tokens. The optimiser can't
    look into the parse stage, so callers name the numbers they need, and the rest isn't computed. Pages are
    only dealt anew where a small table has fewer files than there are cores. With ``closed``
    pages are read by ``parse_closed``.
    """
    ship(pages.sparkSession)
    if unknown := set(numbers) - set(NUMBERS) - set(TREE_NUMBERS):
        raise ValueError(f"unknown numbers {sorted(unknown)}")
    source = pages.select(F.col(id_column).alias("page_id"), F.col(html_column).cast("string").alias("html"))
    kind, arrow = ("string", pa.string()) if dict(source.dtypes)["page_id"] == "string" else ("long", pa.int64())
    source = spread(source.withColumn("page_id", F.col("page_id").cast(kind)))
    columns = [f"page_id {kind}, position long, text string, tag string, classes array<string>", *[f"{x} double" for x in numbers], "error string"]
    return source.mapInArrow(_rows(arrow, tuple(numbers), closed), ", ".join(columns))


def _node_rows(batches):
    names = ["page_id", "node_id", "parent_id", "kind", "name", "text", "attrs", "depth", "n_child_tags", "n_descendants", "height", "structure", "error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), *[pa.int64()] * 5, pa.string()]
    for batch in batches:
        rows = []
        for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                nodes = parse(html or "")
                measure(nodes)
                ids = structure_ids(nodes)
                for x in nodes:
                    s = x.stats
                    rows.append((
                        page_id, x.index, x.parent.index if x.parent else None, x.kind, x.name, None if x.name is not None else x.text,
                        list((x.attrs or {}).items()), s.depth if s else None, s.n_child_tags if s else None, s.n_nodes if s else None,
                        s.height if s else None, ids[x.index], None,
                    ))
            except Exception as e:
                rows.append((page_id, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def dom_nodes(pages: DataFrame) -> DataFrame:
    """All nodes of all pages(page_id, html); ``structure`` is equal for equal markup within a page.

    A page that fails gives one row with its error.
    """
    ship(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return spread(source).mapInArrow(
        _node_rows,
        "page_id long, node_id long, parent_id long, kind string, name string, text string, attrs map<string,string>,"
        " depth long, n_child_tags long, n_descendants long, height long, structure long, error string",
    )
