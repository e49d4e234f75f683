"""The tree of token-bearing elements, for the second variant's features.

Only elements that have tokens of their own count, and elements of equal markup are one: they share one list
of children, an entry for each token of a child, and the parent that the last of them has. Descendants are
counted along all paths through these lists, so a child of two tokens counts twice with all below it; sums
over them are made from the bottom up, once for each markup. The tokens below an element are a set, held
as the bits of a number.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

_DISPLAY = re.compile(r"display\s*:\s*([^;]+)")
_SENTENCES = re.compile("[.!?]+")

#: Numbers of a token's element in this tree, as the parse stage gives them.
TREE_NUMBERS = (
    "t_depth", "t_max_depth", "t_children", "t_descendants", "t_child_depth", "t_siblings", "t_index", "t_siblings_with_text",
    "t_sibling_chars", "t_sibling_names", "t_sibling_children", "t_parent_children", "t_parent_descendants", "t_digit_children",
    "t_digit_descendants", "t_links", "t_images", "t_buttons", "t_names", "t_density", "t_anc_mean", "t_anc_variance", "t_weighted",
    "t_height", "t_tokens", "t_distance", "t_word_mean", "t_word_std", "t_sentences", "t_special", "t_digits", "t_block",
    "t_style_segments", "t_has_style", "t_display", "t_vocabulary", "t_ancestors",
)


def display_value(style: str) -> str:
    found = _DISPLAY.search(style)
    return found[1].strip() if found else ""


def display_code(value: str) -> float:
    return {"none": 0.0, "block": 1.0, "inline": 2.0}.get(value, 3.0)


def mean_pair_distance(positions: np.ndarray) -> float:
    """Mean distance of all n * n ordered pairs of sorted positions, without making a pair."""
    n = len(positions)
    if not n:
        return 0.0
    return float(2 * (positions * (2 * np.arange(n) - n + 1)).sum() / (n * n))


class TokenTree:
    def __init__(self, nodes: list, tokens: list[tuple], ids: list[int]):
        self.nodes, self.tokens, self.ids = nodes, tokens, ids
        self.node_of: dict[int, object] = {}
        self.up: dict[int, int | None] = {}
        self.below: dict[int, list[int]] = {}
        self.own = Counter()
        self.of_this = Counter(node.index for _, node in tokens)
        bits: dict[int, int] = {}
        for k, (_, node) in enumerate(tokens):
            mark = ids[node.index]
            self.node_of.setdefault(mark, node)
            self.own[mark] += 1
            self.up[mark] = ids[node.parent.index] if node.parent else None
            if node.parent:
                self.below.setdefault(ids[node.parent.index], []).append(mark)
            bits[mark] = bits.get(mark, 0) | 1 << k
        self.depth = dict.fromkeys(self.own, 0)
        for _, node in tokens:  # in order: a parent whose tokens come later counts with the depth it has by then
            mark = ids[node.index]
            self.depth[mark] = self.depth.get(self.up[mark], 0) + 1
        self.first = {mark: self._first_places(row) for mark, row in self.below.items()}
        self.token_bits = bits
        self.lengths = np.array([len(t) for t, _ in tokens], np.int64)
        self._texts()
        self.sums: dict[int, dict] = {}
        for mark in sorted(self.own):  # equal markup has a smaller number than what holds it
            self.sums[mark] = self._below(mark)
        self.known: dict[int, dict] = {}
        self.known_peers: dict[int, dict] = {}
        self.max_depth = max(self.depth.values(), default=0)

    @staticmethod
    def _first_places(row: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, mark in enumerate(row):
            out.setdefault(mark, k)
        return out

    def _texts(self) -> None:
        sizes = [[len(w) for w in t.split()] for t, _ in self.tokens]
        self.words = np.array([len(x) for x in sizes], np.int64)
        self.word_chars = np.array([sum(x) for x in sizes], np.int64)
        self.word_squares = np.array([sum(y * y for y in x) for x in sizes], np.int64)
        self.sentences = np.array([len(_SENTENCES.findall(t)) for t, _ in self.tokens], np.int64)
        self.special = np.array([sum(not c.isalnum() and not c.isspace() for c in t) for t, _ in self.tokens], np.int64)
        self.digits = np.array([sum(map(str.isdigit, t)) for t, _ in self.tokens], np.int64)
        self.vocabulary = len({w for t, _ in self.tokens for w in t.split()})

    def _below(self, mark: int) -> dict:
        """Sums over the descendants of an element and over the tokens below it."""
        # paths multiply with the depth of a page, so their numbers are floating
        out = {"n": 0.0, "digits": 0.0, "links": 0.0, "images": 0.0, "buttons": 0.0, "weighted": 0.0, "height": 1, "names": frozenset(), "bits": 0}
        for child, times in Counter(self.below.get(mark, ())).items():
            node, s = self.node_of[child], self.sums[child]
            out["n"] += times * (1 + s["n"])
            out["digits"] += times * ((node.stats.own_digits > 0) + s["digits"])
            out["links"] += times * ((node.name == "a") + s["links"])
            out["images"] += times * ((node.name == "img") + s["images"])
            out["buttons"] += times * ((node.name == "button") + s["buttons"])
            out["weighted"] += times * (self.own[child] / (self.depth[child] or 1) + s["weighted"])
            out["height"] = max(out["height"], 1 + s["height"])
            out["names"] |= s["names"] | {node.name}
            out["bits"] |= s["bits"] | self.token_bits[child]
        raw = out["bits"].to_bytes((len(self.tokens) + 7) // 8, "little")
        places = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: len(self.tokens)])
        chars, n_words = int(self.lengths[places].sum()), int(self.words[places].sum())
        total, squares = int(self.word_chars[places].sum()), int(self.word_squares[places].sum())
        out |= {
            "density": chars / (out["n"] or 1), "tokens": len(places), "distance": mean_pair_distance(places),
            "word_mean": total / n_words if n_words else 0.0,
            "word_std": (n_words * squares - total * total) ** 0.5 / n_words if n_words else 0.0,
            "sentences": float(self.sentences[places].mean()) if len(places) else 0.0,
            "special": int(self.special[places].sum()) / (chars or 1), "digit_rate": int(self.digits[places].sum()) / (chars or 1),
        }
        return out

    def numbers(self, node) -> dict:
        mark = self.ids[node.index]
        if mark not in self.known:
            self.known[mark] = self._numbers(mark)
        same = self.up[mark] is not None and self.ids[node.parent.index] == self.up[mark]
        own = self.of_this[node.index] if same else 0  # entries of this very element among its siblings
        row = self.below.get(self.up[mark], []) if self.up[mark] is not None else []
        others, counts = len(row) - own, self.known[mark]["t_all_children"] - own * len(self.below.get(mark, ()))
        style = node.attrs.get("style", "")
        return self.known[mark] | {
            "t_sibling_children": counts / others if others > 0 else 0.0,
            "t_block": self.ids[node.parent.index] if node.parent else -1,
            "t_style_segments": len(style.split(";")) if style else 0,
            "t_has_style": float("style" in node.attrs),
            "t_display": display_code(display_value(style).lower()),
            "t_ancestors": node.stats.depth,
        }

    def _numbers(self, mark: int) -> dict:
        s, up = self.sums[mark], self.up[mark]
        children = self.below.get(mark, [])
        densities, at = [], up
        while at in self.sums:
            densities.append(self.sums[at]["density"])
            at = self.up[at]
        mean = sum(densities) / len(densities) if densities else 0.0
        peers = self._peers([mark]) | {"t_all_children": 0, "t_parent_children": 0} if up is None else self._peers_below(up)
        return peers | {
            "t_depth": self.depth[mark], "t_max_depth": self.max_depth, "t_children": len(children), "t_descendants": s["n"],
            "t_child_depth": max((self.depth[x] for x in children), default=0), "t_index": 0 if up is None else self.first[up][mark],
            "t_parent_descendants": self.sums[up]["n"] if up in self.sums else 0,
            "t_digit_children": sum(self.node_of[x].stats.own_digits > 0 for x in children), "t_digit_descendants": s["digits"],
            "t_links": s["links"], "t_images": s["images"], "t_buttons": s["buttons"], "t_names": len(s["names"]), "t_density": s["density"],
            "t_anc_mean": mean, "t_anc_variance": sum((x - mean) ** 2 for x in densities) / len(densities) if densities else 0.0,
            "t_weighted": s["weighted"] / (s["n"] or 1), "t_height": s["height"], "t_tokens": s["tokens"], "t_distance": s["distance"],
            "t_word_mean": s["word_mean"], "t_word_std": s["word_std"], "t_sentences": s["sentences"], "t_special": s["special"],
            "t_digits": s["digit_rate"], "t_vocabulary": self.vocabulary,
        }

    def _peers_below(self, up: int) -> dict:
        if up not in self.known_peers:
            self.known_peers[up] = self._peers(self.below[up])
        return self.known_peers[up]

    def _peers(self, row: list[int]) -> dict:
        """What the entries of a list of children have in common."""
        shown = [self.node_of[x].stats.own_chars for x in row]
        return {
            "t_siblings": len(row) - 1, "t_siblings_with_text": sum(x > 0 for x in shown), "t_sibling_chars": sum(shown) / len(shown),
            "t_sibling_names": len({self.node_of[x].name for x in row}), "t_parent_children": len(row),
            "t_all_children": sum(len(self.below.get(x, ())) for x in row),
        }
