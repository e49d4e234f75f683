"""Exact tokenizer ids of whole texts, each distinct piece of text encoded once.

A byte-level BPE with the usual word pattern never merges across pre-tokens, and some borders of
pre-tokens show without the pattern: before a single space, and around a single line feed, of which
neither neighbour is white space, and before an ASCII mark other than an apostrophe that follows a
Latin letter. Texts are cut there, equal pieces are found by dictionary encoding, and only pieces that
this worker hasn't met lately go through the tokenizers library: one after the other as a text where their
borders are cuts again, since a call for each costs more than its ids. There the bytes that ids stand for
tell which are whose. The ids are those of the whole text, which the tests check against the library on
arbitrary strings.

That holds for tokenizers of this kind only. Any other (another pre-tokenizer or model, a normaliser, a
special token with a cut inside) encodes whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .shared import kept_by_workers

#: Bytes of pieces and their ids remembered by a worker at most; all are forgotten when there are more.
REMEMBERED_BYTES = 64 << 20
#: What a piece takes besides its bytes and ids: a string, an entry of a dictionary, and two numbers.
_PIECE_BYTES = 150
#: Bytes of pieces that go through the library as one text, about; a longer piece goes alone.
JOINED_BYTES = 1 << 14
#: First bytes of characters of which some are white space: they count as such on either side of a cut.
_DOUBTFUL = (0xC2, 0xE1, 0xE2, 0xE3)
#: Bytes at which a piece may begin: space, line feed and ASCII marks other than the apostrophe and those
#: (bar, greater-than, bracket, underscore) that follow a letter within special tokens.
_CUTS = np.zeros(256, bool)
_CUTS[[32, 10, *b'!"#$%&()*+,-./:;<=?@[^`{}~']] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True

_encoders: dict[int, "PieceEncoder"] = {}
kept_by_workers["encoders"] = _encoders.clear


def vocabulary_of(tokenizer_json: str) -> int:
    """One more than the largest id, of added tokens too."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).values(), default=0) + 1


def cuts_apply(tokenizer_json: str) -> bool:
    """Whether ids of the pieces that texts are cut into are those of whole texts, for this tokenizer."""
    made = json.loads(tokenizer_json)
    before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or made.get("normalizer") or model.get("type") != "BPE" or made.get("truncation") or made.get("padding"):
        return False
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    for token in made.get("added_tokens", ()):
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
            return False
        own = token["content"].encode()
        for left in (b"a", b"."):
            cuts = _cuts(np.frombuffer(left + own + b"a", np.uint8))
            if ((cuts > 1) & (cuts < 1 + len(own))).any():
                return False
    return True


class PieceEncoder:
    """``pieces`` says whether texts may be cut; who has asked ``cuts_apply`` before spares every worker from parsing the file."""

    def __init__(self, tokenizer_json: str, pieces: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.pieces = cuts_apply(tokenizer_json) if pieces is None else pieces
        self.lengths = _lengths(self.tokenizer) if self.pieces else None
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.size = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: pa.LargeStringArray, new: np.ndarray, texts: list[str]) -> None:
        """The next rows are those of the new ones of the pieces, which are the texts."""
        row = len(self.rows)
        while row + len(new) > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        together = _may_follow(pieces)[new] if self.lengths is not None else np.zeros(len(new), bool)
        places = np.flatnonzero(together)
        if len(places):
            text, offsets = _bytes_of(pieces.take(pa.array(new[places])))
            starts = np.flatnonzero(np.diff(offsets[:-1] // JOINED_BYTES, prepend=-1)).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(places)], strict=True):
                at = offsets[lo : hi + 1] - offsets[lo]
                joined = text[offsets[lo] : offsets[hi]].tobytes().decode()
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
                borders = np.searchsorted(ends, at)
                if ends[-1] == at[-1] and (ends[borders] == at).all():
                    self._keep(row + places[lo:hi], ids, np.diff(borders))
                else:  # an id that stands for other bytes than its token's
                    together[places[lo:hi]] = False
        places = np.flatnonzero(~together)
        for lo in range(0, len(places), 4096):
            part = [texts[k] for k in places[lo : lo + 4096].tolist()]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            ids = np.array(list(chain.from_iterable(found)), np.uint32)
            self._keep(row + places[lo : lo + 4096], ids, np.fromiter(map(len, found), np.int64, len(found)))
        self.rows.update(zip(texts, range(row, row + len(texts)), strict=True))
        self.size += sum(map(len, texts)) + _PIECE_BYTES * len(texts)

    def _keep(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[rows] = self.used + np.cumsum(sizes) - sizes
        self.count[rows] = sizes
        self.used += len(ids)
        self.size += 4 * len(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids before each (n + 1)."""
        column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
        n = len(column)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        text, offsets = _bytes_of(column)
        cuts = _merged(_cuts(text) if self.pieces else np.zeros(0, np.int64), offsets)
        pieces = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text)
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if self.size > REMEMBERED_BYTES:
            self.forget()
        rows = np.fromiter(map(self.rows.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(rows < 0)
        rows[new] = np.arange(len(self.rows), len(self.rows) + len(new))
        self._learn(pieces.dictionary, new, [distinct[k] for k in new.tolist()])
        if len(cuts) > 1:
            rows = rows[pieces.indices.to_numpy()]
        sizes = self.count[rows]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.first[rows] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.searchsorted(cuts, offsets)]


def _lengths(tokenizer) -> np.ndarray | None:
    """The bytes that each id stands for, or None if some byte has no id, and so is left out of the ids."""
    from tokenizers.pre_tokenizers import ByteLevel

    own = tokenizer.get_vocab(with_added_tokens=True)
    if not own.keys() >= set(ByteLevel.alphabet()):
        return None
    out = np.zeros(max(own.values()) + 1, np.int64)
    out[list(own.values())] = list(map(len, own))
    for k, token in tokenizer.get_added_tokens_decoder().items():
        out[k] = len(token.content.encode())
    return out


def _bytes_of(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the strings, and where each begins and the last ends."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    base = int(offsets[0])
    return np.frombuffer(data, np.uint8, int(offsets[-1]) - base, base) if data else np.zeros(0, np.uint8), offsets - base


def _may_follow(pieces: pa.LargeStringArray) -> np.ndarray:
    """Which pieces may go through the library as one text: where they follow one another, ``_cuts`` has their borders.

    They are short, begin with a single space and end with what isn't white space.
    """
    text, offsets = _bytes_of(pieces)
    sizes = np.diff(offsets)
    ok = (sizes > 1) & (sizes <= JOINED_BYTES)
    first, last = offsets[:-1][ok], offsets[1:][ok] - 1
    right, left = text[first + 1], text[last]
    wide = (left >= 128) & (np.isin(text[last - 1], _DOUBTFUL) | np.isin(text[np.maximum(last - 2, 0)], _DOUBTFUL))
    ok[ok] = (text[first] == 32) & (right > 32) & (right != 127) & ~np.isin(right, _DOUBTFUL) & (left > 32) & (left != 127) & ~wide
    return ok


def _cuts(text: np.ndarray) -> np.ndarray:
    """Places between two characters that certainly belong to different pre-tokens."""
    if len(text) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(_CUTS[text[1:-1]]) + 1
    own, left, right = text[at], text[at - 1], text[at + 1]
    lead = text[np.maximum(at - 2, 0)]
    wide = (left >= 128) & (np.isin(lead, _DOUBTFUL) | np.isin(text[np.maximum(at - 3, 0)], _DOUBTFUL))
    alone = (left > 32) & (left != 127) & ~wide & (right > 32) & (right != 127) & ~np.isin(right, _DOUBTFUL)
    space, line = alone & (own == 32), alone & (own == 10)
    latin = (lead == 0xC3) & (left != 0x97) & (left != 0xB7) & (left < 0xC0) & (left >= 128)
    mark = (own > 32) & (_LETTERS[left] | latin)
    return _merged(at[space | line | mark], at[line] + 1)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct numbers of two sorted arrays, in order."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both


def encoder(tokenizer_json: str, pieces: bool) -> PieceEncoder:
    """This worker's encoder for a tokenizer; it outlives tasks."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(tokenizer_json, pieces)
    return _encoders[key]
