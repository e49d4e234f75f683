import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.textops import shingle_hashes, text_bytes, word_hashes, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\né,", max_size=30)), max_size=8)


def split(texts, lower=False):
    data, offsets = text_bytes(pa.array(texts, pa.string()), lower)
    starts, lengths, at = words(data, offsets)
    found = [data[s : s + n].tobytes().decode() for s, n in zip(starts, lengths, strict=True)]
    return [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], data, starts, lengths, at


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_each_text(texts):
    assert split(texts)[0] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_shingles_are_those_of_each_text(texts):
    lists, data, starts, lengths, at = split(texts)
    hashes, ends = shingle_hashes(word_hashes(data, starts, lengths), at, 3)
    wanted = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * bool(w) for w in lists]
    assert np.diff(ends).tolist() == [len(x) for x in wanted]
    seen = {}
    for shingle, h in zip((s for x in wanted for s in x), hashes.tolist(), strict=True):
        assert seen.setdefault(shingle, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lower_case_is_ascii_only():
    assert split(["AbÉ Z"], lower=True)[0] == [["abÉ", "z"]]


def test_long_words_differ_in_their_last_byte():
    _, data, starts, lengths, _ = split(["a" * 1000 + " " + "a" * 999 + "b" + " " + "a" * 999])
    assert len(set(word_hashes(data, starts, lengths).tolist())) == 3
