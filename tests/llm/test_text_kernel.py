import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import textkernel as tk

WORD = re.compile(r"[^\x20\x09-\x0d]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b😀.", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_match_the_pattern(column, limit):
    got, hashes = [], {}
    for block in tk.blocks(pa.array(column, pa.string()), limit):
        starts, ends, first = tk.words(block)
        h = tk.hash_words(block.data, starts, ends)
        for d in range(len(block)):
            ws = [block.data[starts[i] : ends[i]].tobytes().decode() for i in range(first[d], first[d + 1])]
            got.append(ws)
            for w, x in zip(ws, h[first[d] : first[d + 1]], strict=True):
                assert hashes.setdefault(w, x) == x
    assert got == [WORD.findall(t or "") for t in column]
    assert len(set(hashes.values())) == len(hashes)


def test_slices_and_windows():
    a = pa.array(["skip", "a b c d", None, "e f", "g h i"]).slice(1)
    block = next(iter(tk.blocks(a)))
    starts, ends, first = tk.words(block)
    at, doc = tk.window_starts(first, 3)
    assert list(at) == [0, 1, 6] and list(doc) == [0, 0, 3]
    assert list(tk.covered(np.array([0, 6]), 3, 9)) == [True] * 3 + [False] * 3 + [True] * 3
    h = tk.hash_words(block.data, starts, ends)
    assert len(set(tk.roll(h, 3, 1))) == 7 and len(tk.roll(h, 99, 1)) == 0


def test_empty_column():
    assert list(tk.blocks(pa.array([], pa.string()))) == []
