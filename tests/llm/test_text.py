import random

import numpy as np
import pyarrow as pa

from quern.llm import _text as T


def words_of(texts, members=T.NON_SPACE):
    data, offsets = T.byte_view(T.as_text(pa.array(texts, pa.string())))
    w = T.find_words(data, offsets, members)
    raw = data.tobytes()
    return w, [[raw[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]


def test_words_do_not_cross_texts():
    texts = ["a b", "c", "", None, " d  e ", "f\x00g h", "x" * 700]
    _, got = words_of(texts)
    assert got == [(t or "").encode().split() if "\xa0" not in (t or "") else [t.encode()] for t in texts]
    sliced = pa.array(["zz", *texts], pa.string())[1:]
    data, offsets = T.byte_view(T.as_text(sliced))
    assert list(T.find_words(data, offsets, T.NON_SPACE).counts) == [len(x) for x in got]


def test_hashes_follow_content():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \0") for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["q" * n for n in (255, 256, 257, 258, 600, 601)]
    w, got = words_of(texts)
    h = T.hash_ranges(w.data, w.starts, w.ends)
    seen = {}
    for word, value in zip([x for t in got for x in t], h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_rolling_matches_definition():
    h = np.arange(1, 60, dtype=np.uint64) * np.uint64(977)
    for width in (1, 2, 3, 5, 8, 35, 59, 60):
        want = [sum(int(x) * pow(31, width - 1 - j) for j, x in enumerate(h[i : i + width])) % 2**64 for i in range(len(h) - width + 1)]
        assert T.rolling(h, width, 31).tolist() == want


def test_slices_and_masks():
    assert list(T.slices(np.array([0, 3, 4, 50, 51, 52]), 5)) == [(0, 2), (2, 3), (3, 5)]
    assert T.covered(6, np.array([1, 4]), 2).tolist() == [False, True, True, False, True, True]
    assert [x.tolist() for x in T.runs(np.array([True, False, True, True]))] == [[0, 2], [1, 4]]
