"""What the shared helpers promise."""

import pyarrow as pa
import pytest

from skyreel.llm import hashing, postings
from skyreel.session import shared_root


@pytest.mark.parametrize("piece", [16, 64, 1 << 19])
def test_word_hashes_do_not_depend_on_the_cut(monkeypatch, piece):
    texts = ["", "Über den Ä", "a" * 500, " lead and  trail\x0b\x0c", "one two three four five six\nseven", "A B c"] * 3
    whole = [h.tolist() for t in texts for h, _ in [hashing.word_hashes(*_bytes(t))]]
    monkeypatch.setattr(hashing, "PIECE", piece)
    assert [h.tolist() for t in texts for h, _ in [hashing.word_hashes(*_bytes(t))]] == whole
    assert [len(h) for h in whole[:6]] == [0, 3, 1, 3, 7, 3]
    assert whole[5][0] == hashing.word_hashes(*_bytes("a"))[0][0]


def _bytes(text):
    data, offsets = hashing.text_bytes(pa.array([text]))
    return data, offsets[:-1]


def test_null_texts_are_empty():
    data, offsets = hashing.text_bytes(pa.array(["ab", None, "c"]).slice(1))
    assert bytes(data[offsets[0] : offsets[-1]]) == b"c" and (offsets[1:] - offsets[:-1]).tolist() == [0, 1]


def test_filters_keep_every_similar_pair():
    for n in range(1, 60):
        for m in range(n, 80):
            for common in range(n + 1):
                if postings.linked(common, n, m):
                    assert postings.fitting(n, m)
                    # the first common token lies within either prefix
                    assert n - common < n - postings.needed(n) + 1 and m - common < m - postings.needed(m) + 1
                    assert postings.similar_enough(n, m, n - common, m - common)


def test_shared_root(spark):
    assert shared_root(spark)
