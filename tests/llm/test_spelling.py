"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skyreel.llm import spelling

SCHEMA = "near string, doc_id long, text string, n long, word string, key int"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_counts(rows, least):
    out = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def plain_variants(counts, ratio):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, counts[w], form[w], counts[form[w]] if form[w] is not None else None, len(near[w]), root))
    return sorted(out)


def words(rng, count, letters="abé", sizes=(1, 9)):
    return {"".join(rng.choices(letters, k=rng.randint(*sizes))): 3 ** rng.randint(0, 9) for _ in range(count)}


def frame(spark, rows):
    return spark.createDataFrame([("x", d, t, 5, "y", 1) for d, t in rows], SCHEMA)


def found(df):
    return sorted((r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect())


def test_index_of_a_block():
    rng = random.Random(3)
    for sizes in [(1, 4), (4, 6), (1, 9)]:
        block = sorted(words(rng, 150, sizes=sizes))
        bucket = np.array([rng.randint(0, 3) for _ in block])
        i, j = spelling.near_in_block(block, bucket)
        got = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
        assert got == {frozenset((a, b)) for a in range(len(block)) for b in range(a) if bucket[a] == bucket[b] and is_near(block[a], block[b])}


@pytest.mark.parametrize("most, block, letters", [(1024, 1024, "abé"), (4, 8, "abé"), (1, 1, "abcdefgh"), (4, 16, "aaaaaaaab")])
def test_against_all_pairs(spark, monkeypatch, most, block, letters):
    monkeypatch.setattr(spelling, "BUCKET_MOST", most)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    counts = words(random.Random(most + block), 400, letters) | {"": 4, "𝔞𝔟": 2, "𝔞": 30, "x" * 3000: 1, "x" * 2999: 10, "x" * 1500 + "y" + "x" * 1500: 200}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.variants(table, 3)) == plain_variants(counts, 3)


def test_runs_of_long_texts(monkeypatch):
    pattern, text = re.compile("[a-c]{2,}"), "abc ab,abc  cab a" * 50
    whole = list(spelling._runs(pattern, text))
    monkeypatch.setattr(spelling, "HELD", 7)
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    assert list(spelling._runs(pattern, text)) == whole


@pytest.mark.parametrize("held", [200_000, 3])
def test_documents(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD", held)
    rng = random.Random(7)
    common = ["Straßenbahn", "écritures", "Multiple", "handling", "handlings", "OTHERWISE×÷", "a" * 900]
    rows = [(rng.choice([None, k, k]), rng.choice([None, "", "  ", *[" ".join(rng.choices(common, k=40)) for _ in range(6)]])) for k in range(150)]
    rows += rows[:20] + [(5, "Multiple,multiple;MULTIPLE") for _ in range(30)] + [(1, "Éclairage éclairage short")]
    counts = plain_counts(rows, 7)
    assert {(r.word, r.n) for r in spelling.word_counts(frame(spark, rows)).collect()} == set(counts.items())
    assert found(spelling.of_documents(frame(spark, rows))) == plain_variants({w: n for w, n in counts.items() if n >= 2}, 10)


def test_nothing(spark):
    assert spelling.of_documents(frame(spark, [])).collect() == []
    assert spelling.of_documents(frame(spark, [(1, None), (None, ""), (2, "once words appear")])).collect() == []
