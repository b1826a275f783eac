"""Language-model scores against plain counts, and the filter's answers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyreel.llm import lm
from skyreel.llm.queries import QUERIES, held_out

from plain import words

SCHEMA = "row long, doc_id long, text string, gram string, n int"
END = None


def frame(spark, rows):
    return spark.createDataFrame([(7, d, t, "x", 1) for d, t in rows], SCHEMA).repartition(4)


def quantised(n):
    return float(lm.VALUES[lm.level_of(np.array([n]))[0]]) if n else 0.0


def plain(train, every, order, cutoff):
    """(n_tokens, n_known, base_score, score) of every text, from counts of word tuples."""
    lists = [[*words(t), END] for t in train]
    counts = [Counter() for _ in range(order)]
    padded = lambda tokens, i, k: tuple(tokens[j] if j >= 0 else END for j in range(i - k + 1, i + 1))
    for tokens in lists:
        for k in range(order):
            counts[k].update(padded(tokens, i, k + 1) for i in range(len(tokens)))
    for k in range(1, order - 1):
        counts[k][(END,) * (k + 1)] += len(lists)
    total, distinct = sum(counts[0].values()), len(counts[0])
    exact = dict(counts[0])
    for k in range(1, order):
        counts[k] = {g: n for g, n in counts[k].items() if n >= cutoff}
    c = lambda g: quantised(counts[len(g) - 1].get(g, 0))
    level = lambda g: int(lm.level_of(np.array([counts[len(g) - 1].get(g, 0)]))[0])
    won, lost = Counter(), Counter()
    for tokens in lists:
        for i in range(len(tokens)):
            below = max(c(padded(tokens, i, 1)) - 1, 0) / max(total - 1, 1)
            for k in range(2, order + 1):
                context = padded(tokens, i - 1, k - 1)
                share = max(c(padded(tokens, i, k)) - 1, 0) / max(c(context) - 1, 1) if c(context) > 1 else 0
                (won if share >= below and share > 0 else lost)[k, level(context)] += 1
                below = share
    out = []
    for text in every:
        tokens, base, score, known = [*words(text), END], 0.0, 0.0, 0
        for i in range(len(tokens)):
            n = exact.get((tokens[i],), 0)
            known += n > 0
            base += math.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
            p = min((c((tokens[i],)) + 0.5) / (total + 0.5 * (distinct + 1)), 1)
            for k in range(2, order + 1):
                context = padded(tokens, i - 1, k - 1)
                key = k, level(context)
                weight = won[key] / (won[key] + lost[key] + 1) if c(context) else 0
                p = weight * min(1, c(padded(tokens, i, k)) / max(c(context), 1)) + (1 - weight) * p
            score += math.log10(p)
        out.append((len(tokens), known, base, score))
    return out


def texts(rng, count):
    some = "The a of  house\tIS Ünder große\nTHE zwölf \x0b a".split(" ") + ["x" * 400]
    rows = [(rng.choice([None, k, 1]), rng.choice([None, "", " \n ", *[" ".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(9)]])) for k in range(count)]
    return rows + rows[:9] + [(3, "a of a of never " * 700)]


@pytest.mark.parametrize("order, cutoff, most, common, held", [(2, 2, 1 << 27, 1 << 20, 1 << 22), (3, 1, 1 << 27, 4, 50), (2, 1, 0, 3, 1 << 22), (3, 2, 0, 0, 300), (1, 1, 1 << 27, 1 << 20, 50)])
def test_against_plain_counts(spark, monkeypatch, order, cutoff, most, common, held):
    for name, value in [("ITEM_BITS", 6400), ("FILTER_MOST", most), ("COMMON_WORDS", common), ("HELD", held), ("SALTS", 3)]:
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(order + held)
    train, more = texts(rng, 60), [*texts(rng, 30), (9, "nothing known here")]
    model = lm.train(frame(spark, train), order, cutoff)
    assert (model.loaded is None) == (most == 0)
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.scored(frame(spark, train + more), model).collect())
    want = sorted((n, k, round(b, 6), round(s, 6)) for n, k, b, s in plain([t for _, t in train], [t for _, t in train + more], order, cutoff))
    assert len(got) == len(want) and np.allclose(np.array(got), np.array(want), atol=3e-6)


@pytest.mark.parametrize("order, files_most, per_file", [(2, 1 << 32, 3), (3, 1 << 32, 1), (2, 0, 3)])
def test_a_large_filter_gives_the_same(spark, monkeypatch, order, files_most, per_file):
    """In files no text moves; beyond the files its n-grams are shuffled."""
    monkeypatch.setattr(lm, "ITEM_BITS", 64_000)  # several segments
    monkeypatch.setattr(lm, "COMMON_WORDS", 4)
    rng = random.Random(order + per_file)
    docs = frame(spark, texts(rng, 60))
    rows = lambda model: sorted(map(str, ((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.scored(docs, model).collect())))
    whole = lm.train(docs, order)
    assert whole.loaded is not None and whole.segments > 2 * per_file
    for name, value in [("FILTER_MOST", 0), ("FILES_MOST", files_most), ("SLICE_SEGMENTS", per_file)]:
        monkeypatch.setattr(lm, name, value)
    model = lm.train(docs, order)
    assert model.loaded is None and (model.files is None) == (files_most == 0)
    assert all((a == b).all() for a, b in zip(model.weights, whole.weights))
    assert rows(model) == rows(whole)
    if files_most:
        assert len(model.files) == -(-model.segments // per_file)
        assert "__segment" not in lm.scored(docs, model)._jdf.queryExecution().optimizedPlan().toString()


def test_no_rows(spark):
    model = lm.train(frame(spark, []))
    assert lm.scored(frame(spark, []), model).collect() == []
    row = lm.scored(frame(spark, [(1, "some words")]), model).first()
    assert (row.n_tokens, row.n_known, row.base_score, row.score) == (3, 0, 0.0, 0.0)


def test_levels(spark):
    counts = [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15, 16, 23, 24, 1000, 1 << 40, (3 << 40) - 1, 3 << 40]
    told = spark.createDataFrame([(n,) for n in counts], "n long").select("n", lm._level(F.col("n")).alias("level")).collect()
    assert [r.level for r in told] == lm.level_of(np.array(counts)).tolist()
    assert [quantised(n) for n in (1, 2, 3, 5, 6)] == [1, 2, 3, 4.5, 6.5]


def test_a_filter_only_ever_raises_levels():
    rng = np.random.default_rng(1)
    grams, level = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64), rng.geometric(0.6, 30_000)
    bits = np.zeros((1, lm.SEGMENT_WORDS), np.uint64)
    for step in range(1, level.max() + 1):
        word, mask = lm._marks(grams[level >= step], step)
        np.bitwise_or.at(bits[0], word, mask)
    zero = np.zeros(len(grams), np.int64)
    assert (lm.probe(bits, zero, grams) >= level).all()
    assert level.sum() * lm.ITEM_BITS > 0.9 * bits.size * 64  # as full as filters get
    others = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    assert (lm.probe(bits, zero, others) > 0).mean() < 0.03


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_lm_scoring"](spark, folder).collect()}
    rows = documents.select("doc_id", "text", held_out(5, 1).alias("held")).collect()
    want = plain([r.text for r in rows if not r.held], [r.text for r in rows], 2, 2)
    assert len(got) == len(rows) == len(want)
    for r, (n, known, base, score) in zip(rows, want):
        mine = got[r.doc_id]
        assert (mine.held_out, mine.n_tokens, mine.n_known) == (r.held, n, known)
        assert abs(mine.base_score - base) < 1e-6 * max(1, -base)
    assert abs(sum(r.score for r in got.values()) / sum(s for *_, s in want) - 1) < 0.02  # what false answers of the filter change
    held = [got[r.doc_id] for r in rows if r.held]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the held-out texts are likelier under the model
