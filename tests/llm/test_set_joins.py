"""Group join and line dedup against plain loops."""

import random

import pytest
from plain import components, kept_text, shingles
from pyspark.sql import types as T

from skyreel.llm import group_join, line_dedup

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("id", T.StringType()), T.StructField("n_chars", T.LongType())])


def rows_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", len(t or "")) for d, t in rows], SCHEMA)


def hot_group(size=400, seed=3):
    """Near copies of one passage: exact, lightly and heavily edited, so that some are linked only through others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(90)]
    out = []
    for k in range(size):
        text = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            text[rng.randrange(len(text))] = word()
        if k % 3 == 0:
            text = text[: 60 + k % 30]
        out.append((1000 + k, " ".join(text)))
    return out


def check_groups(spark, rows):
    want = components([shingles(t) for _, t in rows])
    got = {r.doc_id: r for r in group_join.near_groups(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (doc, text), root in zip(rows, want):
        assert got[doc].n_shingles == len(shingles(text))
        assert got[doc].component_id == rows[root][0]


def test_groups_of_documents(spark):
    check_groups(spark, rows_of(spark))


def test_groups_of_a_hot_passage(spark):
    check_groups(spark, sorted(hot_group() + [(1, ""), (2, "a b"), (3, "A  B"), (4, " \n\t"), (5, "x " * 3000)]))


def test_group_edges(spark):
    rows = [(None, "a b c d e f"), (7, None), (7, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (11, "é x")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in group_join.near_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0, None), (7, 0, 7), (7, 2, 7), (9, 2, 7), (9, 2, 7), (11, 1, 11)], key=str)
    assert group_join.near_groups(frame(spark, [])).count() == 0


def check_lines(spark, rows):
    got = {r.doc_id: r for r in line_dedup.without_later_lines(frame(spark, rows)).collect()}
    want = kept_text(rows)
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(want[d]) for d, r in got.items())


def test_lines_of_documents(spark):
    check_lines(spark, rows_of(spark))


def test_lines_of_a_hot_passage(spark):
    hot = hot_group(200)
    check_lines(spark, [(d, f"{t}\n\n{hot[k - 1][1]} tail\nshort line") for k, (d, t) in enumerate(hot)])


def test_line_edges(spark):
    rows = [(None, "a b c d e\na b c d e"), (1, None), (2, ""), (3, "a b c d e\nx\na b c d e"), (4, "\n\nA B C D  E\n")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.without_later_lines(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, "a b c d e\na b c d e"), (1, None), (2, ""), (3, "a b c d e\nx"), (4, "\n\n")], key=str)
    assert line_dedup.without_later_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [1, 2])
def test_long_texts(spark, size):
    rng = random.Random(size)
    text = " ".join(f"{rng.randrange(5000)}" for _ in range(400_000 * size))
    check_groups(spark, [(1, text), (2, text.upper() + " tail"), (3, text[: len(text) // 2])])
