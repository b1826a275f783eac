"""Fitted operators: held-out accuracy on the tables, and their behaviour at the edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyreel.llm import language, quality, toxicity
from skyreel.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("y", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "z") for d, t in rows], SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name, label, parts, left, bar, least", [("op3_quality_classifier", "quality", 4, 2, 0.7, 0.97), ("op7_toxicity", "toxic", 5, 0, 0.5, 0.97)])
def test_held_out_accuracy(spark, name, label, parts, left, bar, least):
    got = QUERIES[name](spark, FOLDER).toPandas().set_index("doc_id")
    assert len(got) == len(table(spark, "documents"))
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % parts == left for d in got.index]).all()
    assert (got.predicted == (got.score >= bar)).all()
    known = table(spark, "labels").drop_duplicates("doc_id").set_index("doc_id")[label]
    held = got[got.held_out & got.index.isin(known.index)]
    assert (held.predicted == known[held.index]).mean() > least


def test_languages(spark):
    got = QUERIES["op8_language_id"](spark, FOLDER).toPandas().set_index("doc_id")
    lang = table(spark, "documents").set_index("doc_id").lang
    held = got[got.held_out]
    assert (held.lang_pred == lang[held.index]).mean() > 0.97
    sure = held[~held.rejected]
    assert (sure.lang_pred == lang[sure.index]).mean() >= (held.lang_pred == lang[held.index]).mean()


def test_language_edges(spark):
    rows = [(1, None), (2, ""), (3, "123 --"), (None, "bonjour le la les des bonjour le la"), (4, "hello there"), (4, "hello there")]
    learned = {"en": b"hello there the of and " * 50, "fr": b"bonjour le la les des " * 50}
    got = sorted((str(r.doc_id), r.lang_pred, r.score == 0) for r in language.identified(frame(spark, rows), learned).collect())
    assert got == [("1", "und", True), ("2", "und", True), ("3", "und", True), ("4", "en", False), ("4", "en", False), ("None", "fr", False)]
    assert {r.lang_pred for r in language.identified(frame(spark, rows), {}).collect()} == {"und"}
    assert language.identified(frame(spark, []), learned).count() == 0
    assert language.dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_short_languages_shrink_no_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("bdgkmnptvzaeiou"), 6)) for _ in range(150)]
    said = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(-1, "Ten chars.", "aa"), (-2, "", "ab"), (-3, said(600), "zz")]
    known = docs.where("doc_id % 3 <> 1")
    alone = language.dictionaries(known)
    learned = language.dictionaries(known.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert {k: v for k, v in learned.items() if k in alone} == alone
    assert set(learned) == {*alone, "aa", "zz"} and min(map(len, alone.values())) > 10_000
    held = docs.where("doc_id % 3 = 1")
    held = held.unionByName(spark.createDataFrame([(-4 - k, said(40), "zz") for k in range(20)], held.schema))
    want = {r.doc_id: r.lang for r in held.collect()}
    got = {r.doc_id: r.lang_pred for r in language.identified(held, learned).collect()}
    assert sum(got[d] == want[d] for d in want if d >= 0) > 0.97 * (len(want) - 20)
    assert all(got[-4 - k] == "zz" for k in range(20))
    two = {k: learned[k] for k in ("aa", "en")}
    english = held.where("lang = 'en'")
    assert sum(r.lang_pred == "en" for r in language.identified(english, two).collect()) > 0.97 * english.count()


def test_offending_sentences(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(400):
        said = [" ".join(rng.choice(words, 6)) for _ in range(5)]
        if k % 4 == 0:
            said[k % 5] += " vile"
        rows.append((k, ". ".join(said)))
        labels.append((k, int(k % 4 == 0)))
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, y int"))
    for r in toxicity.scored(docs, model).collect():
        text = rows[r.doc_id][1]
        assert [text[s.begin : s.end].strip().endswith("vile") for s in r.offending] == ([True] if r.doc_id % 4 == 0 else [])
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {k for k in range(400) if k % 4}
    edge = frame(spark, [(1, None), (2, ""), (None, "so vile"), (3, "vile " * 50_000), (3, "w1")])
    got = sorted((str(r.doc_id), r.score >= 0.5) for r in toxicity.scored(edge, model).collect())
    assert got == [("1", False), ("2", False), ("3", False), ("3", True), ("None", True)]
    assert toxicity.without_toxic(edge, model).columns == edge.columns


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, y int")
    assert all(r.score < 1e-9 for r in toxicity.scored(docs, toxicity.train(docs, none)).collect())
    same = spark.createDataFrame([(1, 1)], "doc_id long, y int")
    assert max(r.score for r in toxicity.scored(docs, toxicity.train(docs, same)).collect()) > 0.99


def test_quality_edges(spark):
    rows = [(k, ("fine words in a row " if k % 2 else "@@ ## !! ") * (5 + k % 7)) for k in range(60)] + [(100, None), (101, ""), (None, "fine words"), (102, "x" * 100_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (5, None)], "doc_id long, y int")
    got = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= v <= 1 for v in got.values())
    assert all((got[k] > 0.5) == bool(k % 2) for k in range(60))
    assert {r.score for r in quality.scored(docs, labels.where("y = 1")).collect()} == {1 / (1 + np.exp(-30.0))}
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_rules_are_paths():
    tree = "DecisionTreeClassificationModel: x\n  If (feature 0 <= 1.5)\n   If (feature 0 <= 1.0)\n    Predict: 0.0\n   Else (feature 0 > 1.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    want = {frozenset({("characters", False, 1.5)}), frozenset({("characters", False, 1.0)}), frozenset({("characters", True, 1.0), ("characters", False, 1.5)}), frozenset({("characters", True, 1.5)})}
    assert {r.parts for r in quality.rules_of(tree)} == want


def test_statistics_count(spark):
    one = quality.measured(spark.createDataFrame([(1, "Ab ab ab, 12\nX")], "doc_id long, text string")).select(*(F.round(n, 4) for n in quality.NAMES)).first()
    assert tuple(one) == (14.0, 5.0, 2.8, 1.0, 0.1429, 0.0714, 0.1429, 0.0, 0.2)


def test_no_telling_feature_is_no_matter_of_length(spark):
    """Labels of both kinds and nothing that tells them apart: the share for every text with a word."""
    docs = frame(spark, [(k, "same words here. " * (1 + k % 3)) for k in range(40)] + [(100, "word. " * 1_000), (101, None), (102, " ."), (103, "one")])
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)], "doc_id long, y int"))
    got = {r.doc_id: (r.score, len(r.offending)) for r in toxicity.scored(docs, model).collect()}
    assert {got[k] for k in [*range(40), 100, 103]} == {(0.25, 0)} and {got[101], got[102]} == {(0.0, 0)}
    assert toxicity.without_toxic(docs, model).count() == 44 and toxicity.without_toxic(docs, model, 0.2).count() == 2


def test_samples_hold_a_row_a_document(spark):
    docs = frame(spark, [(1, f"text {k}") for k in range(500)] + [(2, "other"), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 0)], "doc_id long, y int")
    assert sorted((r.y, r.text) for r in toxicity._sampled(docs, labels).collect()) == [(0, ""), (0, "other"), (1, "text 0")]
    many = docs.selectExpr("doc_id", "text", "'en' as lang")
    assert language.dictionaries(many)["en"].count(b"text") == 1


def test_rarer_languages_beyond_the_bound(spark):
    rows = [(k, f"words of language {k % 5}", f"l{k % 5}") for k in range(50)] + [(100, "rare words", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(language.dictionaries(docs)) == {"l0", "l1", "l2", "l3", "l4", "zz"}
    assert set(language.dictionaries(docs, languages=5)) == {"l0", "l1", "l2", "l3", "l4"}
