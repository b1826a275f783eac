"""Surrogates: nothing found is left, forms and types are kept, one entity has one surrogate, different ones differ."""

import re

import pytest
from pyspark.sql import types as T

from skyreel.llm import surrogates

FOLDER = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kinds", T.StringType()), T.StructField("mark", T.StringType()), T.StructField("n_chars", T.LongType())])
EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
PLAIN = {
    "email": re.compile(r"[a-z]+\.\d\d@mail\d\.example\.com"),
    "phone": re.compile(r"\+1 \(\d{3}\) 555-\d{4}"),
    "address": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])"),
    "card": re.compile(r"(?<!\d)\d{16}(?!\d)"),
    "secret": re.compile(r'(?<=")[0-9a-f]{28,40}(?=")'),
}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", len(t or "")) for d, t in rows], SCHEMA)


def said(spark, rows, key="k"):
    return {r.doc_id: r for r in surrogates.replaced(frame(spark, rows), key).collect()}


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def test_forms(spark):
    got = said(spark, [
        (1, "Write ANNA.LEE@MAIL2.EXAMPLE.COM, anna.lee@mail2.example.com; +1 (988) 555-2485 or +1 988 555 2485. 4111-1111-1111-1111, 4111111111111111."),
        (2, "Mr. John Smith and Frau Erika Mustermann, Herr John Smith, Госпожа Анна Иванова, Κύριος Νίκος Παππάς; 10.20.30.40."),
    ])
    one, two = got[1].text, got[2].text
    upper, lower = EMAIL.findall(one)
    assert upper == upper.upper() and upper.lower() == lower and lower.endswith(".com") and lower != "anna.lee@mail2.example.com"
    phones = re.search(r"(\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4})\.", one)
    assert re.sub(r"\D", "", phones[1]) == re.sub(r"\D", "", phones[2]) != "19885552485"
    cards = re.search(r"(4\d{3}(?:-\d{4}){3}), (4\d{15})\.$", one)
    assert cards[1].replace("-", "") == cards[2] != "4111111111111111" and luhn(cards[2])
    names = re.match(r"Mr\. (\w+ \w+) and Frau (\w+) \w+, Herr (\w+ \w+), Госпожа (\w+) \w+, Κύριος (\w+) \w+; \d+\.\d+\.\d+\.\d+\.$", two)
    assert names[1] == names[3] != "John Smith"
    assert names[1].split()[0] in surrogates.GIVEN["latin m"] and names[2] in surrogates.GIVEN["latin f"]
    assert names[4] in surrogates.GIVEN["cyrillic f"] and names[5] in surrogates.GIVEN["greek m"]
    assert (got[1].n_entities, got[2].n_entities) == (6, 6)


def test_documents(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r.text for r in source.collect()}
    after = {r.doc_id: r.text for r in surrogates.replaced(source, "k").collect()}
    assert set(before) == set(after)
    swaps = {}
    for doc, text in before.items():
        for kind, pattern in PLAIN.items():
            for old in pattern.findall(text):
                assert old not in after[doc], (kind, old)
                swaps.setdefault((kind, old), set())
        if not any(p.search(text) for p in PLAIN.values()):
            assert after[doc] == text
    assert len(swaps) > 30
    wide = spark.createDataFrame([(k, old) for k, (_, old) in enumerate(swaps)], "doc_id long, text string")
    new = [r.text for r in surrogates.replaced(wide, "k").collect()]
    assert len(set(new)) == len(swaps) and not set(new) & {old for _, old in swaps}


def test_collisions_are_redrawn(spark, monkeypatch):
    for group in surrogates.SYLLABLES:
        monkeypatch.setitem(surrogates.SYLLABLES, group, ["ab", "cd"])
    names = [f"Mr {a}{b}" for a in "BCDFGH" for b in ("ola", "une")]  # 12 names, 16 surrogates
    got = said(spark, list(enumerate(names)))
    assert len({r.text for r in got.values()}) == len(names)


def test_scripts_without_case(spark):
    mails = ["王小明@例子.com", "محمد٣٤@مثال.com", "あい@カナ.jp", "김철수@도메인.kr", "ˢʰ@ː.ru", "--@-.co"]
    got = said(spark, list(enumerate(mails)))
    new = [got[k].text for k in range(len(mails))]
    assert len({*new, *mails}) == 2 * len(mails)
    for old, fresh, low, high in zip(mails, new, "一ؠぁ가", "鿯ۓヺ힣"):
        assert len(old) == len(fresh) and old.rpartition(".")[2] == fresh.rpartition(".")[2]
        for a, b in zip(*(t.rpartition(".")[0] for t in (old, fresh))):
            assert a == b == "@" or ("٠" <= b <= "٩" if "٠" <= a <= "٩" else low <= b <= high)


def test_more_entities_than_the_first_pool(spark, monkeypatch):
    for group in surrogates.SYLLABLES:
        monkeypatch.setitem(surrogates.SYLLABLES, group, ["ab", "cd"])  # 16 surrogates of the first length
    monkeypatch.setattr(surrogates, "PHONE_TRIES", 1, raising=False)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{a.upper()}{b}" for a in "bcdfgh" for b in ("ola", "une", "ir", "ott", "ump", "erg", "ino", "est")]
    mails = [f"{a}@{b}.co" for a in letters for b in letters]
    phones = [f"+1{k:04}" for k in range(10_000)]
    got = said(spark, [(1, "; ".join(f"Mr {n}" for n in names)), (2, "; ".join(mails)), (3, "; ".join(phones))])
    for doc, old in ((1, [f"Mr {n}" for n in names]), (2, mails), (3, phones)):
        new = got[doc].text.split("; ")
        assert len(new) == len(old) == got[doc].n_entities and len({*new, *old}) == 2 * len(old)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.co", m) for m in got[2].text.split("; "))
    assert all(re.fullmatch(r"\+1\d{4,}", m) for m in got[3].text.split("; "))


def test_another_key(spark):
    rows = [(1, "10.20.30.40")]
    assert said(spark, rows, "a")[1].text != said(spark, rows, "b")[1].text
    assert said(spark, rows, "a")[1].text == said(spark, rows, "a")[1].text


@pytest.mark.parametrize("text", ["version 3.0 of 2024", "1.2.3", "plain words", "@ @ 12", "Licensed under CC BY-NC 4.0."])
def test_left_alone(spark, text):
    assert said(spark, [(1, text)])[1].text == text


def test_edges(spark):
    long = ("word 10.20.30.40 " * 20_000).strip()
    rows = [(None, "10.20.30.40"), (1, None), (2, ""), (3, "10.20.30.40"), (3, "10.20.30.40"), (4, long)]
    out = surrogates.replaced(frame(spark, rows), "k")
    assert out.columns == ["doc_id", "text", "mark", "n_chars", "n_entities", "kinds"]
    got = out.collect()
    assert sorted((str(r.doc_id), r.n_entities, tuple(r.kinds)) for r in got) == [("1", 0, ()), ("2", 0, ()), ("3", 1, ("address",)), ("3", 1, ("address",)), ("4", 20_000, ("address",)), ("None", 1, ("address",))]
    address = next(r.text for r in got if r.doc_id == 3)
    assert all(r.n_chars == len(r.text) for r in got if r.text)
    assert next(r.text for r in got if r.doc_id == 4) == long.replace("10.20.30.40", address)
    assert surrogates.replaced(frame(spark, []), "k").count() == 0


def test_names_end_at_titles_and_columns_may_be_called_anything(spark):
    text = "Mr. Jones Mr Jones met Frau Anna Maria Schmidt Haus Boot."
    rows = spark.createDataFrame([(1, text, "a", "b", "c", "d")], "doc_id long, text string, __swaps string, __mark string, __length string, __kinds string")
    got = surrogates.replaced(rows, key="k").first()
    assert got.n_entities == 3 and got["__swaps"] == "a" and got["__kinds"] == "d"
    first, second = got.text.removeprefix("Mr. ").split(" met ")[0].split(" Mr ")
    assert first == second != "Jones" and got.text.endswith(" Haus Boot.")
