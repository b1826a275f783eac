"""Trees, proofs and roots against a plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from skyreel.llm import manifest

SCHEMA = "text string, tree int, doc_id long, source string, lang string, n_chars long, hash string, part int"


def digest(*pieces):
    return hashlib.sha256("".join(pieces).encode()).hexdigest()


def piece(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc, more=0):
    return digest(*[piece(doc[c] + more if c == "n_chars" and doc[c] is not None else doc[c]) for c in manifest.FIELDS])


def tree(hashes, fanout):
    """The top, and each leaf's proof as pairs of what lies left and right."""
    proofs, owners = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        ups, owned = [], []
        for first in range(0, len(hashes), fanout):
            run = hashes[first : first + fanout]
            for s in range(len(run)):
                for i in owners[first + s]:
                    proofs[i].append(("".join(run[:s]), "".join(run[s + 1 :])))
            ups.append(digest(*run))
            owned.append([i for o in owners[first : first + fanout] for i in o])
        hashes, owners = ups, owned
    return hashes[0] if hashes else None, proofs


def plain(docs, fanout):
    groups = {}
    for doc in docs:
        groups.setdefault(doc["lang"], []).append(doc)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    rows, tops = [], []
    for g in order:
        members = sorted(groups[g], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
        top, proofs = tree([leaf(d) for d in members], fanout)
        rows.append(list(zip(members, proofs)))
        tops.append(top)
    root, upper = tree(tops, fanout)
    out = []
    for k, members in enumerate(rows):
        for doc, proof in members:
            hit = doc["doc_id"] is not None and zlib.crc32(str(doc["doc_id"]).encode()) % 7 == 0
            out.append((str(doc["doc_id"]), leaf(doc), leaf(doc, int(hit)), tops[k], root, tuple(proof + upper[k])))
    return sorted(out)


def documents(rng, count):
    langs = [None, "", "en", "en", "en", "en", "é", "z", "fr"]
    docs = [{"doc_id": rng.choice([None, i, i, i, i // 2]), "source": rng.choice([None, "", "src"]), "lang": rng.choice(langs), "n_chars": rng.choice([None, 0, i]), "text": rng.choice([None, "", "ä\n" * i, "word " * 3000])} for i in range(count)]
    return docs + docs[: count // 3] + docs[:1] * (count // 3)


@pytest.mark.parametrize("fanout, height, count", [(2, 8, 60), (2, 2, 60), (3, 1, 45), (5, 2, 60), (2, 1, 1)])
def test_against_a_plain_tree(spark, monkeypatch, fanout, height, count):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    docs = documents(random.Random(count + fanout), count)
    rows = spark.createDataFrame([(d["text"], 1, d["doc_id"], d["source"], d["lang"], d["n_chars"], "x", 2) for d in docs], SCHEMA).repartition(5)
    found = manifest.of_documents(rows, fanout).withColumns({"folded": manifest.folded(F.col("leaf"), F.col("proof")), "sha": manifest.proof_hash(F.col("proof"))}).collect()
    assert sorted((str(r.doc_id), r.leaf, r.bent, r.subroot, r.root, tuple((p.left, p.right) for p in r.proof)) for r in found) == plain(docs, fanout)
    assert all(r.folded == r.root and r.sha == digest(*[p.left + p.right for p in r.proof]) for r in found)


def test_no_rows(spark):
    assert manifest.of_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_fanout_of_one_is_refused(spark):
    with pytest.raises(ValueError):
        manifest.of_documents(spark.createDataFrame([], SCHEMA), 1)
