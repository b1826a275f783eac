"""The separator scan against splitting the ids in memory."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skyreel.llm import token_files
from skyreel.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def by_hand(ids, separator):
    out, open_ = [], 0
    for x in ids:
        if x == separator:
            out.append((open_, True))
            open_ = 0
        else:
            open_ += 1
    return out + ([(open_, False)] if open_ else [])


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [8, 64, 1 << 20])
def test_any_cut(spark, tmp_path, width, block):
    rng = np.random.default_rng(width + block)
    samples = [[], [7], [1, 2], [7, 7, 7], [1] * 40 + [7] + [2] * 50, rng.integers(5, 9, 500).tolist(), [*rng.integers(0, 300, 400).tolist(), 7]]
    files = []
    for k, ids in enumerate(samples):
        path = tmp_path / f"{k}.bin"
        path.write_bytes(np.array(ids, f"<u{width}").tobytes() + b"x" * (k % 2))
        files.append((f"file://{path}", path.stat().st_size))
    got = token_files.token_counts(spark.createDataFrame(files, "file string, bytes long"), 7, width, block).collect()
    for (path, _), ids in zip(files, samples):
        mine = sorted((r.ordinal, r.n_tokens, r.closed) for r in got if r.file == path)
        assert mine == [(k, n, closed) for k, (n, closed) in enumerate(by_hand(ids, 7))]


def test_documents(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, FOLDER).collect()}
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in texts}


def test_edges(spark):
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    rows = spark.createDataFrame([(1, None, "z"), (None, ids(5, 6), "z"), (1, ids(5), "z"), (2, bytearray(), "z")], "doc_id long, token_ids binary, file string")
    got = sorted(((r.doc_id, r.n_tokens) for r in token_files.counts_of_documents(rows, 9).collect()), key=str)
    assert got == sorted([(1, 0), (None, 2), (1, 1), (2, 0)], key=str)
    assert token_files.counts_of_documents(rows.limit(0), 9).count() == 0


def test_ids_that_do_not_fit_are_an_error(spark):
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    rows = spark.createDataFrame([(1, ids(5, 70_000))], "doc_id long, token_ids binary")
    with pytest.raises(Exception, match="doesn't fit"):
        token_files.counts_of_documents(rows, 9)
    assert [(r.doc_id, r.n_tokens) for r in token_files.counts_of_documents(rows, 70_001, width=4).collect()] == [(1, 2)]
    with pytest.raises(Exception, match="doesn't fit"):
        token_files.counts_of_documents(rows.limit(1), 70_000, width=2)


def test_a_row_a_document_is_not_broadcast(spark):
    """The exploded counts looked small to the planner, which gathered them on the driver."""
    rows = spark.createDataFrame([(k, bytearray(np.array([5] * (k % 7), "<u4").tobytes())) for k in range(50)], "doc_id long, token_ids binary")
    counts = token_files.counts_of_documents(rows, 9)
    assert sorted(map(tuple, counts.collect())) == [(k, k % 7) for k in range(50)]
    plan = counts._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]  # as it ran
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
