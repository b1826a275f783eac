"""The pipeline's stages, each on what the one before it kept, against plain versions."""

import public_tokenizers
from plain import components, kept_text, shingles
from test_decontamination import brute
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from skyreel.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe_codec" or docs.columns == columns
    toxic, lined, single, clean, coded = kept.values()
    scores = {r.doc_id: r.score for r in queries.QUERIES["op7_toxicity"](spark, FOLDER).collect()}
    assert set(toxic) == {d for d, s in scores.items() if s < 0.5}
    rows = sorted((d, r.text) for d, r in toxic.items())
    assert {d: r.text for d, r in lined.items()} == kept_text(rows)
    ids = sorted(lined)
    roots = components([shingles(lined[d].text) for d in ids])
    assert set(single) == {d for k, d in enumerate(ids) if roots[k] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute([(d, r.text) for d, r in single.items()], items)}
    assert set(clean) == set(single) - bad
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {d: r.n_tokens for d, r in coded.items()} == {d: len(library.encode(r.text, add_special_tokens=False).ids) for d, r in clean.items()}
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {d: r.ids_sha256 for d, r in coded.items()}


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
