"""The registered queries of this package, over the benchmark tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, group_join, language, line_dedup, lm, manifest, quality, spelling, surrogates, token_files, top_k, toxicity
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


SHINGLES = r"""
    SELECT {id}, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
    FROM (SELECT {id}, regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {rows})
    WHERE len(w) >= {least}
"""


@query(
    "op6_ngram_jaccard_join",
    f"""
    WITH RECURSIVE sets AS ({SHINGLES.format(id="doc_id", text="text", rows="documents", least=1)}),
    tokens AS (SELECT doc_id, unnest(g) AS t FROM sets),
    met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
    linked AS (SELECT a, b FROM met JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * common >= 75 * (len(x.g) + len(y.g) - common)),
    edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
    reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
    least_one AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(len(g), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN least_one USING (doc_id)
    """,
)
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return group_join.near_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_bpe_codec")
def bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary())


@query(
    "op9_line_dedup",
    f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    sets AS ({SHINGLES.format(id="doc_id, n", text="line", rows="lines", least=1)}),
    tokens AS (SELECT doc_id, n, len(g) AS size, unnest(g) AS t FROM sets),
    met AS (SELECT y.doc_id, y.n, x.size + y.size - count(*) AS whole, count(*) AS common FROM tokens x JOIN tokens y ON x.t = y.t AND (x.doc_id, x.n) < (y.doc_id, y.n)
            GROUP BY x.doc_id, x.n, x.size, y.doc_id, y.n, y.size),
    gone AS (SELECT DISTINCT doc_id, n FROM met WHERE 100 * common >= 75 * whole),
    cut AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM lines ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(string_split(coalesce(c.text, ''), chr(10))) AS INTEGER) AS n_lines, sha256(coalesce(c.text, '')) AS text_sha256
    FROM documents d LEFT JOIN cut c USING (doc_id)
    """,
)
def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    kept = line_dedup.without_later_lines(documents)
    return kept.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


@query("op2_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def held_out(parts: int, remainder: int):
    """Whether crc32 of the doc_id leaves ``remainder``; false for a null doc_id."""
    return F.coalesce(fold("doc_id", parts) == remainder, F.lit(False))


@query("op7_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(documents, labels.where(~held_out(5, 0)).select("doc_id", F.col("toxic").alias("y")))
    found = toxicity.scored(documents, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


@query("op8_language_id")
def language_query(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    learned = language.dictionaries(documents.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return language.identified(documents, learned).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


@query("op3_quality_classifier")
def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = quality.scored(documents, labels.where(~held_out(4, 2)).select("doc_id", F.col("quality").alias("y")))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_rules")


@query(
    "op5_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), met AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM met QUALIFY rank <= 10
    """,
)
def top_k_query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k.top_k(vectors, vectors.where("vec_id % 100 = 0"))


END_OF_DOCUMENT = 49_407


@query("op10_token_counts")
def token_count_query(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary(), special=False)
    return token_files.counts_of_documents(coded, END_OF_DOCUMENT)


@query("op1_pii_surrogates")
def surrogate_query(spark: SparkSession, folder: str) -> DataFrame:
    found = surrogates.replaced(table(spark, folder, "documents"), key="benchmark key")
    return found.select("doc_id", "text", "n_entities", "kinds")


CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
"""crc32 of ASCII text, bit by bit."""
PIECE = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(more: int) -> str:
    return "sha256(" + " || ".join(PIECE.format(c) for c in ("doc_id", "source", "lang", f"(n_chars + {more})", "text")) + ")"


@query(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, {_leaf_sql(0)} AS leaf, CASE WHEN n_chars IS NOT NULL AND {CRC32.format(text="CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql(1)} END AS bent FROM documents
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves
    ), nodes(tree, level, pos, n, h) AS (
        SELECT tree, 0, pos, n, leaf FROM placed
        UNION ALL
        SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
    ), subroots AS (SELECT tree AS pos, h, (SELECT count(DISTINCT tree) FROM placed) AS n FROM nodes WHERE n = 1),
    crown(level, pos, n, h) AS (
        SELECT 0, pos, n, h FROM subroots
        UNION ALL
        SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 2, n
    ), steps AS (
        SELECT p.tree, p.pos, o.level, p.pos >> o.level AS here, s.h AS sibling FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) o ON o.tree = p.tree
            LEFT JOIN nodes s ON s.tree = p.tree AND s.level = o.level AND s.pos = xor(p.pos >> o.level, 1)
        UNION ALL
        SELECT p.tree, p.pos, 1000 + o.level, p.tree >> o.level, s.h FROM placed p, (SELECT DISTINCT level FROM crown WHERE n > 1) o LEFT JOIN crown s ON s.level = o.level AND s.pos = xor(p.tree >> o.level, 1)
    ), proofs AS (
        SELECT p.tree, p.pos, p.doc_id, p.leaf, coalesce(p.bent, p.leaf) AS bent, coalesce(string_agg(s.sibling, '' ORDER BY s.level), '') AS proof,
            coalesce(list({{'right': s.here % 2 = 0, 'h': coalesce(s.sibling, '')}} ORDER BY s.level) FILTER (s.level IS NOT NULL), []) AS path
        FROM placed p LEFT JOIN steps s ON s.tree = p.tree AND s.pos = p.pos GROUP BY ALL
    ), climbed(tree, pos, k, h) AS (
        SELECT tree, pos, 1, bent FROM proofs
        UNION ALL
        SELECT c.tree, c.pos, k + 1, sha256(CASE WHEN path[k]."right" THEN c.h || path[k].h ELSE path[k].h || c.h END) FROM climbed c JOIN proofs p ON p.tree = c.tree AND p.pos = c.pos WHERE k <= len(path)
    ), ends AS (SELECT c.tree, c.pos, c.h FROM climbed c JOIN proofs p ON p.tree = c.tree AND p.pos = c.pos WHERE k = len(path) + 1)
    SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
    FROM proofs p JOIN subroots s ON s.pos = p.tree JOIN ends e ON e.tree = p.tree AND e.pos = p.pos, (SELECT h FROM crown WHERE n = 1) r
    """,
)
def merkle_query(spark: SparkSession, folder: str) -> DataFrame:
    found = manifest.of_documents(table(spark, folder, "documents"))
    told = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash(F.col("proof")).alias("proof_sha256"), manifest.folded(F.col("bent"), F.col("proof")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


@query(
    "op12_spelling_variants",
    """
    WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
    ), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM counted),
    hashed AS (
        SELECT doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
            lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h FROM bytes, steps
    ), slipped AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
    vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    dropped AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
    near AS (
        SELECT a.word, b.word AS near, b.n FROM dropped a JOIN dropped b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM dropped a JOIN vocabulary b ON a.d = b.word
        UNION SELECT b.word, a.word, a.n FROM dropped a JOIN vocabulary b ON a.d = b.word
    ), best AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1),
    formed AS (
        SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN b.near END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n
        FROM vocabulary v LEFT JOIN best b USING (word)
    ), followed(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL)
    SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f
    JOIN (SELECT l.word, l.root FROM followed l JOIN formed g ON g.word = l.root WHERE g.form IS NULL) r ON r.word = f.word
    """,
)
def spelling_query(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.of_documents(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_lm_scoring")
def lm_query(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = lm.train(documents.where(~held_out(5, 1)).select("doc_id", "text"))
    found = lm.scored(documents, model)
    return found.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
